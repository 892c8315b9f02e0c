"""Targets by hand, and what pivotal rounding promises."""

import random
import re
from collections import Counter

import pytest
from conftest_llm import MESSY
from pyspark.sql import functions as F

from assaybook.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < weight[s] * rate}
        if not full:
            return {**out, **{s: weight[s] * rate for s in open_}}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows_of(df):
    return [(r["source"], r["doc"], r["size"], r["n"], r["source_size"], r["target"], r["copies"]) for r in df.collect()]


def check(rows, texts):
    sizes = Counter()
    for _, text, source in texts:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken, largest = targets_by_hand(sizes), Counter(), Counter()
    for source, _, size, n, source_size, target, copies in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source])
        share = target / source_size if source_size else 0
        assert int(share) <= copies <= int(share) + 1 and copies <= 2
        taken[source] += size * n * copies
        largest[source] = max(largest[source], size * n)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] + 1e-6


def made(seed=5, n=400):
    random.seed(seed)
    sources = ["a"] * 6 + ["b", "B", "é", "", None, "zz"]
    return [(i, "w " * random.choice((0, 1, 3, 10, 40)), random.choice(sources)) for i in range(n)]


def test_targets_and_totals(make):
    rows = made()
    check(rows_of(mixing.mix_units(make(rows))), rows)


def test_many_cells_and_levels(make, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 6)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = made(6)
    first = rows_of(mixing.mix_units(make(rows)))
    check(first, rows)
    assert sorted(map(str, first)) == sorted(map(str, rows_of(mixing.mix_units(make(rows, 7)))))          # reruns agree
    assert sorted(map(str, first)) != sorted(map(str, rows_of(mixing.mix_units(make(rows), seed=12))))


def test_expectation(make):
    """Over seeds a document is taken as often as its fraction says."""
    rows = [(i, "w " * (1 + i % 4), "b" if i % 2 else "a") for i in range(24)]
    total, target = Counter(), {}
    for seed in range(25):
        for source, doc, size, _, source_size, goal, copies in rows_of(mixing.mix_units(make(rows, 1), seed=seed)):
            total[source] += copies * size
            target[source] = goal
    for source, goal in target.items():
        assert total[source] / 25 == pytest.approx(goal, rel=0.05)


def test_messy_rows(messy):
    rows = mixing.mix_units(messy)
    check(rows_of(rows), [(r[0], r[1], r[3]) for r in MESSY])
    assert rows.agg(F.sum("n")).first()[0] == len(MESSY)
    mixed = mixing.mix(messy)
    assert mixed.schema == messy.schema
    copies = {(r["source"], r["doc"], r["size"]): r["copies"] for r in rows.collect()}
    want = Counter()
    for r in messy.collect():
        want[str(r)] += copies[(r["source"], r["doc_id"], len(WORD.findall(r["text"] or "")))]
    assert Counter(map(str, mixed.collect())) == +want


def test_no_rows(nothing):
    assert mixing.mix_units(nothing).isEmpty() and mixing.mix(nothing).schema == nothing.schema
