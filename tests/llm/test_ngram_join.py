"""Links and groups against a comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import MESSY
from pyspark.sql import functions as F

from assaybook.llm import bloom, components, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def shingles(text, words):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def by_hand(rows, words, percent):
    sets = [(d, shingles(t or "", words)) for d, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=sorted)
    parent, links = list(range(len(distinct))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            common = len(a & distinct[j])
            if 100 * common >= percent * (len(a) + len(distinct[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    at = {s: i for i, s in enumerate(distinct)}
    first = {}
    for d, s in sets:
        if s and d is not None:
            first[root(at[s])] = min(d, first.get(root(at[s]), d))
    return Counter((d, len(s), first.get(root(at[s])) if s else d, links[at[s]] if s else 0) for d, s in sets)


def got(df, words, percent):
    return Counter((r["doc"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_groups(df, words, percent).collect())


def families(seed, n=90):
    """Texts with few and many changes, of very different lengths, that share passages."""
    random.seed(seed)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 60))
    passage = [word() for _ in range(25)]
    bases = [[word() for _ in range(random.choice((2, 8, 15, 40, 120, 400)))] for _ in range(9)]
    rows = []
    for i in range(n):
        text = list(random.choice(bases))
        for _ in range(random.choice((0, 0, 1, 2, 5))):
            text[random.randrange(len(text))] = word()
        rows.append((i, " ".join(text + (passage if random.random() < 0.3 else []))))
    return rows


@pytest.mark.parametrize("words, percent, block", [(3, 90, 512), (5, 80, 512), (3, 60, 4), (2, 80, 7)])
def test_groups(make, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)            # small blocks: families fall into many cells
    monkeypatch.setattr(ngram_join, "BUNDLE", 4 * block)
    rows = families(words * percent)
    want = by_hand(rows, words, percent)
    assert got(make(rows), words, percent) == want
    assert max(n for *_, n in want) > 2


def test_messy_rows(messy):
    for words, percent in ((3, 90), (5, 80)):
        assert got(messy, words, percent) == by_hand([(r[0], r[1]) for r in MESSY], words, percent)


def test_one_document_of_each_group_stays(messy, make):
    stage = ngram_join.near_duplicate_stage(messy)
    assert stage.schema == messy.schema
    rows = [(r["doc_id"], r["text"]) for r in stage.collect()]
    worded = [r for r in rows if WORD.search(r[1] or "")]
    groups = by_hand([(r[0], r[1]) for r in MESSY], 5, 80)
    assert len(worded) == len({c for _, n, c, _ in groups if n})
    assert {r[0] for r in rows if not WORD.search(r[1] or "")} == {None, 7, 8, 9}
    kept = {r["doc_id"] for r in ngram_join.near_duplicate_stage(make(families(7))).collect()}
    assert kept == {c for _, _, c, _ in by_hand(families(7), 5, 80)}


def test_unrelated_texts_without_an_id_all_stay(make):
    rows = [(None, "one text of its own that nobody else has"), (None, "quite another matter with seven other words"), (None, "quite another matter with seven other words")]
    rows += [(4, "a third thing that stands here under a number"), (None, "a third thing that stands here under a number")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.near_duplicate_stage(make(rows)).collect()]
    assert Counter(kept) == Counter([rows[0], rows[1], rows[3]])


def test_near_copies_without_an_id_link(make):
    random.seed(11)
    base = [f"w{i}" for i in range(60)]
    change = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    # the texts of 1 and 2 are only connected by one without an id; two more texts without an id link with each other
    rows = [(1, change(0)), (2, change(59)), *[(None, " ".join(base))] * 5]
    lone = [f"z{i}" for i in range(60)]
    rows += [(None, " ".join(lone)), (None, " ".join(["y", *lone[1:]])), (9, "nothing in common with any of the others at all")]
    want = by_hand(rows, 3, 96)
    assert got(make(rows), 3, 96) == want and want[(2, 58, 1, 1)] == 1 and want[(None, 58, None, 1)] == 2
    kept = [r["doc_id"] for r in ngram_join.near_duplicate_stage(make(rows)).collect()]
    assert Counter(kept) == Counter([1, None, 9])


def test_no_rows(nothing):
    assert ngram_join.ngram_groups(nothing).isEmpty() and ngram_join.near_duplicate_stage(nothing).schema == nothing.schema


def test_overlaps_count_over_strips(monkeypatch):
    monkeypatch.setattr(ngram_join, "STRIP", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (0, 3, 20, 30, 35)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    assert ngram_join.overlaps(sets, sets[1:]).tolist() == want


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_linked_sets_share_signatures(percent):
    """Of any two sets that link, two signatures at least are equal."""
    rng = np.random.default_rng(percent)
    bands = ngram_join.size_bands(percent)
    for n in [*range(int(bands[0]), 60), 100, 400, 1500]:
        values = np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64)
        for grow in (0, 1):                                    # as many changes as a link allows, by growth or by exchange
            extra = len(values) * (100 - percent) // percent if grow else len(values) * (100 - percent) // (100 + percent)
            new = rng.integers(0, 1 << 62, extra).astype(np.uint64)
            other = np.unique(np.concatenate((values if grow else values[extra:], new)))
            common = len(np.intersect1d(values, other))
            assert 100 * common >= percent * (len(values) + len(other) - common)
            if len(other) >= bands[0] and not np.array_equal(values, other):
                (a, sure), (b, other_sure) = ngram_join.signatures(values, percent, bands), ngram_join.signatures(other, percent, bands)
                shared = np.intersect1d(a, b) & 127
                met = [k for k in sure if k in other_sure]
                assert met and all((shared == k).sum() >= max(sure[k], other_sure[k]) for k in met), (n, grow)


def test_components(spark):
    random.seed(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)] + [(7, 7), (300, 300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_the_filter_lets_every_key_through(spark):
    keys = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    bits = bloom.bloom_filter(keys, "k", keys.count())
    kept = [r[0] for r in spark.range(3000).filter(bloom.may_hold(bits, F.col("id"))).collect()]
    assert set(range(0, 3000, 7)) <= set(kept) and len(kept) < 600
