"""Counts against a plain account, trees against their own definition."""

import random
import re
from collections import Counter

import numpy as np
from conftest_llm import MESSY, texts_of

from assaybook.llm import quality_trees as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_words, n_repeat = len(words), len(inside)
    return (n_words, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n_repeat,
            n_words < 20 or 100 * n_repeat > 30 * n_words)


def test_counts():
    random.seed(2)
    texts = [t for _, t in texts_of()] + [" ".join(random.choice(["a", "b", "ab\n", "#x", "é y"]) for _ in range(n)) for n in range(0, 90, 3)]
    for text in texts:
        assert q.count_text(text)[:5] == by_hand(text)[:5]


def labelled(spark, make):
    random.seed(3)
    good = [(i, " ".join(random.choice("the of and model data river stone paper light".split()) + str(random.randint(0, 99)) for _ in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(random.choice("THE OF AND MODEL DATA".split()) + "#$%"[i % 3] * 3 + str(random.randint(0, 99)) for _ in range(60))) for i in range(150)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[:80]] + [(d, 0, 0) for d, _ in bad[:80]] + [(None, 1, 0), (5, None, 0), (-9, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return good, bad, labels


def test_held_out_verdicts(spark, make):
    good, bad, labels = labelled(spark, make)
    got = {r["doc_id"]: r["kept"] for r in q.quality_verdicts(make(good + bad), labels).collect()}
    assert all(got[d] for d, _ in good) and not any(got[d] for d, _ in bad[80:])


def test_messy_rows(spark, messy, make):
    _, _, labels = labelled(spark, make)
    for told in (labels, labels.limit(0)):                          # without labels nothing but the base fails
        rows = q.quality_verdicts(messy, told).collect()
        want = Counter((d, *by_hand(t)) for d, t in texts_of())
        assert Counter((r["doc_id"], *[r[c] for c in q.COUNTS[:5]], r["base_failed"]) for r in rows) == want
        assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    stage = q.quality_stage(messy, labels)
    assert stage.schema == messy.schema
    assert Counter(map(str, stage.collect())) == Counter(str(r["row"]) for r in rows if r["kept"])


def test_no_rows(spark, nothing, make):
    _, _, labels = labelled(spark, make)
    assert q.quality_verdicts(nothing, labels).isEmpty() and q.quality_stage(nothing, labels).schema == nothing.schema
    assert len(MESSY) > 0


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(3000, 3))
    chance = 1 / (1 + np.exp(-(4 * np.sin(9 * x[:, 0]) - 3 * x[:, 1] + 2 * x[:, 2])))
    y = (rng.uniform(size=3000) < chance).astype(float)
    trees = q.fit_trees(x, y, np.array([0, -1, 1]), trees=30)
    probe = rng.uniform(size=(400, 3))
    for column, sign in ((1, -1), (2, 1)):
        steps = np.stack([trees.score(np.column_stack([np.where(np.arange(3) == column, v, probe[:, [0, 1, 2]][:, :])])) for v in np.linspace(0, 1, 41)])
        assert (np.diff(steps, axis=0) * sign >= -1e-12).all()
    assert np.ptp([trees.score(np.array([[v, 0.5, 0.5]]))[0] for v in np.linspace(0, 1, 41)]) > 0.5

    def walk(row):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    np.testing.assert_allclose(trees.score(probe), [walk(r) for r in probe])
    assert ((trees.score(x) > 0) == (chance > 0.5)).mean() > 0.85
