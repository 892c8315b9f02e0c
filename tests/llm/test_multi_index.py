"""Recall against brute force, exact scores, and every vector that takes no part."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, vec string, c1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, -1, "v", 7) for i, v in rows], SCHEMA).repartition(3)


def brute(vectors, query, k=10):
    near = sorted((math.dist(v, vectors[query]), i) for i, v in vectors.items() if i != query)
    return near[:k]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    return {q: [rows[i] for i in sorted(rows)] for q, rows in out.items()}


def clustered(n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim)) * 3
    x = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    x[500:900] = x[500]                                        # one vector with very many copies
    return {i: x[i].astype(float) for i in range(n)}


@pytest.mark.parametrize("blocks", [None, (64, 8)])
def test_recall(spark, monkeypatch, blocks):
    if blocks:                                                 # many chunks and query blocks
        monkeypatch.setattr(multi_index, "ENTRIES", blocks[0])
        monkeypatch.setattr(multi_index, "ASKERS", blocks[1])
    vectors = clustered()
    got = found(multi_index.nearest_neighbours(frame(spark, vectors.items()), F.col("vec_id") % 100 == 0))
    assert set(got) == set(range(0, 3000, 100))
    hits = total = 0
    for q, rows in got.items():
        want = brute(vectors, q)
        assert len(rows) == 10 and rows == sorted(rows) and q not in [i for _, i in rows]
        assert all(score == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12) for score, i in rows)
        worst = want[-1][0] + 1e-9
        hits += sum(score <= worst for score, _ in rows)
        total += 10
    assert hits / total >= 0.9
    assert [i for _, i in got[600]] == [i for _, i in brute(vectors, 600)]           # ties by the smaller id


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no sample tables here")
def test_recall_on_the_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect()}
    got = found(multi_index.nearest_neighbours(df, F.col("vec_id") % 100 == 0))
    hits = sum(len({i for _, i in rows} & {i for _, i in brute(vectors, q)}) for q, rows in got.items())
    assert hits / (10 * len(got)) >= 0.9


def test_walk_passes_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    index = multi_index.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)), 1.0)
    sizes, q = rng.integers(0, 9, (7, 5)), rng.normal(size=5)
    cost = ((index.first - q[:3]) ** 2).sum(1)[:, None] + ((index.second - q[3:]) ** 2).sum(1)[None]
    for wanted in (1, 20, sizes.sum()):
        visited = index.walk(q, sizes, wanted)
        assert sizes[visited].sum() >= wanted
        order = np.argsort(cost, axis=None)
        depth = int(visited.sum())
        assert set(np.flatnonzero(visited.ravel())) == set(order[:depth]) and sizes.ravel()[order[: depth - 1]].sum() < wanted


def test_messy_vectors(spark):
    rows = [(0, [1, 0]), (100, [0, 1]), (1, [1, 1]), (2, [1, 1]), (3, None), (4, [0, 0]), (5, [1, None]), (6, [float("nan"), 1]), (7, [float("inf"), 1]),
            (8, [1, 2, 3]), (None, [1, 1]), (9, []), (2, [1, 1]), (200, [0, 0])]
    got = found(multi_index.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert {q: [i for _, i in r] for q, r in got.items()} == {0: [1, 2, 100], 100: [1, 2, 0]}
    assert got[0][2][0] == pytest.approx(math.sqrt(2))


def test_no_rows(spark):
    empty = frame(spark, [(1, None)]).filter("vec_id > 5")
    for df in (empty, frame(spark, [(1, None), (2, [0, 0])]), frame(spark, [(1, [1, 0]), (2, [0, 1])])):        # nothing valid, or nobody asks
        out = multi_index.nearest_neighbours(df, F.col("vec_id") % 100 == 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.isEmpty()
    alone = multi_index.nearest_neighbours(frame(spark, [(100, [1, 0])]), F.col("vec_id") % 100 == 0)
    assert alone.isEmpty()
