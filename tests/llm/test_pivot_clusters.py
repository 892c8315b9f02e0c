"""Clusters against a plain comparison of every vector with every centroid."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from assaybook.llm import pivot_clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string, p string, e long, n long, distance string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, -1, "v", "p", 7, 8, "d") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=16, rounds=3, dims=64, seed=1):
    """The contract in plain Python integers, over (vec_id, vector) rows."""
    kept = [(i, [np.float32(x).item() for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    whole = [[math.floor(64 * x) for x in v] for _, v in kept]
    centroids = [[math.floor(64 * x) for x in v] for _, v in sorted(kept, key=key)[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for v in whole]

    for _ in range(rounds):
        near = nearest()
        for n in range(len(centroids)):
            own = [v for v, (_, c) in zip(whole, near) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    near = nearest()
    sums = Counter()
    for d, c in near:
        sums[c] += d
    return Counter((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, near))


def got(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def grouped(n=600, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 2
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.3).astype(np.float32)
    x[n // 6 : n // 2] = x[n // 6]                                  # a third of all rows is one vector
    return [(i, x[i].tolist()) for i in range(n)]


def test_clusters_and_the_distances_saved(spark):
    rows = grouped()
    out = pivot_clusters.cluster_vectors(frame(spark, rows))
    assert got(out) == brute(rows)
    assert all(hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() == r["centroid_sha256"] for r in out.collect())


def test_messy_vectors(spark):
    rows = grouped(60)
    base = rows[5][1]
    rows += [(5, base), (5, rows[9][1]), (None, base), (None, [1.0] * 64), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65),
             (204, [None] + [1.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] * 64), (207, [0.0] * 64), (208, [-0.0] * 64), (209, [-1e-9] * 64)]
    assert got(pivot_clusters.cluster_vectors(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 16, 17])
def test_few_and_equal_vectors(spark, n):
    same = [(i, [0.5, -0.25]) for i in range(n)]
    assert got(pivot_clusters.cluster_vectors(frame(spark, same), dims=2)) == brute(same, dims=2)
    rng = np.random.default_rng(n)
    near = [(i, (rng.integers(-2, 3, 2) / 64).tolist()) for i in range(n)]          # many ties
    assert got(pivot_clusters.cluster_vectors(frame(spark, near), dims=2, rounds=5)) == brute(near, dims=2, rounds=5)


def test_ids_alone_make_seeds_before_those_without(spark):
    rows = [(None, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [5.0, 5.0])]
    assert got(pivot_clusters.cluster_vectors(frame(spark, rows), k=2, dims=2)) == brute(rows, k=2, dims=2)


def test_bounds_never_pass_over_the_nearest():
    rng = np.random.default_rng(4)
    for top in (3, 100, 1 << 27):
        x = rng.integers(-top, top + 1, (2000, 64))
        x[1000:] = x[:1000] + rng.integers(-1, 2, (1000, 64))
        x = np.clip(x, -(1 << 27), 1 << 27)
        centroids = x[rng.choice(2000, 16, replace=False)]
        centroids[3] = centroids[1]
        pivots = pivot_clusters.far_apart(centroids, 8)
        to = np.stack([pivot_clusters.squared(x, p) for p in pivots], axis=1)
        cluster, distance, computed = pivot_clusters.PivotTable(pivots, centroids).assign(x, to)
        every = np.stack([pivot_clusters.squared(x, c) for c in centroids], axis=1)
        assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
        assert computed <= every.size


def test_near_groups_need_few_exact_distances():
    x = (np.array([v for _, v in grouped()]) * 64).astype(np.int64)
    centroids = x[np.random.default_rng(2).choice(600, 16, replace=False)]
    pivots = pivot_clusters.far_apart(centroids, 8)
    to = np.stack([pivot_clusters.squared(x, p) for p in pivots], axis=1)
    assert pivot_clusters.PivotTable(pivots, centroids).assign(x, to)[2] < 0.5 * 16 * len(x)


def test_components_too_large_for_a_long_are_refused(spark):
    with pytest.raises(Exception, match="squared distances"):
        pivot_clusters.cluster_vectors(frame(spark, [(1, [1.0, 2.0]), (2, [1e30, 0.0])]), dims=2).collect()


def test_no_rows(spark):
    out = pivot_clusters.cluster_vectors(frame(spark, [(1, None), (2, [1.0])]))
    assert out.isEmpty() and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
