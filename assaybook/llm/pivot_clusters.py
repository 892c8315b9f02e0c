"""Centroid clustering with a table of distances to fixed pivots (LAESA).

Vectors become integers once and are staged with their distances to a few fixed pivots. As the
distance is a metric, the difference of a vector's and a centroid's distance to one pivot is a
lower bound of the distance between the two. Every round only the centroids meet the pivots anew;
a centroid whose bound lies above the best distance known for a vector is passed over, and what is
left gets its exact distance in integers. Bounds carry a margin for rounding, so ties are never
passed over and the result is that of comparing everything.

A round is one narrow pass: tasks add up the vectors of each cluster, one row per task and cluster
is shuffled, and k rows come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table, stage

#: Components are refused from here on: with 64 of them, squared distances still fit in a long.
LARGEST = 1 << 27
#: Distances to pivots, up to 2**31, are rounded by less than a quarter of this.
MARGIN = 2e-6


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one centre."""
    apart = x - centre
    return np.einsum("ij,ij->i", apart, apart)


def far_apart(seeds: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different seeds, each the farthest from those taken before it."""
    taken, nearest = [0], squared(seeds, seeds[0])
    while len(taken) < n and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(seeds, seeds[taken[-1]]))
    return seeds[taken]


class PivotTable:
    """Centroids and their distances to the pivots."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        self.to_pivots = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))

    def assign(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, its squared distance, and how many distances were computed.

        ``to_pivots`` holds the vectors' squared distances to the pivots.
        """
        stored = np.sqrt(to_pivots.astype(np.float64))
        lower = np.zeros((len(x), len(self.centroids)))
        for p in range(stored.shape[1]):
            np.maximum(lower, np.abs(stored[:, p, None] - self.to_pivots[None, :, p]), out=lower)
        cluster = lower.argmin(axis=1)
        first = cluster.copy()
        apart = x - self.centroids[first]
        best = np.einsum("ij,ij->i", apart, apart)
        reach, computed = np.sqrt(best.astype(np.float64)) + MARGIN, len(x)
        for c, centre in enumerate(self.centroids):
            rows = np.flatnonzero((lower[:, c] <= reach) & (first != c))
            distance = squared(x[rows], centre)
            computed += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
            rows, distance = rows[better], distance[better]
            cluster[rows], best[rows] = c, distance
            reach[rows] = np.sqrt(distance.astype(np.float64)) + MARGIN
        return cluster, best, computed


def _whole(values: np.ndarray, scale: float) -> np.ndarray:
    whole = np.floor(scale * values)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / scale:.0f}: squared distances would not fit in a long")
    return whole.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), kind))


def _with_pivots(valid: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, v, p): integer components, and squared distances to the pivots."""
    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(_matrix(batch.column("e"), pivots.shape[1]), scale)
            to = np.stack([squared(x, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(x, pa.int32()), _lists(to, pa.int64())], names=["vec_id", "v", "p"])

    return valid.select("vec_id", "e").mapInArrow(convert, f"vec_id {valid.schema['vec_id'].dataType.simpleString()}, v array<int>, p array<long>")


def _read(batch: pa.RecordBatch, table: PivotTable) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("v"), table.centroids.shape[1]).astype(np.int64), _matrix(batch.column("p"), table.to_pivots.shape[1])


def _moved(stored: DataFrame, table: PivotTable) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means; an empty one stays."""
    k, dims = table.centroids.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x, to = _read(batch, table)
            cluster = table.assign(x, to)[0]
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), _lists(total[held], pa.int64())], names=["cluster", "n", "v"])

    parts = stored.select("v", "p").mapInArrow(sums, "cluster int, n long, v array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    centroids = table.centroids.copy()
    for r in rows:                                        # k of them at most
        centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return centroids


def _assigned(stored: DataFrame, table: PivotTable) -> DataFrame:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = table.assign(*_read(batch, table))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assign, f"vec_id {stored.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, pivots: int = 8
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) for each kept vector.

    ``vectors`` has ``vec_id`` and ``embedding``. Kept are the vectors with exactly ``dims``
    components, none missing or non-finite; each component x becomes floor(scale * x). The
    centroids start as the ``k`` kept vectors whose ``<seed>:<vec_id>`` has the smallest hex sha256, move
    ``rounds`` times to the floors of their vectors' means, and vectors are assigned once more. Distances
    are squared; equal ones go to the smaller number.

    Fewer kept vectors than ``k``: as many centroids. Repeated ids and repeated vectors count each;
    rows with the same id become seeds in the order of their components. A vector without an id is
    clustered like any other, and becomes a seed only after all that have one. Equal seeds stay separate
    centroids, of which the first takes the vectors. No kept vector: no rows. Other columns of ``vectors``
    are not read. A component too large for exact distances in a long is an error.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select("vec_id", e.alias("e")).filter((F.size("e") == dims) & finite)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = valid.orderBy(order.asc_nulls_last(), "e").limit(k).collect()
    if not seeds:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid array<long>, centroid_sha256 string")
    centroids = _whole(np.array([r["e"] for r in seeds], dtype=np.float64), scale)
    fixed = far_apart(centroids, pivots)
    stored = stage(_with_pivots(valid, fixed, scale), "pivots")
    for _ in range(rounds):
        centroids = _moved(stored, PivotTable(fixed, centroids))
    out = stage(_assigned(stored, PivotTable(fixed, centroids)), "assigned")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}      # k rows
    final = {c: centroids[c].tolist() for c in sorted(sums)}
    told = local_table(
        spark,
        {"cluster": list(final), "cluster_inertia": [sums[c] for c in final], "inertia": [sum(sums.values())] * len(final),
         "centroid": list(final.values()), "centroid_sha256": [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in final.values()]},
        {"cluster": pa.int32(), "cluster_inertia": pa.int64(), "inertia": pa.int64(), "centroid": pa.list_(pa.int64()), "centroid_sha256": pa.string()},
    )
    return out.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
