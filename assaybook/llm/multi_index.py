"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own, so a vector lies in the cell of a
pair of centroids. A query walks the pairs in the order of their summed distances, with a heap over
the two sorted codebooks, until the cells it has passed hold the wanted share of all entries; the
entries of those cells are reranked by exact distances.

The codebooks are fitted on a bounded sample of vectors; so is the share, as the least that finds
``recall`` of the sample's true neighbours. Every vector is indexed, and no cell is capped. Entries
and queries meet in blocks of bounded size: entries by first centroid and chunk, queries by block.
A cell with a third of all rows is only more chunks, and of each meeting at most k rows leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Vectors the codebooks and the share are fitted on, and queries the share is measured with.
TRAIN_ROWS, TRIAL_QUERIES = 20_000, 200
#: Entries and queries that meet in one block, at most about this many.
ENTRIES, ASKERS = 8192, 4096


def sound(vector: Column) -> Column:
    """Whether a vector takes part: present, not zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0.0)


def _codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[np.sort(draw.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = _squares(x, centres).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1) if x.shape[1] else centres
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass
class MultiIndex:
    """Two codebooks and the share of entries a query passes."""

    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.cut], self.first).argmin(1), _squares(x[:, self.cut :], self.second).argmin(1)

    def walk(self, q: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
        """Which cells a query visits: pairs by summed distance until they hold ``wanted`` entries."""
        near1 = ((self.first - q[: self.cut]) ** 2).sum(1)
        near2 = ((self.second - q[self.cut :]) ** 2).sum(1)
        by1, by2 = np.argsort(near1, kind="stable").tolist(), np.argsort(near2, kind="stable").tolist()
        d1, d2 = near1[by1].tolist(), near2[by2].tolist()
        visited = np.zeros(sizes.shape, dtype=bool)
        heap, held = [(d1[0] + d2[0], 0, 0)], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            visited[by1[i], by2[j]] = True
            held += sizes[by1[i], by2[j]]
            # (i, j) is entered from its left neighbour, or from above in the first column: once only
            if j + 1 < len(d2):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        return visited


def fit_index(
    vectors: DataFrame, k: int = 10, centroids: int = 64, recall: float = 0.96, rows: int = TRAIN_ROWS, rounds: int = 10
) -> MultiIndex | None:
    """Fit on the ``rows`` vectors (vec_id, vec) with the smallest hashed ids; None without vectors."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec").toArrow()["vec"].combine_chunks()
    if not len(sample):
        return None
    x = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), -1)
    cut = max(1, x.shape[1] // 2)
    size = max(1, min(centroids, len(x) // 8))
    index = MultiIndex(_codebook(x[:, :cut], size, rounds, 1), _codebook(x[:, cut:], size, rounds, 2), 1.0)
    trial = x[:TRIAL_QUERIES]
    apart = _squares(trial, x)
    apart[np.arange(len(trial)), np.arange(len(trial))] = np.inf
    true = np.argpartition(apart, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((1, 0), np.int64)
    own1, own2 = index.cells(x)
    cost = (_squares(trial[:, :cut], index.first)[:, :, None] + _squares(trial[:, cut:], index.second)[:, None, :]).reshape(len(trial), -1)
    sizes = np.bincount(own1 * size + own2, minlength=size * size)
    order = np.argsort(cost, axis=1, kind="stable")
    passed = np.cumsum(sizes[order], axis=1)          # entries up to and with each visited cell
    depth = np.empty_like(passed)
    np.put_along_axis(depth, order, passed, axis=1)
    need = np.take_along_axis(depth, (own1 * size + own2)[true], axis=1) / len(x)
    if need.size:
        index.share = float(min(1.0, np.quantile(need, recall, method="higher") * 1.05))
    return index


def _assigner(index: MultiIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2 = index.cells(_matrix(b["vec"]))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vec"], pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=["vec_id", "vec", "c1", "c2"])

    return assign


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _walker(index: MultiIndex, sizes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries to one row per first centroid they visit, with the second ones as a bit row."""
    wanted = index.share * sizes.sum()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b["vec_id"].to_pylist(), _matrix(b["vec"])
            for start in range(0, len(ids), 256):
                at, c1, bits = [], [], []
                for row in range(start, min(start + 256, len(ids))):
                    visited = index.walk(x[row], sizes, wanted)
                    for c in np.flatnonzero(visited.any(1)).tolist():
                        at.append(row), c1.append(c), bits.append(np.packbits(visited[c]).tobytes())
                picked = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b["vec_id"].take(picked), b["vec"].take(picked), pa.array(c1, pa.int32()), pa.array(bits, pa.binary())],
                    names=["query_id", "qvec", "c1", "cells"],
                )

    return walk


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest entries of one block for each query that meets it."""

    def search(entries: pa.Table, askers: pa.Table) -> pa.Table:
        out_q, out_id, out_d = [], [], []
        if entries.num_rows and askers.num_rows:
            ids, x, c2 = entries["vec_id"].to_numpy(), _matrix(entries["vec"]), entries["c2"].to_numpy()
            qids, q = askers["query_id"].to_numpy(), _matrix(askers["qvec"])
            seen = np.unpackbits(np.frombuffer(b"".join(askers["cells"].to_pylist()), np.uint8).reshape(len(qids), -1), axis=1).astype(bool)
            for start in range(0, len(qids), 256):
                part = slice(start, start + 256)
                apart = _squares(q[part], x)
                apart[~seen[part][:, c2] | (ids[None] == qids[part][:, None])] = np.inf
                for r, row in enumerate(apart):
                    edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                    near = np.flatnonzero((row <= edge + 1e-9 * (1 + abs(edge))) & np.isfinite(row)) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
                    exact = np.sqrt(((x[near] - q[start + r]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:k]
                    out_q.append(np.full(len(best), qids[start + r])), out_id.append(ids[near][best]), out_d.append(exact[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_id, np.int64), "score": join(out_d, np.float64)})

    return search


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, ids: str = "vec_id", vector: str = "embedding", **settings
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors found, nearest first.

    ``queries`` says which rows ask; candidates are all rows but those with the query's id. The
    score is the Euclidean distance in double precision; ties go to the smaller id, and a query
    with fewer candidates gets them all. Vectors that are not ``sound``, have no id or are not as
    long as most take no part. Rows that share an id are one vector, the smallest by component.
    Other columns are not read, whatever their names. No rows: no rows.
    """
    spark = vectors.sparkSession
    asks = queries.cast("boolean")
    whole = vectors.select(F.col(f"`{ids}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), asks.alias("asks"))
    whole = whole.filter(F.col("vec_id").isNotNull() & sound(F.col("vec")))
    lengths = whole.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    whole = whole.filter(F.size("vec") == lengths["length"]).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    whole = stage(whole, "vectors")
    index = fit_index(whole, k, **settings)
    placed = whole.select("vec_id", "vec").mapInArrow(_assigner(index), "vec_id long, vec array<double>, c1 int, c2 int")
    entries = stage(placed, "entries")
    sizes = np.zeros((len(index.first), len(index.second)), dtype=np.int64)
    for row in entries.groupBy("c1", "c2").count().collect():         # at most a row per pair of centroids
        sizes[row["c1"], row["c2"]] = row["count"]
    asking = whole.filter("asks").select("vec_id", "vec")
    n_blocks = max(1, -(-asking.count() // ASKERS))
    n_chunks = np.maximum(1, -(-sizes.sum(1) // ENTRIES))
    chunks_of = F.element_at(F.array(*[F.lit(int(n)) for n in n_chunks]), F.col("c1") + 1)
    block = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    met = entries.select(
        "vec_id", "vec", "c1", "c2", F.pmod(F.xxhash64("vec_id"), chunks_of).cast("int").alias("chunk"), F.explode(block).alias("block")
    )
    walked = asking.mapInArrow(_walker(index, sizes), "query_id long, qvec array<double>, c1 int, cells binary")
    askers = walked.select(
        "query_id", "qvec", "c1", "cells", F.explode(F.sequence(F.lit(0), chunks_of - 1)).alias("chunk"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
    )
    keys = ["c1", "chunk", "block"]
    found = met.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return (
        found.groupBy("query_id").agg(best.alias("best"))
        .select("query_id", F.posexplode("best").alias("place", "entry"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "entry.vec_id", "entry.score")
    )
