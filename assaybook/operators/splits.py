"""Seeded subsets, chunk splits, fit samples and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_ROWS, SPLIT_SEED, TRAIN_FRACTION, VAL_FRACTION
from ..session import local_table
from .ordering import hash_cutoff, hash_order, running_total

# a driver-side permutation is only offered up to this many chunks; beyond it use order="md5"
MAX_DRIVER_CHUNKS = 5_000_000


@dataclass
class ChunkSplit:
    """Which chunk of consecutive rows is on which side.

    The md5 order needs no table: a chunk is on the train side when its hash is not above one
    cutoff, so attaching sides is a narrow projection and the matrix is never shuffled.
    """

    n_rows: int
    chunk_rows: int
    n_chunks: int
    n_train: int
    seed: int
    cutoff: str | None = None
    table: DataFrame | None = None

    def chunk_id(self, row_id: Column) -> Column:
        return F.floor(row_id / self.chunk_rows)

    def attach(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """Add ``chunk_id`` and ``side``: train, val, or null for the last chunk."""
        df = df.withColumn("chunk_id", self.chunk_id(F.col(row_id)))
        if self.table is not None:
            return df.join(self.table, "chunk_id", "left")
        in_play = F.col("chunk_id") < self.n_chunks - 1
        train = hash_order(self.seed, "chunk_id") <= F.lit(self.cutoff)
        return df.withColumn(
            "side", F.when(in_play & train, F.lit("train")).when(in_play, F.lit("val"))
        )

    def train(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        return self.attach(df, row_id).filter("side = 'train'").drop("side", "chunk_id")

    @property
    def n_train_rows(self) -> int:
        return self.n_train * self.chunk_rows

    def ranges(self, spark: SparkSession) -> DataFrame:
        """Every chunk in play with its side and half-open row range."""
        chunks = self.attach(spark.range(self.n_chunks - 1).select(
            (F.col("id") * self.chunk_rows).alias("row_id")))
        return chunk_ranges(chunks.drop("row_id"), self.chunk_rows)


def chunk_split(
    spark: SparkSession,
    n_rows: int,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = SPLIT_SEED,
    fraction: float = TRAIN_FRACTION,
    order: str = "md5",
) -> ChunkSplit:
    """Split whole chunks into train and val; the last, possibly partial, chunk is left out.

    The train side gets ``int(fraction * all chunks)`` chunks. ``order="numpy"`` reproduces a
    numpy generator's shuffle of the chunk list; ``"md5"`` scales to any number of chunks.
    """
    n_chunks = -(-n_rows // chunk_rows)
    if n_chunks < 2:
        raise ValueError(f"a train/val split needs two chunks or more, there are {n_chunks}")
    n_train = min(int(fraction * n_chunks), n_chunks - 1)
    if n_train <= 0 or n_train >= n_chunks - 1:
        raise ValueError(f"fraction {fraction} of {n_chunks} chunks leaves one side empty")
    split = ChunkSplit(n_rows, chunk_rows, n_chunks, n_train, seed)
    if order == "md5":
        hashes = spark.range(n_chunks - 1).select(hash_order(seed, "id").alias("h"))
        split.cutoff = hash_cutoff(hashes, n_train)
    elif order == "numpy":
        if n_chunks > MAX_DRIVER_CHUNKS:
            raise ValueError(f"{n_chunks} chunks are too many to permute here; use order='md5'")
        ids = np.arange(n_chunks - 1)
        np.random.default_rng(seed).shuffle(ids)
        sides = np.where(np.arange(n_chunks - 1) < n_train, "train", "val")
        split.table = local_table(
            spark, {"chunk_id": ids, "side": sides.tolist()},
            {"chunk_id": pa.int64(), "side": pa.string()},
        )
    else:
        raise ValueError(f"order must be md5 or numpy, not {order!r}")
    return split


def chunk_ranges(chunks: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the half-open row range of each ``chunk_id``."""
    start = F.col("chunk_id") * chunk_rows
    return chunks.withColumns({"start_row": start, "end_row": start + chunk_rows})


def evenly_spaced(df: DataFrame, n_rows: int, max_rows: int, row_id: str = "row_id") -> DataFrame:
    """At most ``max_rows`` rows at an even step. Rows past step * max_rows are never taken."""
    if n_rows <= max_rows:
        return df
    step = max(1, n_rows // max_rows)
    return df.filter((F.col(row_id) % step == 0) & (F.col(row_id) < step * max_rows))


def sample_size(split: ChunkSplit, fraction: float, least: int, most: int) -> int:
    """A fraction of the train rows, within two limits."""
    return int(min(max(split.n_train_rows * fraction, least), most))


def fit_sample(df: DataFrame, split: ChunkSplit, fraction: float, least: int, most: int, row_id: str = "row_id") -> DataFrame:
    """Evenly spaced over all rows, then only those on the train side.

    For a caller who asks for a sample; no fit of this library draws one.
    """
    return split.train(evenly_spaced(df, split.n_rows, sample_size(split, fraction, least, most), row_id), row_id)


def fixed_split(
    df: DataFrame, n_rows: int, key: str, fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED
) -> DataFrame:
    """Row-level split: the first ``round(fraction * n)`` rows in hash order are val.

    ``key`` must be unique. One cutoff hash is found, then sides are a plain projection.
    """
    cutoff = hash_cutoff(df.select(hash_order(seed, key).alias("h")), round(fraction * n_rows))
    return df.withColumn(
        "side", F.when(hash_order(seed, key) <= F.lit(cutoff), "val").otherwise("train")
    )


def assign_folds(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    k: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Add ``fold`` 0..k-1 per group in hash order, with k = min(k, rows // 2).

    Fold sizes differ by one at most, larger ones first. Groups too small for two folds are
    left out.
    """
    placed = running_total(
        # as bytes the hash orders like its digits and is half as long; it serves the order only
        df.withColumn("_h", F.unhex(hash_order(seed, *group, key))), group, ["_h", key], None, "_at", "_n", df.columns
    )
    folds = F.least(F.lit(k), F.floor(F.col("_n") / 2))
    size, extra = F.floor(F.col("_n") / folds), F.col("_n") % folds
    head = extra * (size + 1)
    fold = F.when(F.col("_at") < head, F.floor(F.col("_at") / (size + 1))).otherwise(
        extra + F.floor((F.col("_at") - head) / size)
    )
    return placed.filter(F.col("_n") >= 4).withColumn("fold", fold.cast("int")).drop("_at", "_n")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; an empty result means the sides are disjoint."""
    return a.select(key).intersect(b.select(key))
