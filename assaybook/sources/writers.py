"""Writers: chunked matrices, split tables, fitted statistics, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_ROWS
from ..operators.splits import ChunkSplit


def write_matrix(df: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS, force: bool = False) -> None:
    """Matrix sorted by row, with its chunk number; an existing one is kept unless forced.

    The range shuffle keeps every file a run of rows, so a chunk filter skips whole files.
    """
    (
        df.withColumn("chunk_id", F.floor(F.col("row_id") / chunk_rows))
        .repartitionByRange("row_id").sortWithinPartitions("row_id")
        .write.mode("overwrite" if force else "errorifexists").parquet(path)
    )


def write_aligned(df: DataFrame, name: str, buckets: int, path: str | None = None, row_id: str = "row_id", force: bool = False) -> None:
    """A table whose rows are stored by the hash of their row id, one file per bucket.

    Keys and matrices written with the same number of buckets line up without an exchange, whatever
    their size: each bucket of one is joined with the same bucket of the other. About 128 MB of a
    matrix a bucket is a good size.
    """
    writer = df.repartition(buckets, row_id).sortWithinPartitions(row_id).write.mode("overwrite" if force else "errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, row_id).sortBy(row_id).saveAsTable(name)


def write_split(df: DataFrame, split: ChunkSplit, path: str, force: bool = False) -> None:
    """Keys and matrix rows of both sides as one table, a folder per side."""
    (
        split.attach(df).filter(F.col("side").isNotNull())
        .write.mode("overwrite" if force else "errorifexists").partitionBy("side").parquet(path)
    )


def save_stats(stats: DataFrame, path: str, force: bool = True) -> None:
    stats.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", force: bool = True) -> None:
    writer = df.write.mode("overwrite" if force else "errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"no table format {fmt!r}")
