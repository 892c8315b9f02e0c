"""Positions, running totals, ranks and quantiles without a one-task sort.

Everything here starts from a range shuffle on the full ordering key, so a single huge group
is spread over many partitions. The sorted rows are staged together with the partition number
("slice"), because positions must stay put when a partition is recomputed. A second, small
table of per-slice totals then turns positions inside a slice into positions in the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import local_table, stage

_SLICE, _POS = "_slice", "_pos"
_IN_PARTITION = (1 << 33) - 1          # low bits of monotonically_increasing_id


def _sorted_slices(df: DataFrame, order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return stage(
        ranged.select(
            *(keep or df.columns),
            F.spark_partition_id().alias(_SLICE),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(_POS),
        ),
        "slices",
    )


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id", keep: Sequence[str] | None = None) -> DataFrame:
    """Add a dense 0-based index in ``order``; one range shuffle, no single-task window.

    ``order`` must break ties between rows that differ, or their indexes may swap. Of columns that
    serve the order only, none is stored if ``keep`` names the others.
    """
    rows = _sorted_slices(df, order, keep)
    # one record per shuffle partition, so this list stays small whatever the data size
    sizes = rows.groupBy(_SLICE).agg(F.count("*").alias("n")).orderBy(_SLICE).collect()
    ends = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    offsets = local_table(
        df.sparkSession,
        {_SLICE: [r[_SLICE] for r in sizes], "_start": [int(e) - r["n"] for e, r in zip(ends, sizes)]},
        {_SLICE: pa.int32(), "_start": pa.int64()},
    )
    return (
        rows.join(offsets, _SLICE)
        .withColumn(name, F.col("_start") + F.col(_POS))
        .drop(_SLICE, _POS, "_start")
    )


def input_row_ids(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """Parquet rows with a dense 0-based index in their own order: by file name, then as they stand.

    A file's rows know their place in it, so only the files' sizes are counted: rows are neither
    shuffled nor written. ``with_row_id`` is for any other order.
    """
    rows = spark.read.parquet(path)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = rows.select(file.alias("_file")).groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file").collect()
    ends = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    starts = local_table(
        spark, {"_file": [r["_file"] for r in sizes], "_start": [int(e) - r["n"] for e, r in zip(ends, sizes)]},
        {"_file": pa.string(), "_start": pa.int64()},
    )
    # a record per file: far below any limit of a broadcast
    placed = rows.select("*", file.alias("_file"), at.alias("_at")).join(F.broadcast(starts), "_file")
    return placed.withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    weight: str | None = None,
    before: str = "before",
    total: str = "total",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over earlier rows of the group, and over the whole group.

    Without ``weight`` rows count one each, so ``before`` is the 0-based position, which follows
    from the row's place in its slice: rows are not shuffled again.
    Rows are range-partitioned by group and order: the in-slice window sees at most one
    partition, the cross-slice window one record per (group, slice). So a group of any size takes
    the same path. ``keep`` names the columns to store, if not all.
    """
    group = list(group)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    rows = _sorted_slices(df, [*group, *order], keep)
    if weight:
        cell = Window.partitionBy(_SLICE, *group)
        ahead = F.sum(w).over(cell.orderBy(_POS).rowsBetween(Window.unboundedPreceding, -1))
        inside = rows.withColumn("_inside", F.coalesce(ahead, F.lit(0)))
    else:
        inside = rows.withColumn("_inside", F.col(_POS))         # a group's rows stand together in a slice
    across = Window.partitionBy(*group)
    parts = (
        rows.groupBy(_SLICE, *group)
        .agg(F.sum(w).alias("_part"), F.min(_POS).alias("_least"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_part").over(
                    across.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn(total, F.sum("_part").over(across))
        .drop("_part")
    )
    if weight:
        parts = parts.drop("_least")
    else:
        # staged, so that its size is known: a record per slice and group, mostly few enough to send to the rows
        parts = stage(parts.withColumn("_offset", F.col("_offset") - F.col("_least")).drop("_least"), "parts")
    return (
        inside.join(parts, [_SLICE, *group])
        .withColumn(before, F.col("_inside") + F.col("_offset"))
        .drop(_SLICE, _POS, "_inside", "_offset")
    )


def value_ranks(df: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Peer-average rank of every distinct value in its group: (group, value, rank, peers, total)."""
    counts = stage(df.groupBy(*group, value).agg(F.sum(weight).alias("peers")), "counts")
    placed = running_total(counts, group, [value], "peers")
    return placed.select(
        *group, value, "peers", "total", (F.col("before") + (F.col("peers") + 1) / 2).alias("rank")
    )


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per probability.

    Null values are left out. Values are counted first, so repeated ones collapse before the
    sort, and no task ever holds a whole group.
    """
    group = list(group)
    counts = stage(
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_peers")),
        "counts",
    )
    placed = running_total(counts, group, [value], "_peers", "_before", "_total")
    last = F.col("_before") + F.col("_peers") - 1
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        target = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(target), F.ceil(target)
        aggs += [
            F.max(F.when((F.col("_before") <= low) & (low <= last), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when((F.col("_before") <= high) & (high <= last), F.col(value))).alias(f"_hi{i}"),
            F.max(target - low).alias(f"_w{i}"),
        ]
    cut = placed.groupBy(*group).agg(*aggs)
    return cut.select(
        *group,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )


def hash_order(seed: int, *cols: str) -> Column:
    """A seeded shuffle key: the md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_cutoff(hashes: DataFrame, n: int, column: str = "h") -> str | None:
    """The n-th smallest md5 in ``column`` (None if there are fewer than ``n``).

    Rows with ``h <= cutoff`` are then a seeded sample of exactly ``n`` rows, taken by a plain
    filter. Selection narrows by hex prefix: each pass counts at most 65,536 prefixes and keeps
    one, until that holds a single hash.
    """
    if n <= 0:
        return ""
    prefix, remaining, pool = "", n, hashes.select(column)
    while True:
        width = len(prefix) + 4
        counts = (
            pool.groupBy(F.substring(column, 1, width).alias("p"))
            .agg(F.count("*").alias("n"), F.min(column).alias("least")).orderBy("p").collect()
        )
        for r in counts:
            if r["n"] >= remaining:
                break
            remaining -= r["n"]
        else:
            return None
        if r["n"] == 1 or width >= 32:
            return r["least"]
        prefix = r["p"]
        pool = pool.filter(F.col(column).startswith(prefix))
