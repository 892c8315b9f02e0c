"""Rank correlations of groups of any size, from two sorts of the whole table.

Rows are cut into slices of bounded size by their position in the whole table, never by group: a
slice holds many small groups, or part of a large one. Sorted by group, truth and prediction, each row
learns its rank in the truth and its place; sorted by group and prediction, its rank in the
prediction, and the places of a slice in that order give the slice's discordant pairs. What a group has in
other slices comes in as a carry, one record per slice.

The second sort splits a group only if it is larger than a slice. Discordant pairs across the
slices of such a group are counted on a tree over the slices, 64 branches at a time: rows sorted by
place below each node, pairs whose branches stand in descending order are counted in slices of that
order, and across them from the slices' histograms of branches. Slices stay the same size for any
number of rows; only the number of tree levels grows, with the logarithm of the number of slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import ratio
from ..session import local_table, stage

#: Rows of a slice, and those worth a task of their own.
SLICE_ROWS, TASK_ROWS = 1 << 20, 1 << 15
#: Branches below a node of the tree over slices.
BRANCHES = 64
#: Whether a row is of its slice's first or last group, and of its first or last run of equal values.
FIRST_GROUP, LAST_GROUP, FIRST_RUN, LAST_RUN = 1, 2, 4, 8


def inversions(order: np.ndarray, weight: np.ndarray) -> float:
    """Weighted pairs standing in descending order; ``order`` holds distinct numbers."""
    return float(inversions_of(order, weight, np.zeros(order.size, np.int64), 1)[0])


def inversions_of(order: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Weighted pairs standing in descending order, for each of several owners whose rows stand together.

    One stable split per bit of the rank, all owners at once. Blocks of equal higher bits stand
    where their ranks say, so a running sum inside every block counts the pairs that differ first
    in this bit.
    """
    n = order.size
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((order, owner))] = np.arange(n)
    w, total, here = weight.astype(np.float64), np.zeros(owners), np.arange(n)
    for bit in range(int(n - 1).bit_length() - 1 if n > 1 else -1, -1, -1):
        high = (rank >> bit) & 1
        start = here >> (bit + 1) << (bit + 1)
        ahead = np.cumsum(w * high) - w * high
        low = high == 0
        total += np.bincount(owner[low], weights=(w * (ahead - ahead[start]))[low], minlength=owners)
        ones = np.cumsum(high) - high
        ones -= ones[start]
        to = np.where(low, here - ones, start + (1 << bit) + ones)
        moved = [np.empty_like(x) for x in (rank, w, owner)]
        for new, old in zip(moved, (rank, w, owner)):
            new[to] = old
        rank, w, owner = moved
    return total


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; the first one does."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        a, b = column[1:], column[:-1]
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        differs = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        if pa.types.is_floating(column.type):
            both = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
            differs &= ~both.to_numpy(zero_copy_only=False)
        out[1:] |= differs
    return out


class _Slice:
    """One sorted slice: its groups, its runs of equal values, and average ranks inside the slice."""

    def __init__(self, batches: Iterable[pa.RecordBatch], keys: Sequence[str], value: str):
        held = [b for b in batches if b.num_rows]
        self.empty = not held
        if self.empty:
            return
        self.table = pa.Table.from_batches(held).combine_chunks()
        self.number = TaskContext.get().partitionId()
        n = self.table.num_rows
        new_group = _changes(self.table, keys)
        new_run = new_group | _changes(self.table, [value])
        self.groups, self.runs = np.flatnonzero(new_group), np.flatnonzero(new_run)
        self.group, run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
        self.w = self.column("_w")
        ahead = np.cumsum(self.w) - self.w
        tied = np.add.reduceat(self.w, self.runs)
        self.tied = tied[run]
        self.rank = (ahead[self.runs] - ahead[self.groups][self.group[self.runs]] + (tied + 1) / 2)[run]
        self.size = np.diff(np.append(self.groups, n))[self.group]
        self.flags = (FIRST_GROUP * (self.group == 0) + LAST_GROUP * (self.group == len(self.groups) - 1)
                      + FIRST_RUN * (run == 0) + LAST_RUN * (run == len(self.runs) - 1)).astype(np.int32)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def _in_slices(df: DataFrame, parts: int, by: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*order)


def _schema(df: DataFrame, keys: Sequence[str], **own: T.DataType) -> T.StructType:
    return T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *[T.StructField(k, t) for k, t in own.items()]])


def _emit(columns: Sequence[pa.Array], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=schema.names)


def _placed(pairs: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows with their place, and their rank in the truth as far as their slice tells it."""
    schema = _schema(pairs, keys, _y=pairs.schema["_y"].dataType, _f=pairs.schema["_f"].dataType, _w=T.LongType(), _slice=T.IntegerType(),
                     _place=T.LongType(), _rank=T.DoubleType(), _tied=T.LongType(), _size=T.LongType(), _flags=T.IntegerType())

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Slice(batches, keys, "_y")
        if s.empty:
            return
        n = s.table.num_rows
        own = [s.table.column(c).combine_chunks() for c in (*keys, "_y", "_f", "_w")]
        new = [pa.array(np.full(n, s.number), pa.int32()), pa.array((s.number << 33) + np.arange(n)), pa.array(s.rank), pa.array(s.tied),
               pa.array(s.size, pa.int64()), pa.array(s.flags)]
        yield _emit([*own, *new], schema)

    return _in_slices(pairs, parts, [*keys, "_y", "_f"], [*keys, "_y", "_f"]).mapInArrow(place, schema)


class _Edges:
    """What the groups and runs at the edges of slices have in other slices."""

    def __init__(self, rows: list, keys: list[str], value: str):
        slices: dict[int, dict] = {}
        for r in rows:
            own = slices.setdefault(r["_slice"], {b: [None, 0, 0, None] for b in (FIRST_GROUP, LAST_GROUP, FIRST_RUN, LAST_RUN)})
            for bit, edge in own.items():
                if r["_flags"] & bit:
                    edge[0] = tuple(r[k] for k in keys)
                    edge[1] += r["w"]
                    edge[2] += r["n"]
                    edge[3] = r[value] if bit in (FIRST_RUN, LAST_RUN) else None
                    edge.append(r["_flags"])
        self.numbers = sorted(slices)
        ordered = [slices[s] for s in self.numbers]
        one_group = [any(f & LAST_GROUP for f in s[FIRST_GROUP][4:]) for s in ordered]
        one_run = [any(f & LAST_RUN for f in s[FIRST_RUN][4:]) for s in ordered]
        self.group_before = self._carried(ordered, FIRST_GROUP, LAST_GROUP, one_group)
        self.run_before = self._carried(ordered, FIRST_RUN, LAST_RUN, one_run)
        self.run_after = self._carried(ordered[::-1], LAST_RUN, FIRST_RUN, one_run[::-1])[::-1]
        sizes: dict[tuple, int] = {}
        for s, whole in zip(ordered, one_group):
            for bit in (FIRST_GROUP,) if whole else (FIRST_GROUP, LAST_GROUP):
                sizes[s[bit][0]] = sizes.get(s[bit][0], 0) + s[bit][2]
        self.first_size = [sizes[s[FIRST_GROUP][0]] for s in ordered]
        self.last_size = [sizes[s[LAST_GROUP][0]] for s in ordered]

    @staticmethod
    def _carried(ordered: list[dict], near: int, far: int, whole: list[bool]) -> list[int]:
        """Weight of each slice's near edge in the slices before it."""
        out, held, name = [], 0, None
        for s, one in zip(ordered, whole):
            same = name is not None and (s[near][0], s[near][3]) == name
            out.append(held if same else 0)
            held = s[far][1] + (out[-1] if one else 0)
            name = (s[far][0], s[far][3])
        return out

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the corrections of rank and ties, and the size of each row's group, by slice and flags."""
        carries = {"_slice": self.numbers, "_group_before": self.group_before, "_run_before": self.run_before, "_run_after": self.run_after,
                   "_first_size": self.first_size, "_last_size": self.last_size}
        table = local_table(df.sparkSession, carries, {"_slice": pa.int32()} | {c: pa.int64() for c in list(carries)[1:]})
        has = lambda bit: F.col("_flags").bitwiseAND(F.lit(bit)) > 0
        part = lambda bit, name: F.when(has(bit), F.coalesce(F.col(name), F.lit(0))).otherwise(0)
        first, last = part(FIRST_RUN, "_run_before"), part(LAST_RUN, "_run_after")
        return df.join(table, "_slice", "left").withColumns({
            "_up": part(FIRST_GROUP, "_group_before") - first / 2 + last / 2,
            "_more": first + last,
            "_whole": F.when(has(FIRST_GROUP), F.col("_first_size")).when(has(LAST_GROUP), F.col("_last_size")).otherwise(F.col("_size")),
        }).drop(*list(carries)[1:])


def _edges(df: DataFrame, keys: list[str], value: str, weight: str, rows: Column) -> _Edges:
    """A few records per slice come to the driver, however many rows there are."""
    run = F.when(F.col("_flags").bitwiseAND(F.lit(FIRST_RUN | LAST_RUN)) > 0, F.col(value)).alias(value)
    found = df.filter(F.col("_flags") > 0).groupBy("_slice", "_flags", *keys, run).agg(F.sum(weight).alias("w"), rows.alias("n"))
    return _Edges(found.collect(), keys, value)


_SUMS = ("W", "WA", "WAA", "WB", "WAB", "WBB")
_COUNTS = ("TY", "TF", "WW")


def _summed(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Sums over the groups of every slice in order of the prediction, edges apart; rows of split groups as they are."""
    value = rows.schema["_f"].dataType
    own = {"_f": value, "_slice": T.IntegerType(), "_flags": T.IntegerType(), "_size": T.LongType(), "_place": T.LongType(), "_w": T.LongType()}
    schema = _schema(rows, keys, **own, **{c: T.DoubleType() for c in _SUMS}, **{c: T.LongType() for c in _COUNTS}, D=T.DoubleType())

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Slice(batches, keys, "_f")
        if s.empty:
            return
        n, w, a, b = s.table.num_rows, s.w.astype(np.float64), s.column("_rank"), s.rank
        first_run, last_run = (np.flatnonzero(s.flags & bit) for bit in (FIRST_RUN, LAST_RUN))
        starts = np.unique(np.concatenate((s.groups, [0, last_run[0]], [first_run[-1] + 1] if first_run[-1] + 1 < n else [])).astype(np.int64))
        discordant = np.zeros(len(starts))
        discordant[np.searchsorted(starts, s.groups)] = inversions_of(s.column("_place"), s.w, s.group, len(s.groups))
        sums = [np.add.reduceat(x, starts) for x in (w, w * a, w * a * a, w * b, w * a * b, w * b * b)]
        counts = [np.add.reduceat(x, starts) for x in (s.w * s.column("_tied"), s.w * s.tied, s.w * s.w)]
        rows_of = np.diff(np.append(starts, n))
        at = pa.array(starts)
        numbers = pa.array(np.full(len(starts), s.number), pa.int32())
        none = pa.nulls(len(starts), pa.int64())
        yield _emit([*[s.table.column(c).combine_chunks().take(at) for c in (*keys, "_f")], numbers, pa.array(s.flags[starts]), pa.array(rows_of, pa.int64()),
                     none, none, *map(pa.array, sums), *[pa.array(c, pa.int64()) for c in counts], pa.array(discordant)], schema)
        split = s.table.filter(s.table.column("_split"))
        if split.num_rows:
            m = split.num_rows
            nulls = lambda kind: pa.nulls(m, kind)
            yield _emit([*[split.column(c).combine_chunks() for c in keys], nulls(split.schema.field("_f").type), pa.array(np.full(m, s.number), pa.int32()),
                         nulls(pa.int32()), nulls(pa.int64()), split.column("_place").combine_chunks(), split.column("_w").combine_chunks(),
                         *[nulls(pa.float64()) for _ in _SUMS], *[nulls(pa.int64()) for _ in _COUNTS], nulls(pa.float64())], schema)

    by = [*keys, *[F.when(F.col("_split"), F.col(c)) for c in ("_f", "_place")]]
    return _in_slices(rows, parts, by, [*keys, "_f", "_place"]).mapInArrow(total, schema)


def _across(rows: DataFrame, keys: list[str], slices: int, parts: int) -> list[DataFrame]:
    """Discordant pairs of split groups across slices, one (keys, D) table per level of the tree."""
    out, width = [], 1
    while width < slices:
        below = rows.select(*keys, "_place", "_w", F.floor(F.col("_slice") / (width * BRANCHES)).cast("int").alias("_node"),
                            (F.floor(F.col("_slice") / width) % BRANCHES).cast("int").alias("_branch"))
        out.append(_level(below, [*keys, "_node"], parts).groupBy(*keys).agg(F.sum("D").alias("D")))
        width *= BRANCHES
    return out


def _level(rows: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Weighted pairs below each node whose branches descend in order of place: (names, D)."""
    branches = BRANCHES
    schema = _schema(rows, names, _slice=T.IntegerType(), D=T.DoubleType(), _held=T.ArrayType(T.DoubleType()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Slice(batches, names, "_place")
        if s.empty:
            return
        branch = s.column("_branch").astype(np.int64)
        # equal branches in order of place, so that they make no pair
        pairs = inversions_of(branch * s.table.num_rows + np.arange(s.table.num_rows), s.w, s.group, len(s.groups))
        held = np.bincount(s.group * branches + branch, weights=s.w, minlength=len(s.groups) * branches)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s.groups) + 1) * branches, pa.int32()), pa.array(held))
        yield _emit([*[s.table.column(c).combine_chunks().take(pa.array(s.groups)) for c in names],
                     pa.array(np.full(len(s.groups), s.number), pa.int32()), pa.array(pairs), lists], schema)

    order = [*names, "_place"]
    counted = stage(_in_slices(rows, parts, order, order).mapInArrow(count, schema), "level")
    held = counted.select(*names, "_slice", F.posexplode("_held").alias("_branch", "h"))
    earlier = F.sum("h").over(Window.partitionBy(*names, "_branch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("run").over(Window.partitionBy(*names, "_slice").orderBy(F.desc("_branch")).rowsBetween(Window.unboundedPreceding, -1))
    across = held.withColumn("run", F.coalesce(earlier, F.lit(0.0))).withColumn("above", F.coalesce(above, F.lit(0.0)))
    return counted.select(*names, "D").unionByName(across.select(*names, (F.col("h") * F.col("above")).alias("D")))


def rank_correlations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman's rho and Kendall's tau-b per group of ``rows`` (keys, _y, _f), both without missing values.

    Either is missing where a side is constant. Equal rows are counted first, so that no value that
    repeats stays in one task.
    """
    keys = list(keys)
    pairs = stage(rows.groupBy(*keys, "_y", "_f").agg(F.count("*").alias("_w")), "pairs")
    n = pairs.count()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(usual, math.ceil(n / TASK_ROWS)), math.ceil(n / SLICE_ROWS))
    placed = stage(_placed(pairs, keys, parts), "placed")
    first = _edges(placed, keys, "_y", "_w", F.count("*"))
    known = first.attach(placed).select(
        *keys, "_f", "_w", "_place", (F.col("_rank") + F.col("_up")).alias("_rank"), (F.col("_tied") + F.col("_more")).alias("_tied"),
        (F.col("_whole") > SLICE_ROWS).alias("_split"))
    large = n > SLICE_ROWS                # a group of one slice's size needs as many rows
    sums = _summed(known, keys, parts)
    if not large:
        parts_of, cross = sums.withColumns({"_up": F.lit(0.0), "_more": F.lit(0)}), []
    else:
        sums = stage(sums, "sums")
        totals = sums.filter(F.col("W").isNotNull())
        parts_of = _edges(totals.withColumn("w", F.col("W").cast("long")), keys, "_f", "w", F.sum("_size")).attach(totals)
        cross = _across(sums.filter(F.col("W").isNull()), keys, parts, parts)
    up, w = F.col("_up"), F.col("W")
    corrected = parts_of.select(
        *keys, "W", "WA", "WAA", (F.col("WB") + up * w).alias("WB"), (F.col("WAB") + up * F.col("WA")).alias("WAB"),
        (F.col("WBB") + 2 * up * F.col("WB") + up * up * w).alias("WBB"), "TY", (F.col("TF") + F.col("_more") * w.cast("long")).alias("TF"), "WW", "D")
    for level in cross:
        corrected = corrected.unionByName(level, allowMissingColumns=True)
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _COUNTS]
    total = corrected.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], *exact, F.sum("D").alias("D"))
    square = F.col("W").cast("decimal(19,0)") * F.col("W").cast("decimal(19,0)")
    varied = (F.col("TY") < square) & (F.col("TF") < square)
    spread = lambda x, y, xy: F.col(xy) - F.col(x) * F.col(y) / w
    tied = lambda c: (F.col(c).cast("double") - w) / 2
    all_pairs = w * (w - 1) / 2
    score = all_pairs - tied("TY") - tied("TF") + tied("WW") - 2 * F.col("D")
    rho = ratio(spread("WA", "WB", "WAB"), F.sqrt(spread("WA", "WA", "WAA")) * F.sqrt(spread("WB", "WB", "WBB")))
    tau = ratio(score, F.sqrt(all_pairs - tied("TY")) * F.sqrt(all_pairs - tied("TF")))
    return total.select(*keys, F.when(varied, rho).alias("spearman"), F.when(varied, tau).alias("kendall"))
