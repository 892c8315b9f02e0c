"""Column profiles, moments, percentiles, correlations and cell transforms of a matrix.

A matrix is ``(row_id, features array<double>)`` of one fixed width. Per-column statistics are
reduced in numpy blocks inside the tasks; a shuffle carries one record per (task, column), or a
count per (column, digit), whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import as_cell, is_finite
from ..session import local_table, stage
from .blocks import Shaped, from_block, scan, to_block


def to_matrix(df: DataFrame, columns: Sequence[str | Column], *keep: str) -> DataFrame:
    """Scalar columns -> one features array, NaN turned into missing."""
    parts = [as_cell(F.col(c) if isinstance(c, str) else c) for c in columns]
    return df.select(*keep, F.array(*parts).alias("features"))


def matrix_width(df: DataFrame, features: str = "features") -> int | None:
    """Width of a row; later readers fail on rows of another width. None without rows."""
    row = df.filter(F.col(features).isNotNull()).select(F.size(features)).first()
    return row[0] if row else None


def failure_counts(df: DataFrame, width: int, features: str = "features") -> tuple[DataFrame, Observation]:
    """Count rows, failed rows and rows of a wrong width on whatever pass reads the result."""
    seen = Observation()
    f = F.col(features)
    return (
        df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(cells.row_failed(f)).alias("failed"),
            F.count_if(F.size(f) != width).alias("malformed"),
        ),
        seen,
    )


# ---------------------------------------------------------------- per-column statistics

@dataclass
class _Tally:
    """Per-column statistics of the rows a task has seen, merged block by block."""

    rows: int
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> _Tally:
        """Of one block; cells that are not finite are left out."""
        good = np.isfinite(x)
        n = good.sum(axis=0)
        mean = np.where(good, x, 0.0).sum(axis=0) / np.maximum(n, 1)
        off = np.where(good, x - mean, 0.0)
        return cls(
            len(x), n, mean, (off * off).sum(axis=0),
            np.where(good, x, np.inf).min(axis=0, initial=np.inf), np.where(good, x, -np.inf).max(axis=0, initial=-np.inf),
        )

    def add(self, other: _Tally) -> _Tally:
        n = self.n + other.n
        gap, share = other.mean - self.mean, other.n / np.maximum(n, 1)
        return _Tally(
            self.rows + other.rows, n, self.mean + gap * share, self.m2 + other.m2 + gap * gap * self.n * share,
            np.minimum(self.low, other.low), np.maximum(self.high, other.high),
        )


_TALLY = "rows long, col_id int, n long, mean double, m2 double, low double, high double"


def column_tallies(df: DataFrame | Shaped, features: str = "features", width: int | None = None) -> DataFrame:
    """Rows, finite cells, mean, squared deviations and limits per column: one record a column.

    Tasks reduce their rows in numpy blocks, so a record per (task, column) is shuffled and a
    matrix row is never taken apart into cells.
    """
    width = (matrix_width(df, features) or 0) if width is None else width
    rows, block = scan(df, width, features)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = _Tally.of(block(batch.column(0)))
                total = own if total is None else total.add(own)
        if total is not None:
            columns = [np.full(width, total.rows), np.arange(width, dtype=np.int32), total.n, total.mean, total.m2, total.low, total.high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rows", "col_id", "n", "mean", "m2", "low", "high"])

    parts = rows.mapInArrow(reduce, _TALLY)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, p: Column) -> Column:
        n = a["n"] + p["n"]
        gap, share = p["mean"] - a["mean"], p["n"] / F.greatest(n, F.lit(1))
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + p["m2"] + gap * gap * a["n"] * share).alias("m2"))

    merged = parts.groupBy("col_id").agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.aggregate(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))), start, add).alias("s"),
    )
    return merged.select("col_id", "rows", "low", "high", "s.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """Finite min and max, rows and invalid cells of every column."""
    limit = lambda c: F.when(F.col("n") > 0, F.col(c))
    return column_tallies(df).select(
        "col_id", limit("low").alias("col_min"), limit("high").alias("col_max"),
        (F.col("rows") - F.col("n")).alias("invalid"), F.col("rows").alias("n_rows"),
    )


def block_profile(df: DataFrame | Shaped, width: int | None = None) -> dict[str, np.ndarray]:
    """The column profile as arrays; a column without a finite cell has infinite limits."""
    t = column_tallies(df, width=width).orderBy("col_id").toArrow()
    rows, n = t["rows"].to_numpy(), t["n"].to_numpy()
    return {"low": t["low"].to_numpy(), "high": t["high"].to_numpy(), "mean": t["mean"].to_numpy(), "invalid": rows - n, "n_rows": rows}


def block_moments(df: DataFrame | Shaped, width: int, floor: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample std of each column; with ``floor`` a std of zero counts as one."""
    t = column_tallies(df, width=width).orderBy("col_id").toArrow()
    if not len(t):
        return 0, np.zeros(width), np.ones(width)
    n = t["n"].to_numpy()
    std = np.sqrt(np.maximum(t["m2"].to_numpy(), 0.0) / np.maximum(n - 1, 1))
    # what is left of a constant column is the rounding of its own mean
    std = np.where(std <= 1e-12 * np.abs(t["mean"].to_numpy()), 0.0, std)
    return int(n.max()), t["mean"].to_numpy(), np.where(std > 0, std, 1.0) if floor else std


def invalid_columns(profile: DataFrame, max_fraction: float = 0.2) -> DataFrame:
    """Columns to drop: too many invalid cells, or no finite cell at all."""
    return profile.filter(
        (F.col("invalid") / F.col("n_rows") > max_fraction) | F.col("col_min").isNull()
    ).select("col_id")


def masked_moments(df: DataFrame) -> DataFrame:
    """Count, mean and sample std of the finite cells only; std is missing below two cells."""
    return column_tallies(df).select(
        "col_id", "n", F.when(F.col("n") > 0, F.col("mean")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
    )


def imputed_moments(df: DataFrame) -> DataFrame:
    """Count, mean and sample std of cleaned cells, where a missing cell counts as its zero.

    Unlike the masked moments, the divisor is all rows. Std is one where the variance is zero.
    """
    std = F.sqrt(F.col("m2") / (F.col("n") - 1))
    flat = (F.col("n") < 2) | (std <= 1e-12 * F.abs("mean"))
    return column_tallies(df).select("col_id", "n", "mean", F.when(flat, F.lit(1.0)).otherwise(std).alias("std"))


#: Gram matrices: columns of a tile, rows per column of a partial sum at least, and tiles added up at once.
TILE, GRAM_ROWS, GRAM_FAN = 512, 16, 32
#: Close pairs of columns that one process scans.
LAST_PAIRS = 1 << 18
_SIGN = np.uint64(1) << np.uint64(63)
#: Cells a bracket may hold when they are fetched.
FETCHED = 2048


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(key: np.ndarray) -> np.ndarray:
    return np.where(key & _SIGN, key ^ _SIGN, ~key).view(np.float64)


def _signed(keys: np.ndarray) -> np.ndarray:
    """Unsigned keys as signed numbers in the same order, which SQL can compare."""
    return (keys ^ _SIGN).view(np.int64)


def _digits(low: np.ndarray, shift: np.ndarray, bins: int, block: Callable[[pa.Array], np.ndarray]):
    """Cells per column, bracket and part of the bracket, and their limits: what one narrowing pass sends.

    Bracket k of column j holds the keys from ``low[j, k]`` on, in parts of 2 to the ``shift[j, k]`` keys.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*low.shape, bins), dtype=np.int64)
        first, last = np.full(total.shape, ~np.uint64(0)), np.zeros(total.shape, dtype=np.uint64)
        for batch in batches:
            x = block(batch.column(0))
            keys, good = _ordered(x), np.isfinite(x)
            for j in range(low.shape[0]):
                own = keys[good[:, j], j]
                for k in range(low.shape[1]):
                    if k and low[j, k] == low[j, k - 1] and shift[j, k] == shift[j, k - 1]:
                        continue                                  # the same bracket as the one before
                    inside = own[own >= low[j, k]]
                    part = (inside - low[j, k]) >> shift[j, k]
                    inside, part = inside[part < bins], part[part < bins].astype(np.int64)
                    total[j, k] += np.bincount(part, minlength=bins)
                    np.minimum.at(first[j, k], part, inside)
                    np.maximum.at(last[j, k], part, inside)
        at = np.nonzero(total)
        j, k, d = (i.astype(np.int32) for i in at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (j, k, d, total[at], _signed(first[at]), _signed(last[at]))], names=["j", "k", "d", "n", "first", "last"])

    return count


def _inside(low: np.ndarray, high: np.ndarray, block: Callable[[pa.Array], np.ndarray]):
    """The cells of each bracket, once brackets are small."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch.column(0))
            keys, good = _ordered(x), np.isfinite(x)
            sent: list[tuple[int, int, list[float]]] = []
            for j in range(low.shape[0]):
                own = keys[good[:, j], j]
                for k in range(low.shape[1]):
                    if k and low[j, k] == low[j, k - 1] and high[j, k] == high[j, k - 1]:
                        continue
                    held = own[(own >= low[j, k]) & (own <= high[j, k])]
                    if len(held):
                        sent.append((j, k, _value(held).tolist()))
            if sent:
                columns = zip(*sent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["j", "k", "held"])

    return fetch


def block_quantiles(
    df: DataFrame | Shaped, width: int, probs: Sequence[float], features: str = "features", limits: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Exact interpolated quantiles of each column's finite cells over all rows: (probs, width).

    Cells are never shuffled. Between a column's limits, doubles are numbered in their order; each
    pass counts the cells in equal parts of the bracket around every wanted rank and narrows it to
    the limits of the cells in one part; brackets that hold few cells are fetched, those of one number
    need no more. As a pass shortens a bracket by the number of parts, there are six at most with 4096
    parts, and hardly more than one on most data.
    ``limits`` are bounds of the columns' cells, where they are known without a pass.
    """
    if not width:
        return np.full((len(probs), 0), np.nan)
    rows, block = scan(df, width, features)
    if limits is None:
        t = column_tallies(df, features, width).orderBy("col_id").toArrow()
        if not len(t):
            return np.full((len(probs), width), np.nan)
        limits = t["low"].to_numpy(), t["high"].to_numpy()
    # the floor and the ceiling of a rank stand side by side: as a rule they share a bracket
    shape = (width, 2 * len(probs))
    bins = 1 << max(4, min(12, int(math.log2((1 << 22) / (width * shape[1])))))
    bounded = limits[0] <= limits[1]
    low, high = (np.repeat(_ordered(np.where(bounded, x, 0.0))[:, None], shape[1], axis=1) for x in limits)
    n = rank = size = None
    while n is None or ((size > FETCHED) & (high > low)).any():
        spans = (high - low).astype(object)
        shift = np.array([[max(0, int(w).bit_length() - bins.bit_length() + 1) for w in row] for row in spans], dtype=np.uint64)
        sent = rows.mapInArrow(_digits(low, shift, bins, block), "j int, k int, d int, n long, first long, last long")
        got = sent.groupBy("j", "k", "d").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).toArrow()
        counts, first, last = (np.zeros((*shape, bins), dtype=np.int64) for _ in range(3))
        for held, name in ((counts, "n"), (first, "first"), (last, "last")):
            held[got["j"].to_numpy(), got["k"].to_numpy(), got["d"].to_numpy()] = got[name].to_numpy()
        for k in range(1, shape[1]):
            same = (low[:, k] == low[:, k - 1]) & (shift[:, k] == shift[:, k - 1])
            for held in (counts, first, last):
                held[same, k] = held[same, k - 1]
        if n is None:
            n = counts[:, 0].sum(axis=1)
            target = np.array([[p * (m - 1) for p in probs] for m in np.maximum(n, 1)])          # (width, probs)
            rank = np.stack((np.floor(target), np.ceil(target)), axis=2).reshape(shape).astype(np.int64)
            size = np.repeat(n[:, None], shape[1], axis=1)
        upto = counts.cumsum(axis=2)
        part = (upto <= rank[:, :, None]).sum(axis=2).clip(max=bins - 1)
        at = (*np.indices(shape), part)
        narrowed = (n > 0)[:, None] & (high > low)
        rank = np.where(narrowed, rank - (upto[at] - counts[at]), rank)
        size = np.where(narrowed, counts[at], size)
        low, high = (np.where(narrowed, held[at].view(np.uint64) ^ _SIGN, x) for held, x in ((first, low), (last, high)))
    known = np.repeat((n > 0)[:, None], shape[1], axis=1)
    found = np.full(shape, np.nan)
    alike = known & (high == low)                      # nothing but copies of one number
    found[alike] = _value(low[alike])
    wanted = known & ~alike
    if wanted.any():
        # a bracket of one number, or of none, asks for nothing
        asked = np.where(wanted, low, np.uint64(1)), np.where(wanted, high, np.uint64(0))
        fetched = rows.mapInArrow(_inside(*asked, block), "j int, k int, held array<double>")
        told = fetched.groupBy("j", "k").agg(F.sort_array(F.flatten(F.collect_list("held"))).alias("held")).toArrow()
        cells = {(j, k): held for j, k, held in zip(told["j"].to_pylist(), told["k"].to_pylist(), told["held"].to_pylist())}
        for j, k in np.argwhere(wanted).tolist():
            own = k
            while (j, own) not in cells:               # sent once for brackets that are the same
                own -= 1
            found[j, k] = cells[j, own][rank[j, k]]
    pairs = found.reshape(width, len(probs), 2)
    value = pairs[:, :, 0] + (pairs[:, :, 1] - pairs[:, :, 0]) * (target - np.floor(target))
    return np.where(n[:, None] > 0, value, np.nan).T


def percentiles(df: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per column over all rows, as one array."""
    width = matrix_width(df) or 0
    cuts = block_quantiles(df, width, [float(p) for p in probs])
    rows = [(j, [None if np.isnan(v) else float(v) for v in cuts[:, j]]) for j in range(width)]
    return df.sparkSession.createDataFrame(rows, "col_id int, percentiles array<double>")


def low_variance_columns(df: DataFrame, min_variance: float = 1e-8) -> DataFrame:
    return (
        column_tallies(df).select("col_id", (F.col("m2") / F.col("n")).alias("variance"))
        .filter(F.col("variance") <= min_variance)
    )


# ---------------------------------------------------------------- cell transforms in SQL

#: Columns up to which a transform names each cell, which Spark compiles; a lambda is interpreted cell by cell.
NAMED_CELLS = 64


def _per_column(values: Sequence[float | None]) -> Column:
    return F.array(*[_lit(v) for v in values])


def _lit(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _named(rows: Sequence[Column], width: int, cell: Callable[..., Column]) -> Column:
    """``cell(i, *cells)`` of every column i < ``width``; a longer row's other cells come out missing, a shorter row stays short."""
    out = F.array(*[cell(i, *[F.get(r, F.lit(i)) for r in rows]) for i in range(width)])
    known = reduce(Column.__and__, [r.isNotNull() for r in rows])
    size = F.size(rows[0]) if len(rows) == 1 else F.greatest(*[F.size(r) for r in rows])
    other = F.slice(F.concat(out, F.array_repeat(_lit(None), size - width)), F.lit(1), size)
    return F.when(known & (size == width), out).when(known, other)


def select_columns(df: DataFrame, index: Sequence[int]) -> DataFrame:
    """Gather columns by position."""
    at = F.array(*[F.lit(int(i)) for i in index])
    return df.withColumn("features", F.transform(at, lambda i: F.get("features", i)))


def clean_cells(df: DataFrame, lowest: Sequence[float], highest: Sequence[float]) -> DataFrame:
    """Missing -> 0, +inf -> the column's largest finite value, -inf -> the smallest."""
    lo, hi = _per_column(lowest), _per_column(highest)

    def clean(x: Column, i: Column) -> Column:
        return (
            F.when(x.isNull() | F.isnan(x), F.lit(0.0))
            .when(x == float("inf"), F.get(hi, i))
            .when(x == float("-inf"), F.get(lo, i))
            .otherwise(x)
        )

    return df.withColumn("features", F.transform("features", clean))


def clip_columns(df: DataFrame, lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
    lo, hi = _per_column(lower), _per_column(upper)
    return df.withColumn(
        "features", F.transform("features", lambda x, i: cells.clip(x, F.get(lo, i), F.get(hi, i)))
    )


def zscore_columns(
    df: DataFrame, mean: Sequence[float], std: Sequence[float], floor_std: bool = True
) -> DataFrame:
    if 0 < len(mean) <= NAMED_CELLS:
        scaled = _named([F.col("features")], len(mean), lambda i, x: cells.zscore(x, _lit(mean[i]), _lit(std[i]), floor_std))
    else:
        m, s = _per_column(mean), _per_column(std)
        scaled = F.transform("features", lambda x, i: cells.zscore(x, F.get(m, i), F.get(s, i), floor_std))
    return df.withColumn("features", scaled)


def rescatter_missing(raw: Column, scaled: Column, width: int | None = None) -> Column:
    """Blank every scaled cell whose raw cell was not finite. ``width``, where the caller knows it, only makes it faster."""
    if width and width <= NAMED_CELLS:
        return _named([raw, scaled], width, lambda i, r, s: F.when(is_finite(r), s))
    return F.zip_with(raw, scaled, lambda r, s: F.when(is_finite(r), s))


# ---------------------------------------------------------------- Gram matrices and correlation

def gram_tiles(
    df: DataFrame | Shaped, width: int, shift: np.ndarray, scale: np.ndarray, rows: int | None = None, features: str = "features", ones: bool = False
) -> DataFrame:
    """Square tiles of Z'Z for Z = (X - shift) / scale, missing cells as zero: (a, b, tile), a <= b.

    With ``ones`` Z has one more column, of ones, so that the same pass gives the rows and the columns' sums.

    Only the tiles on and above the diagonal are made. Input splits are merged without a shuffle into
    as many partial sums as there are cores, or fewer where that would be less than ``GRAM_ROWS`` rows
    per column each (``rows`` says how many there are). So what is shuffled does not depend
    on the number of splits. Partial sums are added along a tree, a few tiles at a time.
    """
    source, block = scan(df, width, features)
    parts = source.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(1, min(parts, -(-rows // (GRAM_ROWS * max(width, 1)))))
    cuts = [slice(k, min(k + TILE, width + ones)) for k in range(0, width + ones, TILE)]
    wanted = [(a, b) for a in range(len(cuts)) for b in range(a, len(cuts))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (np.nan_to_num(block(batch.column(0)), nan=0.0, posinf=0.0, neginf=0.0) - shift) / scale
            if ones:
                z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
            own = (z[:, cuts[a]].T @ z[:, cuts[b]] for a, b in wanted)
            sums = list(own) if sums is None else [s + t for s, t in zip(sums, own)]
        for (a, b), total in zip(wanted, sums or []):
            yield _tile(a, b, total.ravel())

    def merge(held: pa.Table) -> pa.Table:
        total = np.zeros(len(held["tile"][0]))
        for chunk in held["tile"].chunks:
            total += to_block(chunk, len(total)).sum(axis=0)
        return pa.Table.from_batches([_tile(held["a"][0].as_py(), held["b"][0].as_py(), total)])

    schema = "a int, b int, tile array<double>"
    tiles = source.coalesce(parts).mapInArrow(partial, schema).withColumn("part", F.spark_partition_id())
    while True:
        part = F.floor(F.col("part") / GRAM_FAN).cast("int")
        tiles = tiles.select("a", "b", "tile", part.alias("g")).groupBy("a", "b", "g").applyInArrow(
            lambda key, held: merge(held).append_column("part", pa.array([key[2].as_py()], pa.int32())), schema + ", part int")
        parts = -(-parts // GRAM_FAN)
        if parts == 1:
            return tiles.drop("part")


def _tile(a: int, b: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), from_block(cells[None])], names=["a", "b", "tile"])


def _tile_cells(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and cells of every tile of a batch."""
    for a, b, cells in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tile")):
        rows = min(TILE, width - a * TILE)
        yield a * TILE, b * TILE, cells.values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def gram_matrix(tiles: DataFrame, width: int) -> np.ndarray:
    """The whole matrix on the driver, whose size is the square of the width."""
    out = np.zeros((width, width))
    for batch in tiles.toArrow().to_batches():
        for i, j, cells in _tile_cells(batch, width):
            out[i : i + cells.shape[0], j : j + cells.shape[1]] = cells
            out[j : j + cells.shape[1], i : i + cells.shape[0]] = cells.T
    return out


def correlation_pairs(df: DataFrame | Shaped, width: int, above: float | None = None, near: np.ndarray | None = None) -> DataFrame:
    """Pearson correlation of column pairs i < j over all rows: (i, j, r); a cell that is not finite counts as zero.

    With ``above`` only pairs whose correlation is beyond it leave their tile; matrices of some thousand
    columns need it. A near-constant column has correlations of zero. ``near`` holds a number near each column's
    mean; with it the rows are read once, as one pass gives products and sums. Without it a pass finds the means.
    """
    if near is None:
        near = block_moments(df, width)[1]
    tiles = stage(gram_tiles(df, width, near, np.ones(width), ones=True), "gram")
    last = width // TILE                                  # where the column of ones is
    sums, squares = np.zeros(width + 1), np.zeros(width + 1)
    for batch in tiles.filter((F.col("a") == F.col("b")) | (F.col("b") == last)).toArrow().to_batches():
        for i, j, cells in _tile_cells(batch, width + 1):
            if j == last * TILE:
                sums[i : i + len(cells)] = cells[:, -1]
            if i == j:
                squares[i : i + len(cells)] = np.diagonal(cells)
    n, off = max(sums[-1], 1.0), sums[:-1] / max(sums[-1], 1.0)
    spread = squares[:-1] - n * off * off
    deviation = np.where(spread / max(n - 1, 1) > 1e-12, np.sqrt(np.maximum(spread, 0.0)), 0.0)
    # what is left of a constant column is the rounding of its own mean
    deviation = np.where(deviation <= 1e-12 * np.abs(near + off) * np.sqrt(n), 0.0, deviation)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, cells in _tile_cells(batch, width + 1):
                rows, columns = (np.arange(k, min(k + m, width)) for k, m in zip((i, j), cells.shape))
                products = cells[: len(rows), : len(columns)] - n * off[rows][:, None] * off[columns][None]
                norm = deviation[rows][:, None] * deviation[columns][None]
                r = np.clip(np.divide(products, norm, out=np.zeros(norm.shape), where=norm > 0), -1.0, 1.0)
                wanted = (columns[None] > rows[:, None]) & (True if above is None else np.abs(r) > above)
                at = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[at[0]].astype(np.int32)), pa.array(columns[at[1]].astype(np.int32)), pa.array(r[at])], names=["i", "j", "r"])

    return tiles.mapInArrow(pairs, "i int, j int, r double")


def drop_correlated(pairs: DataFrame, threshold: float = 0.98) -> list[int]:
    """Columns to drop: of each pair above the threshold in order, the later one if both still stand.

    What stays is the lexicographically first set of columns without a close pair. It is found in rounds: a
    column with no earlier neighbour in doubt stays and takes its neighbours, all such columns at
    once. Pairs stay distributed; a round brings back names of columns, and once at most
    ``LAST_PAIRS`` pairs are in doubt, those are scanned.
    """
    spark = pairs.sparkSession
    close = stage(pairs.filter(F.abs("r") > threshold).select("i", "j"), "close")
    gone: set[int] = set()
    columns = lambda df: [r[0] for r in df.collect()]  # noqa: E731 - at most one per matrix column
    listed = lambda name, which: local_table(spark, {name: sorted(which)}, {name: pa.int32()})
    while close.count() > LAST_PAIRS:
        stays = columns(close.select("i").distinct().join(close.select(F.col("j").alias("i")).distinct(), "i", "left_anti"))
        taken = set(columns(close.join(listed("i", stays), "i", "left_semi").select("j").distinct()))
        gone |= taken
        decided = taken.union(stays)
        close = stage(close.join(listed("i", decided), "i", "left_anti").join(listed("j", decided), "j", "left_anti"), "close")
    rest = close.toArrow()
    for i, j in sorted(zip(rest["i"].to_pylist(), rest["j"].to_pylist())):
        if i not in gone and j not in gone:
            gone.add(j)
    return sorted(gone)


def align(keys: DataFrame, matrix: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Join keys to their matrix rows; both must index the same rows, 0..n-1.

    Each side's ids must run from zero without a gap or a repeat: as many rows as the last id
    says, and no id twice. The second test groups by the id that the join shuffles by anyway.
    """
    id_ = F.col(row_id)
    sums = F.count("*").alias("n"), F.min(id_).alias("first"), F.max(id_).alias("last"), F.count(id_).alias("named")
    k, m = keys.agg(*sums).first(), matrix.agg(*sums).first()
    for side, df, s in (("keys", keys, k), ("matrix", matrix, m)):
        dense = not s["n"] or (s["named"] == s["n"] and s["first"] == 0 and s["last"] == s["n"] - 1)
        if not dense or not df.groupBy(row_id).count().filter("count > 1").isEmpty():
            raise ValueError(f"{side}: {row_id} is not a dense index over {s['n']} rows")
    if k["n"] != m["n"]:
        raise ValueError(f"{k['n']} keys do not line up with {m['n']} matrix rows")
    return keys.join(matrix, row_id)
