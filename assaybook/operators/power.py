"""Yeo-Johnson power transform: numpy block form, and the maximum-likelihood fit over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Shaped, scan
from .matrix import block_profile, matrix_width

_TINY = 2.220446049250313e-16


def transform(x: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson of an array at one lambda."""
    out = np.empty_like(x, dtype=np.float64)
    up = x >= 0
    pos, neg = x[up], x[~up]
    out[up] = np.log1p(pos) if abs(lam) < _TINY else np.expm1(lam * np.log1p(pos)) / lam
    rest = 2.0 - lam
    out[~up] = -np.log1p(-neg) if abs(rest) < _TINY else -np.expm1(rest * np.log1p(-neg)) / rest
    return out


def log_likelihood(x: np.ndarray, lam: float) -> float:
    """Profile log-likelihood of normality after the transform (constants dropped)."""
    with np.errstate(all="ignore"):
        variance = transform(x, lam).var()
    if not np.isfinite(variance) or variance < np.finfo(float).tiny:
        return -np.inf
    return float(
        -0.5 * x.size * np.log(variance) + (lam - 1.0) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    )


def _safe_range(x: np.ndarray) -> tuple[float, float]:
    """Lambdas that keep the transformed data inside half of the exponent range."""
    reach = max(np.log1p(20.0 * np.abs(x).max()), 1e-3)
    info = np.finfo(float)
    low = (np.log(info.tiny) - np.log(info.eps)) / 2 / reach
    high = (np.log(info.max) + np.log(info.eps)) / 2 / reach
    if (x < 0).all():
        return 2 - high, 2 - low
    if (x < 0).any():
        return max(2 - high, low), min(2 - low, high)
    return low, high


#: Lambdas that the first pass looks at, steps that settle a column, and passes after which the bracket has to do.
STARTS = (-2.0, 0.0, 1.0, 2.0, 4.0)
SETTLED, PASSES = 1e-4, 60
_STATISTICS = ("n", "m0", "m1", "m2", "c00", "c01", "c11", "c02", "logs")


def _growth(t: np.ndarray, u: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """g = (exp(lam u) - 1) / lam and its first two derivatives in lam, where t = lam u."""
    with np.errstate(all="ignore"):
        e = np.exp(t)
        g0 = np.expm1(t) / lam
        g1 = (u * e - g0) / lam
        g2 = (u * u * e - 2 * g1) / lam
    near = np.abs(t) < 0.1
    if near.any():
        # the quotients lose their digits near zero; their series in t does not
        s, v = t[near], u[near]
        s0, s1, s2, power, factorial = np.zeros_like(s), np.zeros_like(s), np.zeros_like(s), np.ones_like(s), 1.0
        for k in range(12):
            factorial *= k + 1                                   # (k + 1)!
            s0 += power / factorial
            s1 += power * (k + 1) / (factorial * (k + 2))
            s2 += power * (k + 1) * (k + 2) / (factorial * (k + 2) * (k + 3))
            power = power * s
        g0[near], g1[near], g2[near] = v * s0, v * v * s1, v ** 3 * s2
    return g0, g1, g2


def derivatives(x: np.ndarray, u: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of every column at its lambda, and its first two derivatives; ``u`` is log1p(|x|)."""
    up = x >= 0
    own = np.where(up, lam, 2.0 - lam)
    own = np.where(np.abs(own) < _TINY, _TINY, own)
    g0, g1, g2 = _growth(own * u, u, own)
    return np.where(up, g0, -g0), g1, np.where(up, g2, -g2)


def _moments_at(grid: np.ndarray, block: Callable[[pa.Array], np.ndarray]):
    """Per column and lambda: cells, means and products of the transform and its derivatives, and the log sum."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_STATISTICS), *grid.shape))
        for batch in batches:
            x = block(batch.column(0))
            good = ~np.isnan(x)
            n = good.sum(axis=0).astype(np.float64)
            x = np.where(good, x, 0.0)
            u = np.log1p(np.abs(x))
            logs = np.where(good, np.sign(x) * u, 0.0).sum(axis=0)
            for k in range(grid.shape[1]):
                parts = [np.where(good, d, 0.0) for d in derivatives(x, u, grid[:, k])]
                with np.errstate(all="ignore"):
                    means = [d.sum(axis=0) / np.maximum(n, 1) for d in parts]
                    off = [np.where(good, d - m, 0.0) for d, m in zip(parts, means)]
                    products = [np.einsum("ij,ij->j", off[a], off[b]) for a, b in ((0, 0), (0, 1), (1, 1), (0, 2))]
                    total[:, :, k] = _combined(total[:, :, k], np.stack([n, *means, *products, logs]))
        j, k = np.indices(grid.shape)
        columns = [j.ravel().astype(np.int32), k.ravel().astype(np.int32), *total.reshape(len(_STATISTICS), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["j", "k", *_STATISTICS])

    return score


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Statistics of two sets of cells as those of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = b[1:4] - a[1:4]
    out = a + b
    out[1:4] = a[1:4] + gap * share
    for row, (p, q) in zip((4, 5, 6, 7), ((0, 0), (0, 1), (1, 1), (0, 2))):
        out[row] += gap[p] * gap[q] * a[0] * share
    return out


def _likelihoods(rows: DataFrame, block: Callable[[pa.Array], np.ndarray], grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and its first two derivatives, for each column at each of its lambdas: one pass."""
    schema = "j int, k int, " + ", ".join(f"{s} double" for s in _STATISTICS)
    sent = rows.mapInArrow(_moments_at(grid, block), schema).filter("n > 0")
    struct = F.struct(*[F.lit(0.0).alias(s) for s in _STATISTICS[:-1]])

    def add(a: Column, p: Column) -> Column:
        n = a["n"] + p["n"]
        gap = [p[f"m{i}"] - a[f"m{i}"] for i in range(3)]
        means = [(a[f"m{i}"] + gap[i] * p["n"] / n).alias(f"m{i}") for i in range(3)]
        products = [(a[f"c{i}{j}"] + p[f"c{i}{j}"] + gap[i] * gap[j] * a["n"] * p["n"] / n).alias(f"c{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1), (0, 2))]
        return F.struct(n.alias("n"), *means, *products)

    merged = sent.groupBy("j", "k").agg(
        F.aggregate(F.sort_array(F.collect_list(F.struct(*_STATISTICS[:-1]))), struct, add).alias("s"), F.sum("logs").alias("logs")
    ).select("j", "k", "s.*", "logs").toArrow()
    out = np.full((3, *grid.shape), np.nan)
    out[0] = -np.inf
    j, k = merged["j"].to_numpy(), merged["k"].to_numpy()
    n, c00, c01, c11, c02, logs = (merged[c].to_numpy() for c in ("n", "c00", "c01", "c11", "c02", "logs"))
    with np.errstate(all="ignore"):
        value = -0.5 * n * np.log(c00 / n) + (grid[j, k] - 1.0) * logs
        slope = -n * c01 / c00 + logs
        curve = -n * (c11 + c02) / c00 + 2 * n * (c01 / c00) ** 2
        usable = np.isfinite(value) & np.isfinite(slope) & np.isfinite(curve) & (c00 / n >= np.finfo(float).tiny)
    for held, new in zip(out, (value, slope, curve)):
        held[j[usable], k[usable]] = new[usable]
    return out[0], out[1], out[2]


def fit_blocks(df: DataFrame | Shaped, width: int, features: str = "features", limits: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Most likely lambda of each column over all rows, NaN for a column without spread.

    The first pass looks at a few lambdas per column, every later one at a single lambda: a Newton
    step from the best one, by derivatives summed where the rows are. The sign of the slope narrows a
    bracket, and a step that leaves it halves the bracket instead. ``limits`` are the columns' smallest and
    largest cells, where they are known.
    """
    rows, block = scan(df, width, features)
    if limits is None:
        profile = block_profile(df, width)
        limits = profile["low"], profile["high"]
    low, high = limits
    spread = np.isfinite(low) & (high > low)
    if not spread.any():
        return np.full(width, np.nan)
    ranges = [_safe_range(np.array([a, b])) if ok else (0.0, 1.0) for a, b, ok in zip(low, high, spread)]
    bottom, top = np.array([max(a, -6.0) for a, _ in ranges]), np.array([min(b, 8.0) for _, b in ranges])
    grid = np.clip(np.array(STARTS)[None, :], bottom[:, None], top[:, None])
    at, best, lam = np.arange(width), np.full(width, -np.inf), np.ones(width)
    open_ = spread.copy()
    for _ in range(PASSES):
        value, slope, curve = _likelihoods(rows, block, grid)
        rising = np.where(slope > 0, grid, -np.inf).max(axis=1)
        falling = np.where(slope <= 0, grid, np.inf).min(axis=1)
        bottom, top = np.maximum(bottom, rising), np.minimum(top, falling)
        k = value.argmax(axis=1)
        here = grid[at, k]
        with np.errstate(all="ignore"):
            step = -slope[at, k] / curve[at, k]
            newton = here + step
        halved = (bottom + top) / 2
        inside = np.isfinite(newton) & (curve[at, k] < 0) & (newton > bottom) & (newton < top)
        nearer = np.where(inside, newton, halved)
        better = value[at, k] >= best
        # a Newton step this short leaves an error of its square; a bracket this short has nothing left
        done = (inside & (np.abs(step) < SETTLED)) | (top - bottom < 1e-9)
        lam = np.where(open_ & np.isfinite(value[at, k]), nearer, lam)
        best = np.where(better, value[at, k], best)
        open_ &= ~done
        if not open_.any():
            break
        grid = np.where(open_, lam, here)[:, None]
    return np.where(spread & np.isfinite(best), lam, np.nan)


def fit_yeo_johnson(df: DataFrame) -> DataFrame:
    """Lambda per column over all rows: (col_id, lam)."""
    width = matrix_width(df) or 0
    rows = [(j, None if np.isnan(v) else float(v)) for j, v in enumerate(fit_blocks(df, width))] if width else []
    return df.sparkSession.createDataFrame(rows, "col_id int, lam double")
