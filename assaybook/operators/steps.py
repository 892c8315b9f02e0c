"""Prescaling steps. A recipe is the tuple of steps that it runs.

Every step fits on what the steps before it made of the train rows, and adds to one per-column
state. Fits are aggregates over all train rows; per column a handful of numbers comes back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import matrix, power
from .blocks import Shaped


@dataclass
class Columns:
    """What has been fitted so far, for the columns that still stand.

    ``keep`` are their positions in the input. A cell is filled, clipped, bent and scaled with its
    column's numbers; the defaults change nothing.
    """

    width: int
    keep: np.ndarray
    fill_low: np.ndarray
    fill_high: np.ndarray
    low: np.ndarray
    high: np.ndarray
    lam: np.ndarray                      # NaN: no power transform
    centre: np.ndarray
    spread: np.ndarray

    @classmethod
    def untouched(cls, low: np.ndarray, high: np.ndarray) -> Columns:
        n = len(low)
        return cls(n, np.arange(n), low, high, np.full(n, -np.inf), np.full(n, np.inf), np.full(n, np.nan), np.zeros(n), np.ones(n))

    def narrowed(self, standing: np.ndarray) -> Columns:
        """The state of some of the columns, given as a mask."""
        parts = {n: v[standing] for n, v in vars(self).items() if n != "width"}
        return Columns(self.width, **parts)

    def filled(self, block: np.ndarray) -> np.ndarray:
        """Kept columns with missing cells as zero and infinite ones at the column's finite limits."""
        x = np.array(block[:, self.keep], dtype=np.float64)
        for bad, value in ((np.isnan, 0.0), (np.isposinf, self.fill_high), (np.isneginf, self.fill_low)):
            x = np.where(bad(x), value, x)
        return x

    def bent(self, block: np.ndarray) -> np.ndarray:
        """Filled, clipped and power-transformed."""
        x = np.clip(self.filled(block), self.low, self.high)
        for j in np.flatnonzero(~np.isnan(self.lam)):
            x[:, j] = power.transform(x[:, j], self.lam[j])
        return x

    def scaled(self, block: np.ndarray) -> np.ndarray:
        """The whole transform; a cell that was not finite is missing."""
        known = np.isfinite(block[:, self.keep])
        return np.where(known, (self.bent(block) - self.centre) / self.spread, np.nan)

    def rows(self, df: DataFrame, raw: bool = False) -> Shaped:
        """A matrix as the steps so far leave it, or only filled; nothing is computed before it is read."""
        return Shaped(df, self.width, len(self.keep), self.filled if raw else self.bent)


@dataclass
class Fit:
    """A fit under way: its train rows, the raw column profile, the state and what was dropped."""

    train: DataFrame
    profile: dict[str, np.ndarray]
    columns: Columns
    dropped: dict[str, list[int]] = field(default_factory=dict)
    known: tuple | None = None

    def drop(self, reason: str, gone: np.ndarray) -> None:
        """Drop columns by a mask over those standing; none left is an error."""
        self.dropped[reason] = self.columns.keep[gone].tolist()
        if gone.all():
            raise ValueError(f"every column was dropped: {reason}")
        self.columns = self.columns.narrowed(~gone)

    def moments(self, raw: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
        """Train rows, and the standing columns' mean and std without a floor, as filled or as bent.

        They are kept: a step that asks again after columns were dropped, but none was changed, needs no pass.
        """
        c = self.columns
        cells = None if raw else (c.low, c.high, c.lam)
        if self.known is not None and self.known[0] == raw:
            _, keep, before, n, mean, std = self.known
            at = np.searchsorted(keep, c.keep)
            if raw or all(np.array_equal(x[at], y, equal_nan=True) for x, y in zip(before, cells)):
                return n, mean[at], std[at]
        n, mean, std = matrix.block_moments(c.rows(self.train, raw), len(c.keep), floor=False)
        self.known = raw, c.keep, cells, n, mean, std
        return n, mean, std

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the standing columns' cells as clipped, from what is known without a pass."""
        c = self.columns
        low = np.where(np.isfinite(c.fill_low), np.minimum(c.fill_low, 0.0), 0.0)           # a filled cell is zero
        return np.clip(low, c.low, c.high), np.clip(np.maximum(c.fill_high, 0.0), c.low, c.high)


@dataclass(frozen=True)
class DropInvalid:
    """Columns with too many cells that are not finite."""

    most: float = 0.2

    def fit(self, state: Fit) -> None:
        share = state.profile["invalid"][state.columns.keep] / max(1, state.profile["n_rows"].max(initial=1))
        state.drop("invalid", share > self.most)


@dataclass(frozen=True)
class ClipQuantiles:
    """Clip each column to two of its train quantiles."""

    tails: tuple[float, float] = (0.01, 0.01)

    def fit(self, state: Fit) -> None:
        rows, width = state.columns.rows(state.train), len(state.columns.keep)
        cuts = matrix.block_quantiles(rows, width, (self.tails[0], 1 - self.tails[1]), limits=state.limits())
        state.columns.low, state.columns.high = cuts


@dataclass(frozen=True)
class ClipSpread:
    """Clip each column to its train mean and some standard deviations around it."""

    factor: float = 6.0

    def fit(self, state: Fit) -> None:
        _, mean, std = state.moments(raw=True)
        std = np.where(std > 0, std, 1.0)
        state.columns.low, state.columns.high = mean - self.factor * std, mean + self.factor * std


@dataclass(frozen=True)
class DropCorrelated:
    """Of each pair of columns that move together, the later one, scanned in order."""

    most: float = 0.98

    def fit(self, state: Fit) -> None:
        width = len(state.columns.keep)
        gone = np.zeros(width, dtype=bool)
        near = np.clip(state.profile["mean"][state.columns.keep], *state.limits())
        pairs = matrix.correlation_pairs(state.columns.rows(state.train), width, self.most, near)
        gone[matrix.drop_correlated(pairs, self.most)] = True
        state.drop("correlated", gone)


@dataclass(frozen=True)
class Power:
    """Yeo-Johnson with the most likely lambda of each column."""

    def fit(self, state: Fit) -> None:
        state.columns.lam = power.fit_blocks(state.columns.rows(state.train), len(state.columns.keep), limits=state.limits())


@dataclass(frozen=True)
class DropFlat:
    """Columns without spread."""

    least: float = 1e-8

    def fit(self, state: Fit) -> None:
        n, _, std = state.moments()
        state.drop("low_variance", std**2 * (n - 1) / max(n, 1) <= self.least)


@dataclass(frozen=True)
class Scale:
    """Z-score with the train moments of what is scaled, or of the raw filled cells."""

    raw: bool = False

    def fit(self, state: Fit) -> None:
        _, mean, std = state.moments(self.raw)
        state.columns.centre, state.columns.spread = mean, np.where(std > 0, std, 1.0)


Step = DropInvalid | ClipQuantiles | ClipSpread | DropCorrelated | Power | DropFlat | Scale
Recipe = tuple[Step, ...]

ORDER_FIX: Recipe = (DropInvalid(), ClipQuantiles(), Scale())
RECIPES: dict[str, Recipe] = {
    "minimal": (DropInvalid(), Scale()),
    "order_fix": ORDER_FIX,
    "plus_drop_corr": (*ORDER_FIX[:-1], DropCorrelated(), Scale()),
    "plus_drop_low_var": (*ORDER_FIX[:-1], DropFlat(), Scale()),
    "plus_yeo_johnson": (*ORDER_FIX[:-1], Power(), Scale()),
    "full": (*ORDER_FIX[:-1], DropCorrelated(), Power(), DropFlat(), Scale()),
}


def get_recipe(name: str) -> Recipe:
    if name not in RECIPES:
        raise KeyError(f"no prescaling recipe {name!r}; there are {', '.join(RECIPES)}")
    return RECIPES[name]
