"""Prescaling: fit a recipe's steps on all train rows, transform every row in one narrow pass."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEGACY_STD_FACTOR
from . import matrix
from .blocks import map_blocks
from .splits import ChunkSplit
from .steps import Columns, Fit, Recipe


@dataclass
class PrescaleModel:
    """A fitted recipe. All of it is per-column state, so it is small next to any matrix."""

    name: str
    recipe: Recipe
    columns: Columns
    dropped: dict[str, list[int]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale every row; cells not finite on the way in are missing on the way out."""
        return map_blocks(df, self.columns.scaled, self.columns.width)

    def gone(self, reason: str) -> list[int]:
        """The input positions that a step dropped: invalid, correlated or low_variance."""
        return self.dropped.get(reason, [])

    def summary(self, spark) -> DataFrame:
        """One row: columns in and out, what each step dropped, and the steps."""
        steps = [{type(step).__name__: asdict(step)} for step in self.recipe]
        row = (
            self.name, self.columns.width, len(self.columns.keep),
            self.gone("invalid"), self.gone("correlated"), self.gone("low_variance"), json.dumps(steps),
        )
        return spark.createDataFrame(
            [row],
            "name string, n_cols_in int, n_cols_out int, dropped_invalid array<int>, "
            "dropped_correlated array<int>, dropped_low_variance array<int>, recipe string",
        )

    def column_stats(self, spark) -> DataFrame:
        """One row per kept column with every fitted number."""
        c = self.columns
        rows = [
            (int(c.keep[j]), j, *(float(v[j]) for v in (c.fill_low, c.fill_high, c.low, c.high)),
             None if np.isnan(c.lam[j]) else float(c.lam[j]), float(c.centre[j]), float(c.spread[j]))
            for j in range(len(c.keep))
        ]
        return spark.createDataFrame(
            rows,
            "col_id int, out_col int, col_min double, col_max double, lower double, "
            "upper double, lam double, mean double, std double",
        )


def fit_recipe(df: DataFrame, split: ChunkSplit, recipe: Recipe, name: str = "") -> PrescaleModel:
    """Run a recipe's steps over a matrix and its chunk split.

    The column profile reads all rows, every step all train rows; there is no sample. A column
    without a finite cell always goes.
    """
    profile = matrix.block_profile(df.select("features"))
    low, high = profile["low"], profile["high"]
    finite = np.isfinite(low)
    state = Fit(split.train(df.select("row_id", "features")), profile, Columns.untouched(np.where(finite, low, 0.0), np.where(finite, high, 0.0)))
    state.drop("empty", ~finite)
    for step in recipe:
        step.fit(state)
    dropped = {k: sorted(v) for k, v in state.dropped.items()}
    dropped["invalid"] = sorted({*dropped.pop("empty"), *dropped.get("invalid", [])})
    return PrescaleModel(name, recipe, state.columns, dropped)


@dataclass
class LegacyScale:
    """Clip at mean +- factor * std and z-score with the same raw train moments.

    Moments skip what is not finite; there is no cleaning and no std floor, so a constant
    column comes out missing, and an infinite cell is clipped to its limit.
    """

    mean: np.ndarray
    std: np.ndarray
    factor: float

    def block(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            lower, upper = self.mean - self.factor * self.std, self.mean + self.factor * self.std
            x = np.where(x < lower, lower, x)
            x = np.where(x > upper, upper, x)
            z = (x - self.mean) / self.std
        return np.where(np.isfinite(z), z, np.nan)

    def transform(self, df: DataFrame) -> DataFrame:
        return map_blocks(df, self.block, len(self.mean))


def _by_column(stats: DataFrame, *names: str) -> list[np.ndarray]:
    rows = stats.orderBy("col_id").collect()
    return [np.array([r[n] for r in rows], dtype=np.float64) for n in names]


def fit_legacy(df: DataFrame, split: ChunkSplit, factor: float = LEGACY_STD_FACTOR) -> LegacyScale:
    train = split.train(df.select("row_id", "features"))
    mean, std = _by_column(matrix.masked_moments(train), "mean", "std")
    return LegacyScale(mean, std, factor)


def legacy_rescale(df: DataFrame, split: ChunkSplit, factor: float = LEGACY_STD_FACTOR) -> DataFrame:
    """Legacy scaling of the train and val rows; rows of the last chunk are left out."""
    sides = split.attach(df).filter(F.col("side").isNotNull())
    return fit_legacy(df, split, factor).transform(sides)


def split_only(df: DataFrame, split: ChunkSplit) -> DataFrame:
    """Sides without any scaling, for binary or already scaled matrices."""
    return split.attach(df).filter(F.col("side").isNotNull())
