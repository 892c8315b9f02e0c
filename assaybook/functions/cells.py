"""Matrix cells: finite, infinite or missing. Missing is NULL; NaN never leaves the border."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = float("inf")


def as_cell(c: Column) -> Column:
    """Double with NaN turned into NULL; infinities stay."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def lenient_double(c: Column) -> Column:
    """Parse a number; what cannot be parsed is missing, never an error."""
    return as_cell(F.trim(c.cast("string")).try_cast("double"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_INF))


def row_failed(features: Column) -> Column:
    """True when no cell of the row is finite."""
    return features.isNull() | ~F.exists(features, is_finite)


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is zero or missing."""
    return F.try_divide(a, b)


def clip(c: Column, lower: Column, upper: Column) -> Column:
    """Clip to [lower, upper]; a missing cell stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, upper), lower))


def zscore(c: Column, mean: Column, std: Column, floor_std: bool = True) -> Column:
    """(x - mean) / std. A zero std divides by one, or gives missing when ``floor_std`` is off."""
    scale = F.when(std > 0, std).otherwise(F.lit(1.0)) if floor_std else std
    return ratio(c - mean, scale)


def yeo_johnson(c: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform of one cell; a missing lambda leaves the cell as it is."""
    tiny = 2.220446049250313e-16
    up = F.when(F.abs(lam) < tiny, F.log1p(c)).otherwise(
        F.try_divide(F.pow(c + 1, lam) - 1, lam)
    )
    mirror = 2 - lam
    down = F.when(F.abs(mirror) < tiny, -F.log1p(-c)).otherwise(
        -F.try_divide(F.pow(1 - c, mirror) - 1, mirror)
    )
    return F.when(lam.isNull(), c).when(c >= 0, up).otherwise(down)


def log_scale(df: DataFrame, cols: Sequence[str], prefix: str = "LOG_") -> DataFrame:
    """Add ``LOG_x = log10(x)`` next to each raw column; values that are not positive are missing."""
    return df.withColumns(
        {f"{prefix}{c}": F.when(F.col(c) > 0, F.log10(F.col(c))) for c in cols}
    )


def long_cells(df: DataFrame, key: str = "row_id", features: str = "features") -> DataFrame:
    """One row per cell: (key, col_id, value).

    Of a bare column Spark would filter out missing and empty rows first, and compute the column once
    more for that; the generator drops them anyway.
    """
    rows = F.col(features)
    return df.select(key, F.posexplode(F.when(rows.isNotNull(), rows)).alias("col_id", "value"))
