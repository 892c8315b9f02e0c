"""The registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL it must agree with where SQL can say the same."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _round(x: Column, digits: int) -> Column:
    """``F.round`` of a double, which goes by its decimal digits, and does so only where they can matter.

    Below 2^31 units of the last digit kept, binary and decimal value are less than 2^-20 units apart: off the middle
    between two units both round to one integer, and its quotient is the double nearest to the rounded decimal.
    """
    unit = F.lit(10.0**digits)
    scaled = x * unit
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(2.0**31)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, whole / unit).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, as summation order differs between engines."""
    return df.select(
        *[
            (_round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round({expression}, {digits}) + 0.0)"
