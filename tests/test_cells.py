import math

import numpy as np
from pyspark.sql import functions as F

from assaybook.functions import cells
from assaybook.functions.cells import long_cells
from assaybook.operators import matrix
from assaybook.plans.catalog import rounded

INF, NAN = float("inf"), float("nan")
ROWS = [
    (0, [1.5, -2.0, 7.0]), (1, [INF, None, NAN]), (2, [-INF, 0.0, None]), (3, None), (4, []),
    (5, [3.25]), (6, [4.0, 5.0, 6.0, 8.0, INF]), (7, [None, None, None]), (8, [-0.0, 1e300, 1e-300]),
]
MEAN, STD = [1.25, -0.5, 7.0], [2.0, 0.0, None]


def matrix_of(spark):
    return spark.createDataFrame(ROWS, "row_id long, features array<double>").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def told(df):
    """Rows in a form in which NaN equals itself, and zeros keep their sign."""
    return sorted((tuple(map(repr, r)) for r in df.collect()))


def test_zscore_of_any_row_is_that_of_each_cell(spark):
    m = matrix_of(spark)
    mean, std = (F.array(*[F.lit(v).cast("double") for v in x]) for x in (MEAN, STD))
    for floor in (True, False):
        want = m.withColumn("features", F.transform(
            "features", lambda x, i: cells.zscore(x, F.get(mean, i), F.get(std, i), floor)))
        assert told(matrix.zscore_columns(m, MEAN, STD, floor)) == told(want)
    wide = matrix.NAMED_CELLS + 3
    assert told(matrix.zscore_columns(m, MEAN + [0.0] * wide, STD + [1.0] * wide).filter("size(features) <= 3")) == told(
        matrix.zscore_columns(m, MEAN, STD).filter("size(features) <= 3"))


def test_rescatter_with_a_width_changes_nothing(spark):
    """Rows of the width and others, and pairs of rows that differ in length."""
    m = matrix_of(spark).withColumn("scaled", F.when(F.col("row_id") < 8, F.slice(F.concat("features", "features"), 2, 3)))
    plain, known = (m.select("row_id", matrix.rescatter_missing(F.col("features"), F.col("scaled"), w).alias("x")) for w in (None, 3))
    assert told(known) == told(plain)


def test_zscore_is_compiled_and_computed_once(spark):
    m = matrix_of(spark).withColumn("raw", F.col("features"))
    scaled = matrix.zscore_columns(m, MEAN, STD)
    back = scaled.select("row_id", matrix.rescatter_missing(F.col("raw"), F.col("features"), 3).alias("features"))
    text = plan(long_cells(back))
    assert "lambda" not in text and "Filter" not in text
    got = {(r["row_id"], r["col_id"]): r["value"] for r in long_cells(back).collect()}
    assert got[0, 0] == 0.125 and got[1, 0] is None and got[6, 1] == 5.5 and (6, 4) in got and (5, 1) not in got
    assert {i for i, _ in got} == {0, 1, 2, 5, 6, 7, 8}


def test_rounding_is_that_of_decimal_digits(spark):
    rng = np.random.default_rng(5)
    units = rng.integers(-10**9, 10**9, 3000)
    x = [*(units / 1e6), *((units + 0.5) / 1e6), *((units // 1000 + 0.5) / 1e3), *np.nextafter((units + 0.5) / 1e6, 0), *rng.normal(size=3000),
         *rng.normal(size=500) * 1e12, 0.0, -0.0, 1e-9, -1e-9, 2147.483647, 2147.4836485, 1e300, INF, -INF, NAN, None, 0.5, 2.5, -0.0000005]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i long, x double")
    for digits in (2, 3, 6, 9):
        both = rounded(df, digits).join(df.select("i", (F.round("x", digits) + F.lit(0.0)).alias("y")), "i")
        bad = [r for r in both.collect() if repr(r["x"]) != repr(r["y"])]
        assert not bad, bad[:3]
    assert math.copysign(1, rounded(df.filter("x = -1e-9"), 6).first()["x"]) == 1
