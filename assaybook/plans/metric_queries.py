"""Queries over long predictions: regression, relative and rank metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.ordering import quantiles
from ..sources.readers import melt_predictions
from ..session import stage
from . import bindings as b
from .catalog import query, r, rounded
from .names import SAMPLE

_KEYS = "label, recipe, endpoint"


@query("regression_metrics", f"""
WITH {b.METRICS}
SELECT flavor AS label, recipe, endpoint, {r('r2')} AS r2, {r('rmse', 2)} AS rmse, {r('mae', 0)} AS mae,
       {r('mse', 0)} AS mse, n_test FROM metrics""")
def regression_metrics(spark, sf):
    m = evaluate.regression_metrics(b.predictions(spark, sf))
    return m.select("label", "recipe", "endpoint", F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"),
                    F.round("mae", 0).alias("mae"), F.round("mse", 0).alias("mse"), "n_test")


@query("rae", f"""
WITH {b.TRAIN_TEST},
means AS (SELECT {_KEYS}, avg(y) AS m, count(*) AS n FROM train GROUP BY ALL)
SELECT {_KEYS}, {r('avg(abs(y_true - y_pred)) / nullif(avg(abs(y_true - m)), 0)')} AS rae,
       coalesce(max(n), 0)::BIGINT AS n_train
FROM test LEFT JOIN means USING ({_KEYS}) GROUP BY {_KEYS}""")
def rae(spark, sf):
    train, test = b.train_and_test(spark, sf)
    return rounded(evaluate.rae(test, train))


_PAIRS = """coarse AS (
  SELECT label, recipe, endpoint, round(y_true / 5000) AS y, round(y_pred / 5000) AS f FROM pred)"""


def _coarse(spark, sf):
    """Predictions cut to a coarse grid, so that ties are common."""
    return b.predictions(spark, sf).select(
        "label", "recipe", "endpoint", F.round(F.col("y_true") / 5000).alias("y_true"),
        F.round(F.col("y_pred") / 5000).alias("y_pred"))


@query("spearman", f"""
WITH {b.PRED}, ranked AS (
  SELECT {_KEYS},
         rank() OVER wy + (count(*) OVER (PARTITION BY {_KEYS}, y_true) - 1) / 2.0::DOUBLE AS ry,
         rank() OVER wf + (count(*) OVER (PARTITION BY {_KEYS}, y_pred) - 1) / 2.0::DOUBLE AS rf
  FROM pred WINDOW wy AS (PARTITION BY {_KEYS} ORDER BY y_true), wf AS (PARTITION BY {_KEYS} ORDER BY y_pred))
SELECT {_KEYS}, {r('CASE WHEN isnan(corr(ry, rf)) THEN NULL ELSE corr(ry, rf) END')} AS spearman FROM ranked GROUP BY {_KEYS}""")
def spearman(spark, sf):
    return rounded(evaluate.spearman(b.predictions(spark, sf)))


@query("spearman_ties", f"""
WITH {b.PRED}, {_PAIRS}, ranked AS (
  SELECT {_KEYS}, rank() OVER wy + (count(*) OVER (PARTITION BY {_KEYS}, y) - 1) / 2.0::DOUBLE AS ry,
         rank() OVER wf + (count(*) OVER (PARTITION BY {_KEYS}, f) - 1) / 2.0::DOUBLE AS rf
  FROM coarse WINDOW wy AS (PARTITION BY {_KEYS} ORDER BY y), wf AS (PARTITION BY {_KEYS} ORDER BY f))
SELECT {_KEYS}, {r('CASE WHEN isnan(corr(ry, rf)) THEN NULL ELSE corr(ry, rf) END')} AS spearman FROM ranked GROUP BY {_KEYS}""")
def spearman_ties(spark, sf):
    return rounded(evaluate.spearman(_coarse(spark, sf)))


def _kendall_sql(source: str, y: str, f: str) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER () AS id FROM {source}),
pairs AS (
  SELECT {_KEYS}, sum(sign(a.{y} - c.{y}) * sign(a.{f} - c.{f})) AS s,
         sum(CASE WHEN a.{y} <> c.{y} THEN 1 ELSE 0 END) AS ny, sum(CASE WHEN a.{f} <> c.{f} THEN 1 ELSE 0 END) AS nf
  FROM numbered a JOIN numbered c USING ({_KEYS}) WHERE a.id < c.id GROUP BY {_KEYS})
SELECT {_KEYS}, {r('s / nullif(sqrt(ny::DOUBLE) * sqrt(nf::DOUBLE), 0)')} AS kendall
FROM (SELECT DISTINCT {_KEYS} FROM {source}) LEFT JOIN pairs USING ({_KEYS})"""


@query("kendall", f"WITH {b.PRED}, {_kendall_sql('pred', 'y_true', 'y_pred')}")
def kendall(spark, sf):
    return rounded(evaluate.kendall(b.predictions(spark, sf)))


@query("kendall_ties", f"WITH {b.PRED}, {_PAIRS}, {_kendall_sql('coarse', 'y', 'f')}")
def kendall_ties(spark, sf):
    return rounded(evaluate.kendall(_coarse(spark, sf)))


_TIDY = f"""
WITH {b.TRAIN_TEST},
means AS (SELECT {_KEYS}, avg(y) AS m, count(*) AS n FROM train GROUP BY ALL),
ranked AS (
  SELECT *, rank() OVER wy + (count(*) OVER (PARTITION BY {_KEYS}, y_true) - 1) / 2.0::DOUBLE AS ry,
         rank() OVER wf + (count(*) OVER (PARTITION BY {_KEYS}, y_pred) - 1) / 2.0::DOUBLE AS rf, row_number() OVER () AS id
  FROM test WINDOW wy AS (PARTITION BY {_KEYS} ORDER BY y_true), wf AS (PARTITION BY {_KEYS} ORDER BY y_pred)),
pairs AS (
  SELECT {_KEYS}, sum(sign(a.y_true - c.y_true) * sign(a.y_pred - c.y_pred)) AS s,
         sum(CASE WHEN a.y_true <> c.y_true THEN 1 ELSE 0 END) AS ny, sum(CASE WHEN a.y_pred <> c.y_pred THEN 1 ELSE 0 END) AS nf
  FROM ranked a JOIN ranked c USING ({_KEYS}) WHERE a.id < c.id GROUP BY {_KEYS}),
scored AS (
  SELECT {_KEYS}, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae, var_pop(y_true) AS v,
         corr(ry, rf) AS spearman, avg(abs(y_true - m)) AS dev, count(*) AS n_test, coalesce(max(n), 0)::BIGINT AS n_train
  FROM ranked LEFT JOIN means USING ({_KEYS}) GROUP BY {_KEYS})
SELECT label AS flavor, recipe, endpoint,
       CASE WHEN recipe LIKE 'plant%' THEN left(recipe, length(recipe) - 3) WHEN recipe LIKE 'press%' THEN 'press_line'
            ELSE split_part(recipe, '_', 1) END AS dataset,
       CASE WHEN n_test >= 2 THEN {r('1 - mse / v', 4)} END AS r2, {r('sqrt(mse)', 2)} AS rmse, {r('mae', 0)} AS mae,
       {r('mse', 2)} AS mse, {r('CASE WHEN isnan(spearman) THEN NULL ELSE spearman END', 4)} AS spearman,
       {r('s / nullif(sqrt(ny::DOUBLE) * sqrt(nf::DOUBLE), 0)', 4)} AS kendall, {r('mae / nullif(dev, 0)', 4)} AS rae, n_test, n_train
FROM scored LEFT JOIN pairs USING ({_KEYS})"""


@query("tidy_metrics", _TIDY)
def tidy_metrics(spark, sf):
    train, test = b.train_and_test(spark, sf)
    return rounded(evaluate.tidy_metrics(stage(test, "test"), train, SAMPLE).withColumns(
        {"rmse": F.round("rmse", 2), "mae": F.round("mae", 0), "mse": F.round("mse", 2)}), 4)


@query("melt_predictions", """
SELECT o_orderkey AS row_id, endpoint, y_true, y_pred FROM (
  SELECT o_orderkey, 'late' AS endpoint, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END AS y_true,
         o_totalprice * 0.9::DOUBLE AS y_pred FROM orders
  UNION ALL
  SELECT o_orderkey, 'urgent', CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END,
         o_totalprice * 1.1::DOUBLE FROM orders)
WHERE y_true IS NOT NULL""")
def melted(spark, sf):
    orders = b.table(spark, sf, "orders")
    price, late = F.col("o_totalprice"), F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    key = F.col("o_orderkey").alias("row_id")
    truth = orders.select(key, F.when(late, price).alias("late"),
                          F.when(F.col("o_orderpriority") == "1-URGENT", price).alias("urgent"))
    pred = orders.select(key, F.array(price * 0.9, price * 1.1).alias("y_pred"))
    return melt_predictions(pred, truth, ["row_id"], ["late", "urgent"])


@query("group_quantiles", f"""
WITH {b.PRED}
SELECT recipe, {r('quantile_cont(y_true, 0.25)', 4)} AS q1, {r('quantile_cont(y_true, 0.5)', 4)} AS median,
       {r('quantile_cont(y_true, 0.75)', 4)} AS q3 FROM pred GROUP BY recipe""")
def group_quantiles(spark, sf):
    p = b.predictions(spark, sf).select("recipe", "y_true")
    return rounded(quantiles(p, ["recipe"], "y_true", [0.25, 0.5, 0.75], ["q1", "median", "q3"]), 4)
