"""Regression and rank metrics per group of a long prediction table.

Sums and means combine before their shuffle; rank metrics cut the whole table into slices of
bounded size, so one huge group is spread over the cluster like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ratio
from ..functions.labels import dataset_of
from ..session import stage
from ..vocabulary import PLAIN, Vocabulary
from .rankings import rank_correlations

UNIT = ("label", "recipe", "endpoint")


def regression_metrics(
    pred: DataFrame, keys: Sequence[str] = UNIT, y: str = "y_true", f: str = "y_pred"
) -> DataFrame:
    """n_test, mse, rmse, mae and r2 per group, in one aggregate.

    r2 of a constant truth is one if all predictions are right, else zero; below two rows it
    is missing. Rows that lack the truth or the prediction are in no statistic, ``n_test``
    included; ``missing_predictions`` counts them.
    """
    err = F.col(y) - F.col(f)
    base = pred.filter(_paired(y, f)).groupBy(*keys).agg(
        F.count("*").alias("n_test"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(y).alias("_var"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n_test") < 2, None).when(F.col("_var") == 0, constant).otherwise(
        1 - ratio(F.col("mse"), F.col("_var"))
    )
    return base.select(
        *keys, r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse", "n_test"
    )


def _paired(y: str, f: str) -> Column:
    """Rows that every metric of a group is taken over."""
    return F.col(y).isNotNull() & F.col(f).isNotNull()


def missing_predictions(
    pred: DataFrame, keys: Sequence[str] = UNIT, y: str = "y_true", f: str = "y_pred"
) -> DataFrame:
    """Groups with a truth that has no prediction, and how many: (keys, n_missing)."""
    return pred.filter(F.col(y).isNotNull() & F.col(f).isNull()).groupBy(*keys).agg(F.count("*").alias("n_missing"))


def train_means(train: DataFrame, keys: Sequence[str] = UNIT, y: str = "y") -> DataFrame:
    return train.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.avg(y).alias("train_mean"), F.count("*").alias("n_train")
    )


def rae(
    pred: DataFrame, train: DataFrame, keys: Sequence[str] = UNIT,
    y: str = "y_true", f: str = "y_pred", y_train: str = "y",
) -> DataFrame:
    """Relative absolute error: mean error over mean deviation from the train mean."""
    means = stage(train_means(train, keys, y_train), "train_means")
    return (
        pred.filter(_paired(y, f)).join(means, list(keys), "left")
        .groupBy(*keys)
        .agg(
            ratio(
                F.avg(F.abs(F.col(y) - F.col(f))), F.avg(F.abs(F.col(y) - F.col("train_mean")))
            ).alias("rae"),
            F.coalesce(F.max("n_train"), F.lit(0)).alias("n_train"),
        )
    )


def spearman(
    pred: DataFrame, keys: Sequence[str] = UNIT, y: str = "y_true", f: str = "y_pred"
) -> DataFrame:
    """Spearman correlation with average ranks on ties; missing when either side is constant."""
    return rank_metrics(pred, keys, y, f, ("spearman",))


def kendall(
    pred: DataFrame, keys: Sequence[str] = UNIT, y: str = "y_true", f: str = "y_pred"
) -> DataFrame:
    """Kendall tau-b, exact, in O(n log n) work; missing when either side is constant."""
    return rank_metrics(pred, keys, y, f, ("kendall",))


def rank_metrics(
    pred: DataFrame, keys: Sequence[str] = UNIT, y: str = "y_true", f: str = "y_pred",
    metrics: Sequence[str] = ("spearman", "kendall"),
) -> DataFrame:
    """Rank correlations per group, for groups of any size on one path; both come from the same sorts."""
    rows = pred.filter(_paired(y, f)).select(*keys, F.col(y).alias("_y"), F.col(f).alias("_f"))
    return rank_correlations(rows, keys).select(*keys, *metrics)


def tidy_metrics(pred: DataFrame, train: DataFrame, vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """One row per (label, recipe, endpoint) with every metric, ready for the report tables.

    ``pred`` is read several times, so stage it if it is dear; both rank metrics share a pass.
    """
    keys = list(UNIT)
    return (
        regression_metrics(pred).join(rank_metrics(pred), keys, "left")
        .join(rae(pred, train), keys, "left")
        .select(
            F.col("label").alias("flavor"), dataset_of(F.col("recipe"), vocabulary).alias("dataset"), "recipe",
            "endpoint", "r2", "rmse", "mae", "mse", "spearman", "kendall", "rae", "n_test",
            F.coalesce("n_train", F.lit(0)).alias("n_train"),
        )
    )
