"""From a result tree to the tidy metrics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import lenient_double
from ..operators.evaluate import tidy_metrics
from ..session import stage
from ..vocabulary import PLAIN, Vocabulary
from .readers import read_npy_tree, read_target_order, result_rows


def evaluate_tree(spark: SparkSession, root: str, labels: Sequence[str] | None = None,
                  truth: str = "y_test.csv", pred: str = "y_pred.npy", train: str = "y_train.csv",
                  order: str = "target_cols.json", vocabulary: Vocabulary = PLAIN) -> tuple[DataFrame, DataFrame]:
    """Score every unit of ``<root>/<label>/<recipe>/...``; returns metrics and rejected files.

    Truth and train files are wide CSVs, one column per endpoint. Predictions are either such a
    CSV, matched by column name, or a numpy array, whose columns follow the unit's sidecar list
    or, without one, the truth file. Rows match by position. A unit that lacks a readable file, or
    whose predictions have another number of rows or columns than its truths, is left out of the
    metrics and becomes a reject.
    """
    unit = ["label", "recipe"]
    truths, trained = result_rows(spark, root, labels, truth), result_rows(spark, root, labels, train)
    bad, bad_train = truths.rejects, trained.rejects
    header = truths.columns()
    # rows and columns of all files are known from their headers and blocks, so the cells are read only to be scored
    if pred.endswith(".npy"):
        made, bad_pred = read_npy_tree(spark, root, labels, pred)
        shape = _shape(made.withColumn("end", F.col("row_id") + 1))
        sidecar = stage(read_target_order(spark, root, order), "order")
        names = sidecar.unionByName(header.select(*unit, "position", "column").distinct().join(sidecar.select(*unit).distinct(), unit, "left_anti"))
        names = stage(names, "names")
        columns = names.groupBy(*unit).agg(F.count("*").alias("t_cols"))
        made = made.join(names, [*unit, "position"])
    else:
        predicted = result_rows(spark, root, labels, pred)
        made, bad_pred = _cells(predicted.rows), predicted.rejects
        # columns match by name here, so only those that the truth has count
        shape = _shape(predicted.columns().join(header.select(*unit, "column").distinct(), [*unit, "column"], "left_semi"), "column")
        columns = header.groupBy(*unit).agg(F.count_distinct("column").alias("t_cols"))
    odd = stage(_disagreements(header, columns, trained.files, shape, bad.unionByName(bad_train).unionByName(bad_pred), pred, train), "odd")
    wanted = _cells(truths.rows.join(odd.select(*unit), unit, "left_anti"))
    at = [*unit, "row_id", "column"]
    scored = (
        wanted.filter(F.col("value").isNotNull()).select(*at, F.col("value").alias("y_true"))
        .join(made.select(*at, F.col("value").alias("y_pred")), at)
        .join(trained.files.select(*unit).distinct(), unit, "left_semi")
        .withColumnRenamed("column", "endpoint")
    )
    known = _cells(trained.rows).select(*unit, F.col("column").alias("endpoint"), F.col("value").alias("y"))
    return tidy_metrics(stage(scored, "scored"), known, vocabulary), bad.unionByName(bad_train).unionByName(bad_pred).unionByName(odd)


def _cells(rows: DataFrame) -> DataFrame:
    """Wide rows as long cells: (label, recipe, row_id, column, value)."""
    each = rows.select("label", "recipe", "row_id", "cells", F.posexplode("names").alias("_at", "column"))
    return each.select("label", "recipe", "row_id", "column", lenient_double(F.get("cells", "_at")).alias("value"))


def _shape(columns: DataFrame, column: str = "position") -> DataFrame:
    """Rows and columns of each unit, from its columns and where their rows end."""
    return columns.groupBy("label", "recipe").agg(F.max("end").alias("rows"), F.count_distinct(column).alias("cols"))


def _disagreements(wanted: DataFrame, columns: DataFrame, known: DataFrame, made: DataFrame, bad: DataFrame,
                   pred: str, train: str) -> DataFrame:
    """Rejects of units whose files are all readable but do not fit: (label, recipe, path, error).

    A unit counts if any of its three files does; one that has a reject already is left to it.
    """
    unit = ["label", "recipe"]
    truth = wanted.groupBy(*unit).agg(F.max("end").alias("t_rows")).join(columns, unit, "left")
    sides = truth.join(made, unit, "full").join(known.select(*unit, F.lit(True).alias("trained")).distinct(), unit, "full")
    error = (
        F.when(F.col("t_rows").isNull(), F.lit("no truths"))
        .when(F.col("rows").isNull(), F.lit(f"no {pred}"))
        .when(F.col("trained").isNull(), F.lit(f"no {train}"))
        .when(F.col("rows") != F.col("t_rows"), F.format_string("%d rows of predictions for %d of truths", "rows", "t_rows"))
        .when(F.col("cols") != F.col("t_cols"), F.format_string("%d columns of predictions for %d of truths", "cols", "t_cols"))
    )
    return (
        sides.join(bad.select(*unit).distinct(), unit, "left_anti")
        .select(*unit, F.lit(None).cast("string").alias("path"), error.alias("error")).filter("error IS NOT NULL")
    )
