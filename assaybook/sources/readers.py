"""Readers: key files, corpora, wide prediction tables, result trees, shards."""

from __future__ import annotations

import io
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EXPECTED_TARGETS, NON_TARGET_COLUMNS
from ..functions.cells import as_cell, is_finite, lenient_double
from ..operators.keys import standardize_keys, wide_targets
from ..operators.ordering import with_row_id
from ..session import stage
from .records import csv_records

log = logging.getLogger(__name__)

METRICS_SCHEMA = (
    "flavor string, dataset string, recipe string, endpoint string, r2 double, rmse double, "
    "mae double, mse double, spearman double, kendall double, rae double, n_test long, n_train long"
)


def first_token(value):
    """First whitespace-separated token; blank lines give an empty string."""
    return F.split(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")), r"\s+")[0]


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """One key per line, blank lines dropped: (row_id, key) in file order.

    File order is the file name and the offset of the line inside its read partition, so the
    index stays the same whatever runs where.
    """
    lines = spark.read.text(path).select(
        first_token(F.col("value")).alias("key"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).filter(F.length("key") > 0)
    staged = stage(lines, "keys")
    return with_row_id(staged, ["_file", "_block", "_line"]).select("row_id", "key")


def read_corpus(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.parquet(path).select(column)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; no column is read, only row-group counts."""
    return spark.read.parquet(path).count()


def target_columns(columns: Sequence[str], exclude=NON_TARGET_COLUMNS, expected: int | None = EXPECTED_TARGETS) -> list[str]:
    """Header columns that are targets, in file order; an unexpected count is only a warning."""
    found = [c for c in columns if c not in exclude]
    if expected is not None and len(found) != expected:
        log.warning("expected %d target columns, found %d", expected, len(found))
    return found


def read_wide_csv(spark: SparkSession, path: str, exclude=NON_TARGET_COLUMNS,
                  expected: int | None = EXPECTED_TARGETS) -> tuple[DataFrame, list[str]]:
    """A header CSV as strings, and its target columns."""
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    # Spark names a blank header field by its position
    blank = {f"_c{i}" for i in range(len(df.columns))}
    return df, target_columns([c for c in df.columns if c not in blank], exclude, expected)


def wide_csv_to_matrix(df: DataFrame, key: str, targets: Sequence[str], fn=None):
    """Wide strings -> (canonical key, features), keys without a canonical form dropped.

    Returns the matrix and the observation with rows, failed and stripped.
    """
    kept, counts = standardize_keys(df, key, fn)
    matrix = wide_targets(kept, "canonical", targets).withColumnRenamed("canonical", "key")
    return matrix, counts


def read_result_tree(spark: SparkSession, root: str, labels: Sequence[str] | None = None,
                     file: str = "y_test.csv") -> tuple[DataFrame, DataFrame]:
    """Wide CSVs of a ``<root>/<label>/<recipe>/.../<file>`` tree, long, plus the rejects.

    Cells come as (label, recipe, row_id, position, column, value), missing ones as null; ``file`` may be
    a glob, and folders may be named ``key=value``. Every file has its own header. Fields may be quoted, and
    then hold commas, doubled quotes and line feeds. Files are read by blocks of lines, so a large
    one is split like any other. A file that is empty, ends inside a quoted field or has rows
    wider than its header becomes a (label, recipe, path, error) reject and does not stop the
    rest.
    """
    tree = result_rows(spark, root, labels, file)
    cells = tree.rows.select("label", "recipe", "row_id", "cells", F.posexplode("names").alias("_at", "column"))
    out = cells.select("label", "recipe", "row_id", F.col("_at").alias("position"), "column",
                       lenient_double(F.get("cells", "_at")).alias("value"))
    return out, tree.rejects


@dataclass(frozen=True)
class ResultRows:
    """Wide rows of a result tree, and what is known of its files without reading the rows again.

    ``rows``: label, recipe, row_id, names, cells. ``files``, a record for each file with rows: label, recipe,
    path, names, and in ``end`` the row_id after its last row. ``rejects``: label, recipe, path, error.
    """

    rows: DataFrame
    files: DataFrame
    rejects: DataFrame

    def columns(self) -> DataFrame:
        """The columns of each unit's files: (label, recipe, position, column, end)."""
        return self.files.select("label", "recipe", "end", F.posexplode("names").alias("position", "column"))


def result_rows(spark: SparkSession, root: str, labels: Sequence[str] | None = None, file: str = "y_test.csv") -> ResultRows:
    """The files that ``read_result_tree`` makes cells of, as rows with their header beside them."""
    unit = _unit_of(root)
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=file, lineSep="\n").text(root)
    records, open_ = csv_records(files, F.col("_metadata.file_path"))
    # every block numbers its records from zero, so a file's first record is the first one of a block
    at = F.struct("block", "seq")
    headers = records.filter("seq = 0").groupBy("path").agg(F.min(at).alias("_first"), F.min_by("cells", at).alias("names"))
    # what follows from a path is worked out once for a file, not for its rows
    plain = _plain_path(F.col("path"))
    headers = headers.select("*", plain.alias("_plain"), *unit(plain))
    open_ = open_.select(plain.alias("path"))
    headers = stage(headers if labels is None else headers.filter(F.col("label").isin(*labels)), "headers")
    # names only: Spark already lists them to plan the read, and skips empty files in it
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(
        _plain_path(F.col("path")).alias("path")).distinct()
    unread = listed if labels is None else listed.select("path", *unit(F.col("path"))).filter(F.col("label").isin(*labels)).select("path")
    unread = unread.join(headers.select(F.col("_plain").alias("path")), "path", "left_anti")
    reject = lambda df, error: df.select(*unit(F.col("path")), "path", F.lit(error).alias("error"))
    rejects = reject(open_, "a quote is left open").unionByName(reject(unread.join(open_, "path", "left_anti"), "empty file"))
    if labels is not None:
        rejects = rejects.filter(F.col("label").isin(*labels))

    parsed = records.join(headers.select("path", "_first", F.size("names").alias("_width")), "path").filter(at > F.col("_first"))
    blocks = stage(parsed.groupBy("path", "block").agg(
        F.count("*").alias("_n"), F.min("seq").alias("_least"), F.count_if(F.size("cells") > F.col("_width")).alias("_wide")), "blocks")
    wide = blocks.groupBy("path").agg(F.sum("_wide").alias("_wide")).filter("_wide > 0")
    bad = stage(headers.join(wide, "path").select(
        "label", "recipe", "path", "_plain", F.concat("_wide", F.lit(" rows are wider than the header")).alias("error")), "rejects")
    # rows of a block are numbered as they are read, so its place among all blocks is all that is missing
    known = blocks.join(headers, "path").join(bad.select("path"), "path", "left_anti")
    before = F.sum("_n").over(Window.partitionBy("label", "recipe").orderBy("_plain", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(known.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_start", F.col("_before") - F.col("_least")), "starts")
    rows = records.join(starts.select("path", "block", "label", "recipe", "_first", "names", "_start"), ["path", "block"]).filter(at > F.col("_first"))
    last = starts.groupBy("label", "recipe", F.col("_plain").alias("path")).agg(
        F.first("names").alias("names"), F.max(F.col("_before") + F.col("_n")).alias("end"))
    return ResultRows(
        rows.select("label", "recipe", (F.col("_start") + F.col("seq")).alias("row_id"), "names", "cells"),
        stage(last, "files"), bad.select("label", "recipe", F.col("_plain").alias("path"), "error").unionByName(rejects))


def read_npy_tree(spark: SparkSession, root: str, labels: Sequence[str] | None = None,
                  file: str = "y_pred.npy") -> tuple[DataFrame, DataFrame]:
    """Saved numpy prediction arrays of a result tree, long, plus the rejects.

    Cells come as (label, recipe, row_id, position, value). An array file cannot be split, so a
    unit is one task's work; Spark refuses files beyond its binary limit. An unreadable file
    becomes a reject.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=file).load(root)
    path = _plain_path(F.col("path"))
    units = files.select(*_unit_of(root)(path), path.alias("path"), "content")
    if labels is not None:
        units = units.filter(F.col("label").isin(*labels))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit in batch.itertuples(index=False):
                try:
                    array = np.load(io.BytesIO(unit.content), allow_pickle=False).astype(float)
                    array = array.reshape(len(array), -1)
                    n, k = array.shape
                    out = {"row_id": np.repeat(np.arange(n), k), "position": np.tile(np.arange(k), n),
                           "value": array.ravel(), "error": None}
                except Exception as e:  # noqa: BLE001 - one bad unit must not stop the scan
                    out = {"row_id": [None], "position": [None], "value": [None], "error": type(e).__name__}
                yield pd.DataFrame(out).assign(label=unit.label, recipe=unit.recipe, path=unit.path)[_NPY_COLUMNS]

    parsed = stage(units.mapInPandas(
        parse, "label string, recipe string, path string, row_id long, position int, value double, error string"
    ), "arrays")
    good = parsed.filter("error is null").select(
        "label", "recipe", "row_id", "position", as_cell(F.col("value")).alias("value"))
    return good, parsed.filter("error is not null").select("label", "recipe", "path", "error")


_NPY_COLUMNS = ["label", "recipe", "path", "row_id", "position", "value", "error"]


def read_target_order(spark: SparkSession, root: str, file: str = "target_cols.json") -> DataFrame:
    """Sidecar lists of target columns: (label, recipe, position, column)."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=file, wholetext=True).text(root)
    names = F.from_json("value", "array<string>")
    path = _plain_path(F.col("_metadata.file_path"))
    return files.select(*_unit_of(root)(path), F.posexplode(names).alias("position", "column"))


def _plain_path(path):
    """Local files are named ``file:/x`` in one place and ``file:///x`` in another."""
    return F.regexp_replace(path, "^file:/+", "/")


def _unit_of(root: str):
    """Label and recipe columns of a file path below ``root``; ``key=value`` folders give the value."""
    base = "/" + root.rstrip("/").split("/")[-1] + "/"

    def columns(path):
        inside = F.split(F.substring_index(path, base, -1), "/")
        name = lambda i: F.url_decode(F.regexp_replace(F.get(inside, F.lit(i)), "^[^=]*=", ""))
        return name(0).alias("label"), name(1).alias("recipe")

    return columns


def melt_predictions(pred: DataFrame, truth: DataFrame, ids: Sequence[str],
                     target_columns: Sequence[str] | None = None) -> DataFrame:
    """Wide predictions and truths -> long (ids, endpoint, y_true, y_pred), labelled cells only.

    ``pred`` holds an array ``y_pred`` in target order; without a target list the truth
    table's own column order counts.
    """
    targets = list(target_columns or [c for c in truth.columns if c not in ids])
    long = truth.unpivot(list(ids), targets, "endpoint", "y_true").withColumn("y_true", as_cell(F.col("y_true")))
    at = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("endpoint")) - 1
    return (
        long.filter(F.col("y_true").isNotNull()).join(pred, list(ids))
        .select(*ids, "endpoint", "y_true", F.get("y_pred", at.cast("int")).alias("y_pred"))
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).option("header", True).csv(path)


def merge_shards(spark: SparkSession, paths: Sequence[str], expected_rows: int, dim: int) -> DataFrame:
    """Concatenate matrix shards in order after one check of presence, width and row count.

    Row ids of shard s follow those of shard s-1.
    """
    parts = []
    for s, path in enumerate(paths):
        parts.append(spark.read.parquet(path).select(F.lit(s).alias("_shard"), "row_id", "features"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sizes = every.groupBy("_shard").agg(
        F.count("*").alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"),
        F.max("row_id").alias("last"),
    ).collect()
    by = {r["_shard"]: r for r in sizes}
    for s, path in enumerate(paths):
        if s not in by:
            raise ValueError(f"shard {path} has no rows")
        if by[s]["lo"] != dim or by[s]["hi"] != dim:
            raise ValueError(f"shard {path} has width {by[s]['lo']}..{by[s]['hi']}, expected {dim}")
    total = sum(r["n"] for r in sizes)
    if total != expected_rows:
        raise ValueError(f"the shards hold {total} rows, expected {expected_rows}")
    start, offsets = 0, F.lit(0)
    for s in range(len(paths)):
        offsets = F.when(F.col("_shard") == s, F.lit(start)).otherwise(offsets)
        start += by[s]["n"]
    return every.select((F.col("row_id") + offsets).alias("row_id"), "features")


def is_orphan(df: DataFrame, features: str = "features") -> bool:
    """True when no cell of the whole output is finite, as a crashed run leaves it."""
    some = df.agg(F.bool_or(F.exists(features, is_finite)).alias("some")).first()["some"]
    return not some


def require_some_success(df: DataFrame, features: str = "features") -> DataFrame:
    if is_orphan(df, features):
        raise ValueError("every row failed; refusing to keep the result")
    return df
