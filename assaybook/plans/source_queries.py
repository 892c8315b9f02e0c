"""Queries that go through the readers and writers, on files Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix, prescale
from ..session import fresh_path, stage
from ..sources import readers, writers
from ..sources.results import evaluate_tree
from . import bindings as b
from .catalog import query, r, rounded


@query("read_keys", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
tokens AS (SELECT doc_id, pos, regexp_extract(line, '[^ \t\n\v\f\r]+') AS key FROM lines)
SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS row_id, key FROM tokens WHERE length(key) > 0""")
def read_keys(spark, sf):
    path = fresh_path(spark, "keys-text")
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return readers.read_keys(spark, path)


@query("read_corpus", "SELECT text FROM documents")
def read_corpus(spark, sf):
    return readers.read_corpus(spark, f"{sf}/documents.parquet", "text")


@query("row_counts", """
SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents""")
def row_counts(spark, sf):
    return spark.createDataFrame(
        [(t, readers.row_count(spark, f"{sf}/{t}.parquet")) for t in ("lineitem", "documents")], "name string, n long")


# customers as a released table: a row number, a key of fragments, targets with unreadable cells
_RELEASED = """
SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '.Na' ELSE '' END AS smiles,
       CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_acctbal::VARCHAR END AS t1,
       c_nationkey::VARCHAR AS t2 FROM customer"""


def _released(spark, sf):
    path, key = fresh_path(spark, "released"), F.col("c_custkey")
    b.table(spark, sf, "customer").select(
        key.alias("index"),
        F.concat("c_name", F.when(key % 3 == 0, ".Na").otherwise("")).alias("smiles"),
        F.when(key % 5 == 0, "n/a").when(key % 5 == 1, None).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.lit("web").alias("Public Source"), F.col("c_nationkey").cast("string").alias("nation"),
    ).write.option("header", True).csv(path)
    return readers.read_wide_csv(spark, path, expected=2)


@query("wide_csv_matrix", f"""
WITH released AS ({_RELEASED}), made AS (
  SELECT c_custkey, regexp_replace(smiles, '[.]Na$', '') AS key, CASE WHEN t1 = 'n/a' THEN NULL ELSE t1::DOUBLE END AS v0,
         t2::DOUBLE AS v1 FROM released)
SELECT key, 0 AS col_id, v0 AS value FROM made UNION ALL SELECT key, 1, v1 FROM made""")
def wide_csv_matrix(spark, sf):
    df, targets = _released(spark, sf)
    made, _ = readers.wide_csv_to_matrix(df, "smiles", targets)
    return made.select("key", F.posexplode("features").alias("col_id", "value"))


@query("wide_csv_counts", """
SELECT count(*) AS n_rows, 0::BIGINT AS failed, count(*) FILTER (WHERE c_custkey % 3 = 0) AS stripped, 'balance,nation' AS targets FROM customer""")
def wide_csv_counts(spark, sf):
    df, targets = _released(spark, sf)
    made, counts = readers.wide_csv_to_matrix(df, "smiles", targets)
    made.agg(F.count("*")).collect()
    n = counts.get
    return spark.createDataFrame([(n["rows"], n["failed"], n["stripped"], ",".join(targets))],
                                 "n_rows long, failed long, stripped long, targets string")


@query("result_tree", f"""
WITH {b.PRED}
SELECT label, recipe, col AS "column", count(*) AS n, count(value) AS labelled, {r('sum(value)', 2)} AS total FROM (
  SELECT label, recipe, 'truth' AS col, y_true AS value FROM pred
  UNION ALL SELECT label, recipe, 'late', CASE WHEN endpoint = 'LogD' THEN y_true END FROM pred)
GROUP BY ALL""")
def result_tree(spark, sf):
    root = fresh_path(spark, "results")
    p = b.predictions(spark, sf)
    wide = p.select("label", "recipe", F.col("y_true").alias("truth"),
                    F.when(F.col("endpoint") == "LogD", F.col("y_true")).alias("late"))
    # few files per folder, and a busy folder still gets several writers
    wide.hint("rebalance", "label", "recipe").write.partitionBy("label", "recipe").option("header", True).csv(root)
    good, rejects = readers.read_result_tree(spark, root, file="*.csv")
    cells = good.groupBy("label", "recipe", "column").agg(
        F.count("*").alias("n"), F.count("value").alias("labelled"), F.sum("value").alias("total"))
    return rounded(cells.join(rejects.select("label", "recipe"), ["label", "recipe"], "left_anti"), 2)


_TREE = f"""WITH {b.PRED}, units AS (
  SELECT 'f' || left(split_part(label, 'f', -1), 1) AS label, recipe, endpoint, y_true, y_pred, l_orderkey FROM pred)"""


def _tree(spark, sf):
    """One folder a unit with truths, predictions and train labels; the suffix tells the three apart.

    The last arm's predictions lack some rows, and one unit has none at all.
    """
    root = fresh_path(spark, "tree")
    p = b.predictions(spark, sf, "l_orderkey", "l_linenumber", "l_partkey").withColumn(
        "label", F.regexp_extract("label", "f[0-3]", 0))
    late = lambda c: F.when(F.col("endpoint") == "LogD", F.col(c)).alias("late")
    order = ["label", "recipe", "l_orderkey", "l_linenumber", "l_partkey", "y_true", "y_pred"]
    p = p.repartition("label", "recipe").sortWithinPartitions(*order)
    parts = {
        "none": p.select("label", "recipe", F.col("y_true").alias("truth"), late("y_true")),
        "gzip": p.filter("NOT (label = 'f3' AND l_orderkey % 7 = 0) AND NOT (label = 'f2' AND recipe = 'zeta_st')")
                 .select("label", "recipe", F.col("y_pred").alias("truth"), F.col("y_pred").alias("late")),
        "bzip2": p.filter("l_linenumber = 1").select("label", "recipe", F.col("y_true").alias("truth"), late("y_true")),
    }
    for codec, part in parts.items():
        part.write.mode("append").partitionBy("label", "recipe").options(header=True, compression=codec).csv(root)
    return evaluate_tree(spark, root, truth="*.csv", pred="*.csv.gz", train="*.csv.bz2")


@query("evaluate_tree_metrics", f"""
{_TREE}, cells AS (
  SELECT label, recipe, 'truth' AS endpoint, y_true, y_pred FROM units
  UNION ALL SELECT label, recipe, 'late', y_true, y_pred FROM units WHERE endpoint = 'LogD')
SELECT label AS flavor, recipe, endpoint, count(*) AS n_test, {r('avg(abs(y_true - y_pred))', 0)} AS mae,
       {r('1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true)', 4)} AS r2
FROM cells WHERE label <> 'f3' AND NOT (label = 'f2' AND recipe = 'zeta_st') GROUP BY ALL""")
def evaluate_tree_metrics(spark, sf):
    scored = _tree(spark, sf)[0].select("flavor", "recipe", "endpoint", "n_test", F.round("mae", 0).alias("mae"), "r2")
    return rounded(scored, 4)


@query("evaluate_tree_rejects", f"""
{_TREE}
SELECT label, recipe, CASE WHEN label = 'f2' THEN 'no *.csv.gz' ELSE
       count(*) FILTER (WHERE l_orderkey % 7 <> 0) || ' rows of predictions for ' || count(*) || ' of truths' END AS error
FROM units WHERE label = 'f3' OR (label = 'f2' AND recipe = 'zeta_st') GROUP BY label, recipe""")
def evaluate_tree_rejects(spark, sf):
    return _tree(spark, sf)[1].select("label", "recipe", "error")


@query("read_metrics", f"""
WITH {b.METRICS}
SELECT flavor, split_part(recipe, '_', 1) AS dataset, recipe, endpoint, {r('r2')} AS r2, {r('mae', 0)} AS mae, n_test FROM metrics""")
def read_metrics(spark, sf):
    path = fresh_path(spark, "metrics-csv")
    none = F.lit(None).cast("double")
    m = b.metrics(spark, sf).select(
        "flavor", F.split_part(F.col("recipe"), F.lit("_"), F.lit(1)).alias("dataset"), "recipe", "endpoint", "r2", "rmse", "mae", "mse",
        none.alias("spearman"), none.alias("kendall"), none.alias("rae"), "n_test", F.lit(0).cast("long").alias("n_train"))
    writers.write_table(m, path)
    back = readers.read_metrics(spark, path)
    return back.select("flavor", "dataset", "recipe", "endpoint", F.round("r2", 6).alias("r2"), F.round("mae", 0).alias("mae"), "n_test")


@query("write_matrix", f"""
WITH {b.TALL}
SELECT row_id // 128 AS chunk_id, count(*) AS n_rows, min(row_id) AS first_row, {r('sum(c1)', 2)} AS price FROM tall GROUP BY ALL""")
def write_matrix(spark, sf):
    path = fresh_path(spark, "matrix")
    writers.write_matrix(b.tall_matrix(spark, sf), path)
    return rounded(spark.read.parquet(path).groupBy("chunk_id").agg(
        F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.sum(F.col("features")[1]).alias("price")), 2)


@query("write_split", f"""
WITH {b.TALL}{b.split_sql('tall', 128)}
SELECT row_id, side, c1 AS price FROM tall JOIN sides ON row_id // 128 = chunk_id""")
def write_split(spark, sf):
    path = fresh_path(spark, "split")
    m = b.tall_matrix(spark, sf)
    writers.write_split(m, b.split_of(spark, m, 128), path)
    # the side is a folder, and so a partition column of what is read back
    return spark.read.parquet(path).select("row_id", "side", F.col("features")[1].alias("price"))


@query("save_stats", f"""
WITH {b.TALL}{b.split_sql('tall', 128)}
SELECT col_id, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std
FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train' WHERE value IS NOT NULL AND isfinite(value) GROUP BY col_id""")
def save_stats(spark, sf):
    path = fresh_path(spark, "stats")
    m = b.tall_matrix(spark, sf)
    writers.save_stats(matrix.masked_moments(b.split_of(spark, m, 128).train(m)), path)
    return rounded(spark.read.parquet(path))


@query("merge_shards", f"""
WITH {b.WIDE}
SELECT row_id, {r('sum(CASE WHEN value IS NOT NULL AND isfinite(value) THEN value END)')} AS total FROM cells GROUP BY row_id""")
def merge_shards(spark, sf):
    m = stage(b.wide_matrix(spark, sf), "wide")
    n, paths = m.count(), []
    for s in range(3):
        lo, hi = n * s // 3, n * (s + 1) // 3
        path = fresh_path(spark, f"shard{s}")
        part = m.filter((F.col("row_id") >= lo) & (F.col("row_id") < hi))
        writers.write_matrix(part.withColumn("row_id", F.col("row_id") - lo), path)
        paths.append(path)
    merged = readers.require_some_success(readers.merge_shards(spark, paths, n, b.WIDTH))
    cells = merged.select("row_id", F.posexplode("features").alias("col_id", "value"))
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    return rounded(cells.groupBy("row_id").agg(F.sum(finite).alias("total")))


@query("orphan_check", f"""
WITH {b.WIDE}
SELECT 'kept' AS output, count(*) FILTER (WHERE value IS NOT NULL AND isfinite(value)) = 0 AS orphan FROM cells
UNION ALL SELECT 'crashed', count(*) FILTER (WHERE nothing IS NOT NULL) = 0 FROM (SELECT nullif(value, value) AS nothing FROM cells)""")
def orphan_check(spark, sf):
    m = stage(b.wide_matrix(spark, sf), "wide")
    crashed = m.withColumn("features", F.transform("features", lambda x: F.lit(None).cast("double")))
    return spark.createDataFrame(
        [("kept", readers.is_orphan(m)), ("crashed", readers.is_orphan(crashed))], "output string, orphan boolean")


@query("split_only", f"""
WITH {b.WIDE}{b.split_sql('wide', b.WIDE_CHUNK)}
SELECT row_id, chunk_id::BIGINT AS chunk_id, side FROM wide JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id""")
def split_only(spark, sf):
    m = b.wide_matrix(spark, sf)
    return prescale.split_only(m, b.split_of(spark, m, b.WIDE_CHUNK)).select("row_id", "chunk_id", "side")
