"""How the sample tables stand in for corpora, matrices, predictions and experiment records.

Each binding comes twice: as a DataFrame, and as a SQL common table expression that the check
queries build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import as_cell
from ..functions.labels import collapse_seeds
from ..operators.cards import prepare_rows
from ..operators.evaluate import regression_metrics
from ..operators.ordering import with_row_id
from ..operators.splits import ChunkSplit, chunk_split
from ..session import stage
from .names import SAMPLE

CONTROL = "f1"
ARMS = ("f0", "f1", "f2", "f3")
SHOWN = ("f0", "f2", "f3")
WIDE_CHUNK = 16
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- predictions

_RECIPES = {
    "ECONOMY": "plant_mt", "LARGE": "plant_potency_mt", "MEDIUM": "press1_st",
    "PROMO": "press_mt", "SMALL": "gauge_st", "STANDARD": "zeta_st",
}
_ENDPOINTS = ("LOG_rate_A", "LogD", "other_value")


def recipe_of(p_type):
    pairs = [x for k, v in _RECIPES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[p_type]


def endpoint_of(p_size):
    return F.array(*[F.lit(e) for e in _ENDPOINTS])[p_size % 3]


def predictions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Long predictions: four arms of growing error, seven seeds, two protocols."""
    items = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    arm = F.col("l_suppkey") % 4
    prefix = F.when(F.col("l_linestatus") == "O", "").otherwise("lr_reduced__")
    price = F.col("l_extendedprice")
    return items.select(
        F.concat(prefix, F.lit("f"), arm.cast("string"), F.lit("__s"),
                 F.col("l_linenumber").cast("string")).alias("label"),
        recipe_of(F.col("p_type")).alias("recipe"),
        endpoint_of(F.col("p_size")).alias("endpoint"),
        price.alias("y_true"),
        (price * (1 + (F.col("l_discount") - 0.05) * (1 + arm) * 2)
         + (F.col("l_quantity") - 25.5) * (1 + arm) * 300).alias("y_pred"),
        *extra,
    )


PRED = """pred AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN '' ELSE 'lr_reduced__' END
           || 'f' || (l_suppkey % 4) || '__s' || l_linenumber AS label,
         CASE p_type WHEN 'ECONOMY' THEN 'plant_mt' WHEN 'LARGE' THEN 'plant_potency_mt'
              WHEN 'MEDIUM' THEN 'press1_st' WHEN 'PROMO' THEN 'press_mt'
              WHEN 'SMALL' THEN 'gauge_st' WHEN 'STANDARD' THEN 'zeta_st' END AS recipe,
         ['LOG_rate_A', 'LogD', 'other_value'][p_size % 3 + 1] AS endpoint,
         l_extendedprice AS y_true,
         l_extendedprice * (1 + (l_discount - 0.05::DOUBLE) * (1 + l_suppkey % 4) * 2)
           + (l_quantity - 25.5::DOUBLE) * (1 + l_suppkey % 4) * 300 AS y_pred,
         l_orderkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_CUT = "1998-01-01"


def dated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return predictions(spark, sf_dir, "l_orderkey").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )


def train_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train labels, test predictions): older orders are the train side."""
    dated = dated_predictions(spark, sf_dir)
    old = F.col("o_orderdate") < F.lit(_CUT).cast("timestamp")
    train = dated.filter(old).select("label", "recipe", "endpoint", F.col("y_true").alias("y"))
    test = dated.filter(~old).select("label", "recipe", "endpoint", "y_true", "y_pred")
    return train, test


TRAIN_TEST = PRED + f""",
train AS (SELECT label, recipe, endpoint, y_true AS y FROM pred JOIN orders ON l_orderkey = o_orderkey
          WHERE o_orderdate < TIMESTAMP '{_CUT}'),
test AS (SELECT label, recipe, endpoint, y_true, y_pred FROM pred JOIN orders ON l_orderkey = o_orderkey
         WHERE o_orderdate >= TIMESTAMP '{_CUT}')"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy metrics table, staged once: reports read it many times."""
    table_ = regression_metrics(predictions(spark, sf_dir)).withColumnRenamed("label", "flavor")
    return stage(table_, "metrics")


METRICS = PRED + """,
metrics AS (
  SELECT label AS flavor, recipe, endpoint,
         CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y_true) = 0 THEN 0
              ELSE 1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) END AS r2,
         sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
         avg(abs(y_true - y_pred)) AS mae,
         avg((y_true - y_pred) * (y_true - y_pred)) AS mse,
         count(*) AS n_test
  FROM pred GROUP BY ALL)"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed-collapsed metrics with row identities, both protocols."""
    return prepare_rows(collapse_seeds(metrics(spark, sf_dir)), SAMPLE)


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default protocol's rows; identities come from the full table."""
    return stage(frame(spark, sf_dir).filter(~F.col("flavor").startswith("lr_")), "frozen")


FRAME = METRICS + """,
named AS (
  SELECT regexp_replace(flavor, '__s[0-9]+$', '') AS flavor,
         CAST(regexp_extract(flavor, '__s([0-9]+)$', 1) AS BIGINT) AS seed,
         recipe, endpoint, r2, rmse, mae, mse, n_test,
         CASE WHEN recipe LIKE 'plant\\_potency\\_%' ESCAPE '\\' THEN 'plant_potency'
              WHEN recipe LIKE 'plant\\_%' ESCAPE '\\' THEN 'plant'
              WHEN recipe LIKE 'press%' THEN 'press_line'
              WHEN recipe LIKE 'gauge\\_%' ESCAPE '\\' THEN 'gauge'
              ELSE split_part(recipe, '_', 1) END AS dataset
  FROM metrics),
frame AS (
  SELECT n.*, n.dataset || ' · ' || n.endpoint
         || CASE WHEN k.n_recipes > 1 THEN ' (' || recipe || ')' ELSE '' END AS row
  FROM named n JOIN (SELECT dataset, endpoint, count(DISTINCT recipe) AS n_recipes
                     FROM named GROUP BY ALL) k USING (dataset, endpoint)),
frozen AS (SELECT * FROM frame WHERE NOT starts_with(flavor, 'lr_'))"""


def stack_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of all four arms for every item, so that they can be stacked."""
    items = with_row_id(
        table(spark, sf_dir, "lineitem").select(*TALL_ORDER), TALL_ORDER, keep=("l_partkey", "l_linenumber", *TALL_COLUMNS)
    ).join(
        table(spark, sf_dir, "part").select("p_partkey", "p_size"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    y, q = F.col("l_extendedprice"), F.col("l_quantity") - 25.5
    arms = [
        y * (1 + (F.col("l_discount") - 0.05) * 4),
        y + q * 600,
        y * (1 + (F.col("l_tax") - 0.04) * 5),
        y * 0.8 + 3000 + q * 300,
    ]
    each = F.array(*[F.struct(F.lit(n).alias("flavor"), p.alias("y_pred")) for n, p in zip(ARMS, arms)])
    return items.select(
        endpoint_of(F.col("p_size")).alias("endpoint"),
        F.col("l_linenumber").cast("long").alias("seed"), "row_id", y.alias("y_true"), F.inline(each),
    )


STACK = """items AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row_id, *
  FROM lineitem),
features AS (
  SELECT ['LOG_rate_A', 'LogD', 'other_value'][p_size % 3 + 1] AS endpoint,
         l_linenumber::BIGINT AS seed, row_id, l_extendedprice AS y,
         l_extendedprice * (1 + (l_discount - 0.05::DOUBLE) * 4) AS f_f0,
         l_extendedprice + (l_quantity - 25.5::DOUBLE) * 600 AS f_f1,
         l_extendedprice * (1 + (l_tax - 0.04::DOUBLE) * 5) AS f_f2,
         l_extendedprice * 0.8::DOUBLE + 3000 + (l_quantity - 25.5::DOUBLE) * 300 AS f_f3
  FROM items JOIN part ON l_partkey = p_partkey)"""


# ---------------------------------------------------------------- matrices

TALL_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
TALL_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *TALL_COLUMNS, "l_shipdate")


def tall_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric columns of every line item, some cells missing or infinite."""
    rows = with_row_id(table(spark, sf_dir, "lineitem").select(*TALL_ORDER), TALL_ORDER, keep=TALL_COLUMNS)
    qty = F.when(F.col("l_quantity") == 50, float("inf")).when(
        F.col("l_quantity") == 49, float("-inf")).otherwise(F.col("l_quantity"))
    disc = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return rows.select("row_id", F.array(qty, "l_extendedprice", disc, "l_tax").alias("features"))


TALL = """tall AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row_id,
         CASE WHEN l_quantity = 50 THEN 'Infinity'::DOUBLE WHEN l_quantity = 49 THEN '-Infinity'::DOUBLE
              ELSE l_quantity END AS c0,
         l_extendedprice AS c1,
         CASE WHEN l_discount > 0 THEN l_discount END AS c2,
         l_tax AS c3
  FROM lineitem),
cells AS (
  SELECT row_id, 0 AS col_id, c0 AS value FROM tall UNION ALL SELECT row_id, 1, c1 FROM tall
  UNION ALL SELECT row_id, 2, c2 FROM tall UNION ALL SELECT row_id, 3, c3 FROM tall)"""


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with broken columns and rows: a near copy, a constant, missing cells,
    infinities, outliers, an empty column, failed rows."""
    rows = with_row_id(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"])
    i0, rid = F.col("embedding")[0].cast("double"), F.col("row_id")

    def cell(x, i):
        x = as_cell(x)
        return (
            F.when((rid % 101 == 100) | (i == 7), None)
            .when(i == 1, i0 + (rid % 7) * F.lit(1e-4))
            .when(i == 2, F.lit(3.14))
            .when((i == 3) & (rid % 10 == 3), None)
            .when((i == 4) & (rid % 50 == 10), F.lit(float("inf")))
            .when((i == 4) & (rid % 50 == 20), F.lit(float("-inf")))
            .when((i == 5) & (rid % 97 == 0), F.lit(1e6))
            .otherwise(x)
        )

    return rows.select("row_id", F.transform("embedding", cell).alias("features"))


WIDE = """wide AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings),
cells AS (
  SELECT row_id, (i - 1)::INTEGER AS col_id,
         CASE WHEN row_id % 101 = 100 OR i = 8 THEN NULL
              WHEN i = 2 THEN embedding[1]::DOUBLE + (row_id % 7) * 1e-4::DOUBLE
              WHEN i = 3 THEN 3.14::DOUBLE
              WHEN i = 4 AND row_id % 10 = 3 THEN NULL
              WHEN i = 5 AND row_id % 50 = 10 THEN 'Infinity'::DOUBLE
              WHEN i = 5 AND row_id % 50 = 20 THEN '-Infinity'::DOUBLE
              WHEN i = 6 AND row_id % 97 = 0 THEN 1e6::DOUBLE
              ELSE embedding[i]::DOUBLE END AS value
  FROM wide, range(1, 65) t(i))"""


def split_of(spark: SparkSession, matrix: DataFrame, chunk_rows: int) -> ChunkSplit:
    return chunk_split(spark, matrix.count(), chunk_rows)


def split_sql(rows: str, chunk_rows: int) -> str:
    """CTE ``sides`` (chunk_id, side) over the rows of CTE ``rows``; ``sized`` holds n_chunks."""
    return f""",
sized AS (SELECT (count(*) + {chunk_rows - 1}) // {chunk_rows} AS n_chunks FROM {rows}),
chunks AS (SELECT DISTINCT row_id // {chunk_rows} AS chunk_id FROM {rows}),
sides AS (
  SELECT chunk_id,
         CASE WHEN row_number() OVER (ORDER BY md5('42:' || chunk_id))
                   <= floor(0.9::DOUBLE * (SELECT n_chunks FROM sized)) THEN 'train' ELSE 'val' END AS side
  FROM chunks WHERE chunk_id < (SELECT n_chunks FROM sized) - 1)"""


# ---------------------------------------------------------------- keys

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return with_row_id(docs, ["doc_id"])


CORPUS = """corpus AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, text, lang, source FROM documents)"""

CANONICAL = """made AS (
  SELECT *, list_filter(list_transform(string_split(lower(text), chr(10)),
                        lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 0) AS lines
  FROM corpus),
std AS (
  SELECT row_id, doc_id, lang, source,
         CASE WHEN len(lines) > 0 THEN
           list_reduce(lines, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) END AS canonical,
         len(lines) > 1 AS stripped
  FROM made)"""
