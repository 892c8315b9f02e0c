"""Queries over the tall and wide matrices: index, splits, fits and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import long_cells, yeo_johnson
from ..operators import featurize, matrix, pca, power, prescale, splits
from ..operators.ordering import input_row_ids, with_row_id
from ..operators.steps import ORDER_FIX, RECIPES, ClipSpread, DropInvalid, Scale
from ..session import aligned_buckets, stage, stage_aligned
from . import bindings as b
from .catalog import query, r, rounded

_TALL_SPLIT = b.split_sql("tall", 128)
_WIDE_SPLIT = b.split_sql("wide", b.WIDE_CHUNK)
_VALID = "[x for x in range(64) if x != 7]"
_FINITE = "(value IS NOT NULL AND isfinite(value))"


def _long(df, digits=6):
    return rounded(long_cells(df).withColumn("row_id", F.col("row_id").cast("long")), digits)


@query("row_index", f"""
WITH {b.TALL} SELECT row_id, c0 AS quantity, c1 AS price FROM tall""")
def row_index(spark, sf):
    f = F.col("features")
    return b.tall_matrix(spark, sf).select("row_id", f[0].alias("quantity"), f[1].alias("price"))


@query("chunk_split", f"""
WITH {b.TALL}{_TALL_SPLIT}
SELECT chunk_id::BIGINT AS chunk_id, side, (chunk_id * 128)::BIGINT AS start_row,
       (chunk_id * 128 + 128)::BIGINT AS end_row FROM sides""")
def chunk_split(spark, sf):
    n = b.table(spark, sf, "lineitem").count()
    return splits.chunk_split(spark, n).ranges(spark)


@query("chunk_split_numpy")
def chunk_split_numpy(spark, sf):
    n = b.table(spark, sf, "lineitem").count()
    return splits.chunk_split(spark, n, order="numpy").ranges(spark)


@query("split_rows", f"""
WITH {b.TALL}{_TALL_SPLIT}
SELECT side, count(*) AS n_rows, sum(row_id)::BIGINT AS row_sum, {r('sum(c1)', 2)} AS price
FROM tall JOIN sides ON row_id // 128 = chunk_id GROUP BY side""")
def split_rows(spark, sf):
    m = b.tall_matrix(spark, sf)
    sides = prescale.split_only(m, b.split_of(spark, m, 128))
    return rounded(sides.groupBy("side").agg(
        F.count("*").alias("n_rows"), F.sum("row_id").alias("row_sum"),
        F.sum(F.col("features")[1]).alias("price")), 2)


@query("evenly_spaced", f"""
WITH {b.TALL}
SELECT row_id, c1 AS price FROM tall
WHERE row_id % greatest(1, (SELECT count(*) FROM tall) // 20000) = 0
  AND row_id < greatest(1, (SELECT count(*) FROM tall) // 20000) * 20000
   OR (SELECT count(*) FROM tall) <= 20000""")
def evenly_spaced(spark, sf):
    m = b.tall_matrix(spark, sf)
    return splits.evenly_spaced(m, m.count(), 20_000).select("row_id", F.col("features")[1].alias("price"))


@query("input_row_index", """
SELECT row_number() OVER () - 1 AS row_id, l_orderkey || ':' || l_linenumber AS key, l_extendedprice AS price FROM lineitem""")
def input_row_index(spark, sf):
    rows = input_row_ids(spark, f"{sf}/lineitem.parquet")
    return rows.select("row_id", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), F.col("l_extendedprice").alias("price"))


# a bounded sample over all rows, then its train side, as SQL
_TALL_SAMPLE = f"""{_TALL_SPLIT},
target AS (
  SELECT CAST(floor(least(greatest(0.3::DOUBLE * 128 * (SELECT count(*) FROM sides WHERE side = 'train'),
                             20000), 100000)) AS BIGINT) AS want, (SELECT count(*) FROM tall) AS n),
picked AS (
  SELECT row_id FROM tall, target
  WHERE (n <= want OR (row_id % greatest(1, n // want) = 0 AND row_id < greatest(1, n // want) * want))
    AND row_id // 128 IN (SELECT chunk_id FROM sides WHERE side = 'train'))"""


@query("fit_sample", f"""
WITH {b.TALL}{_TALL_SAMPLE} SELECT row_id FROM picked""")
def fit_sample(spark, sf):
    m = b.tall_matrix(spark, sf)
    return splits.fit_sample(m, b.split_of(spark, m, 128), 0.3, 20_000, 100_000).select("row_id")


@query("align_keys", f"""
WITH {b.TALL}, keyed AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row_id,
         l_orderkey || ':' || l_linenumber AS key FROM lineitem)
SELECT row_id, key, c1 AS price FROM keyed JOIN tall USING (row_id)""")
def align_keys(spark, sf):
    items = b.table(spark, sf, "lineitem").select(*b.TALL_ORDER)
    buckets = aligned_buckets(items.count())
    rows = with_row_id(items, b.TALL_ORDER, keep=("l_orderkey", "l_linenumber"))
    keys = rows.select("row_id", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"))
    stored = [stage_aligned(df, "row_id", buckets, "aligned") for df in (keys, b.tall_matrix(spark, sf))]
    return matrix.align(*stored).select("row_id", "key", F.col("features")[1].alias("price"))


# ---------------------------------------------------------------- profiles and moments

_PROFILE = f"""
SELECT col_id, min(CASE WHEN {_FINITE} THEN value END) AS col_min,
       max(CASE WHEN {_FINITE} THEN value END) AS col_max,
       count(*) FILTER (WHERE NOT {_FINITE}) AS invalid, count(*) AS n_rows
FROM cells GROUP BY col_id"""


@query("profile_columns", f"WITH {b.TALL}{_PROFILE}")
def profile_columns(spark, sf):
    return matrix.profile_columns(b.tall_matrix(spark, sf))


@query("profile_wide", f"WITH {b.WIDE}{_PROFILE}")
def profile_wide(spark, sf):
    return matrix.profile_columns(b.wide_matrix(spark, sf))


@query("invalid_columns", f"""
WITH {b.WIDE}
SELECT col_id FROM cells GROUP BY col_id
HAVING count(*) FILTER (WHERE NOT {_FINITE}) > 0.2::DOUBLE * count(*)
    OR count(*) FILTER (WHERE {_FINITE}) = 0""")
def invalid_columns(spark, sf):
    return matrix.invalid_columns(matrix.profile_columns(b.wide_matrix(spark, sf)))


@query("failure_counts", f"""
WITH {b.WIDE}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok = 0) AS failed, 0::BIGINT AS malformed
FROM (SELECT row_id, count(*) FILTER (WHERE {_FINITE}) AS ok FROM cells GROUP BY row_id)""")
def failure_counts(spark, sf):
    rows, seen = matrix.failure_counts(b.wide_matrix(spark, sf), b.WIDTH)
    rows.agg(F.count("*")).collect()
    n = seen.get
    return spark.createDataFrame([(n["rows"], n["failed"], n["malformed"])],
                                 "n_rows long, failed long, malformed long")


@query("masked_moments", f"""
WITH {b.TALL}{_TALL_SPLIT}
SELECT col_id, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std
FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train'
WHERE {_FINITE} GROUP BY col_id""")
def masked_moments(spark, sf):
    m = b.tall_matrix(spark, sf)
    return rounded(matrix.masked_moments(b.split_of(spark, m, 128).train(m)))


_CLEAN = f"""profile AS (
  SELECT col_id, min(CASE WHEN {_FINITE} THEN value END) AS lo, max(CASE WHEN {_FINITE} THEN value END) AS hi,
         count(*) FILTER (WHERE NOT {_FINITE}) AS bad, count(*) AS n FROM cells GROUP BY col_id),
clean AS (
  SELECT row_id, col_id, {_FINITE} AS ok,
         CASE WHEN value IS NULL THEN 0.0::DOUBLE WHEN value = 'Infinity'::DOUBLE THEN hi
              WHEN value = '-Infinity'::DOUBLE THEN lo ELSE value END AS value
  FROM cells JOIN profile USING (col_id) WHERE lo IS NOT NULL AND bad <= 0.2::DOUBLE * n)"""


def _cleaned(m):
    stats = matrix.profile_columns(m).orderBy("col_id").collect()
    return matrix.clean_cells(m, [x["col_min"] for x in stats], [x["col_max"] for x in stats])


@query("clean_cells", f"""
WITH {b.TALL}, {_CLEAN.replace('bad <= 0.2::DOUBLE * n', 'true')}
SELECT row_id, col_id, value FROM clean""")
def clean_cells(spark, sf):
    return _long(_cleaned(b.tall_matrix(spark, sf)), 8)


@query("imputed_moments", f"""
WITH {b.TALL}{_TALL_SPLIT}, {_CLEAN.replace('bad <= 0.2::DOUBLE * n', 'true')}
SELECT col_id, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std
FROM clean JOIN sides ON row_id // 128 = chunk_id AND side = 'train' GROUP BY col_id""")
def imputed_moments(spark, sf):
    m = b.tall_matrix(spark, sf)
    return rounded(matrix.imputed_moments(b.split_of(spark, m, 128).train(_cleaned(m))))


@query("percentiles", f"""
WITH {b.TALL}{_TALL_SPLIT}
SELECT col_id, {r('quantile_cont(value, 0.01)')} AS p01, {r('quantile_cont(value, 0.99)')} AS p99
FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train' WHERE {_FINITE} GROUP BY col_id""")
def percentiles(spark, sf):
    m = b.tall_matrix(spark, sf)
    train = b.split_of(spark, m, 128).train(m)
    finite = train.withColumn("features", F.transform("features", lambda x: F.when(cells.is_finite(x), x)))
    p = F.col("percentiles")
    return rounded(matrix.percentiles(finite, [0.01, 0.99]).select(
        "col_id", p[0].alias("p01"), p[1].alias("p99")))


@query("low_variance", f"""
WITH {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}
SELECT col_id, {r('var_pop(value)', 9)} AS variance
FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train'
GROUP BY col_id HAVING var_pop(value) <= 1.5e-2::DOUBLE""")
def low_variance(spark, sf):
    m = b.wide_matrix(spark, sf)
    train = b.split_of(spark, m, b.WIDE_CHUNK).train(_cleaned_valid(m))
    flat = matrix.low_variance_columns(train, 1.5e-2)
    # positions are among the columns that survived the invalid drop
    return rounded(flat.withColumn("col_id", F.when(F.col("col_id") >= 7, F.col("col_id") + 1).otherwise(F.col("col_id"))), 9)


def _cleaned_valid(m):
    stats = matrix.profile_columns(m).orderBy("col_id").collect()
    keep = [x["col_id"] for x in stats if x["col_min"] is not None]
    return matrix.clean_cells(
        matrix.select_columns(m, keep), [stats[i]["col_min"] for i in keep], [stats[i]["col_max"] for i in keep])


@query("winsorize", f"""
WITH {b.TALL}{_TALL_SPLIT}, limits AS MATERIALIZED (
  SELECT col_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
  FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train' WHERE {_FINITE} GROUP BY col_id)
SELECT row_id, col_id, CASE WHEN value IS NOT NULL THEN {r('greatest(least(value, hi), lo)', 8)} END AS value
FROM cells JOIN limits USING (col_id)""")
def winsorize(spark, sf):
    m = b.tall_matrix(spark, sf)
    train = b.split_of(spark, m, 128).train(m)
    finite = train.withColumn("features", F.transform("features", lambda x: F.when(cells.is_finite(x), x)))
    cuts = matrix.percentiles(finite, [0.01, 0.99]).orderBy("col_id").collect()
    clipped = matrix.clip_columns(m, [c["percentiles"][0] for c in cuts], [c["percentiles"][1] for c in cuts])
    return _long(clipped, 8)


@query("zscore", f"""
WITH {b.TALL}{_TALL_SPLIT}, moments AS MATERIALIZED (
  SELECT col_id, avg(value) AS mean, stddev_samp(value) AS std
  FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train' WHERE {_FINITE} GROUP BY col_id)
SELECT row_id, col_id, CASE WHEN {_FINITE} THEN {r('(value - mean) / std')} END AS value
FROM cells JOIN moments USING (col_id)""")
def zscore(spark, sf):
    m = b.tall_matrix(spark, sf)
    stats = matrix.masked_moments(b.split_of(spark, m, 128).train(m)).orderBy("col_id").collect()
    scaled = matrix.zscore_columns(m.withColumn("raw", F.col("features")),
                                   [x["mean"] for x in stats], [x["std"] for x in stats])
    back = matrix.rescatter_missing(F.col("raw"), F.col("features"), len(stats))
    return _long(scaled.select("row_id", back.alias("features")))


@query("select_columns", f"""
WITH {b.TALL} SELECT row_id, CASE col_id WHEN 3 THEN 0 ELSE 1 END AS col_id, value
FROM cells WHERE col_id IN (1, 3)""")
def select_columns(spark, sf):
    return _long(matrix.select_columns(b.tall_matrix(spark, sf), [3, 1]), 8)


@query("log_scale", f"""
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN {r('log10(c_acctbal)')} END AS "LOG_c_acctbal"
FROM customer""")
def log_scale(spark, sf):
    return rounded(cells.log_scale(b.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


# ---------------------------------------------------------------- power, correlation, PCA

@query("yeo_johnson", f"""
SELECT c_custkey, {r('''CASE WHEN x >= 0 THEN (pow(x + 1, 0.5::DOUBLE) - 1) / 0.5::DOUBLE
        ELSE -(pow(1 - x, 1.5::DOUBLE) - 1) / 1.5::DOUBLE END''')} AS half,
       {r("CASE WHEN x >= 0 THEN ln(1 + x) ELSE -(pow(1 - x, 2::DOUBLE) - 1) / 2 END")} AS zero,
       {r("CASE WHEN x >= 0 THEN (pow(x + 1, 2::DOUBLE) - 1) / 2 ELSE -ln(1 - x) END")} AS two
FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)""")
def yeo_johnson_apply(spark, sf):
    x = F.col("c_acctbal") / 1000
    return rounded(b.table(spark, sf, "customer").select(
        "c_custkey", yeo_johnson(x, F.lit(0.5)).alias("half"),
        yeo_johnson(x, F.lit(0.0)).alias("zero"), yeo_johnson(x, F.lit(2.0)).alias("two")))


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf):
    m = b.tall_matrix(spark, sf)
    return rounded(power.fit_yeo_johnson(b.split_of(spark, m, 128).train(_cleaned(m))), 4)


@query("correlation_pairs", f"""
WITH {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}, train AS (
  SELECT row_id, col_id, value FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train'),
scaled AS (
  SELECT row_id, t.col_id, (value - mean) / CASE WHEN var > 1e-12::DOUBLE THEN sqrt(var) ELSE 1 END AS z
  FROM train t JOIN (SELECT col_id, avg(value) AS mean, var_samp(value) AS var FROM train GROUP BY col_id) USING (col_id))
SELECT a.col_id AS i, c.col_id AS j,
       {r('greatest(least(sum(a.z * c.z) / (count(*) - 1), 1), -1)', 8)} AS r
FROM scaled a JOIN scaled c ON a.row_id = c.row_id AND a.col_id < c.col_id GROUP BY ALL""")
def correlation_pairs(spark, sf):
    m = b.wide_matrix(spark, sf)
    train = stage(b.split_of(spark, m, b.WIDE_CHUNK).train(_cleaned_valid(m)), "train")
    pairs = matrix.correlation_pairs(train, b.WIDTH - 1)
    name = lambda c: F.when(F.col(c) >= 7, F.col(c) + 1).otherwise(F.col(c)).alias(c)
    return rounded(pairs.select(name("i"), name("j"), "r"), 8)


_PAIRS = f"""
WITH RECURSIVE {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}, train AS (
  SELECT row_id, col_id, value FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train'),
scaled AS (
  SELECT row_id, t.col_id, (value - mean) / CASE WHEN var > 1e-12::DOUBLE THEN sqrt(var) ELSE 1 END AS z
  FROM train t JOIN (SELECT col_id, avg(value) AS mean, var_samp(value) AS var FROM train GROUP BY col_id) USING (col_id)),
close AS (
  SELECT a.col_id AS i, c.col_id AS j FROM scaled a JOIN scaled c ON a.row_id = c.row_id AND a.col_id < c.col_id
  GROUP BY ALL HAVING abs(sum(a.z * c.z) / (count(*) - 1)) > 0.2::DOUBLE),
near AS (SELECT j, list(i) AS befores FROM close GROUP BY j),
scan(j, gone) AS (
  SELECT -1, []::INTEGER[]
  UNION ALL
  SELECT s.j + 1, CASE WHEN len(list_filter(coalesce(n.befores, []), lambda x: NOT list_contains(s.gone, x))) > 0
                       THEN list_append(s.gone, s.j + 1) ELSE s.gone END
  FROM scan s LEFT JOIN near n ON n.j = s.j + 1 WHERE s.j < 63)
SELECT unnest(gone)::INTEGER AS col_id FROM scan WHERE j = 63"""


@query("drop_correlated", _PAIRS)
def drop_correlated(spark, sf):
    # a low threshold, so that chains of close columns occur
    m = b.wide_matrix(spark, sf)
    train = stage(b.split_of(spark, m, b.WIDE_CHUNK).train(_cleaned_valid(m)), "train")
    gone = matrix.drop_correlated(matrix.correlation_pairs(train, b.WIDTH - 1, 0.2), 0.2)
    return spark.createDataFrame([(c + (c >= 7),) for c in gone], "col_id int")


# ---------------------------------------------------------------- prescaling

def _prescaled_sql(limits: bool) -> str:
    clip = "greatest(least(value, hi), lo)" if limits else "value"
    cuts = f""", limits AS (
  SELECT col_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
  FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train' GROUP BY col_id)""" if limits else ""
    join = "JOIN limits USING (col_id)" if limits else ""
    return f"""
WITH {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}{cuts},
shaped AS (SELECT row_id, col_id, ok, {clip} AS value FROM clean {join}),
moments AS (
  SELECT col_id, avg(value) AS mean, CASE WHEN stddev_samp(value) > 1e-12::DOUBLE THEN stddev_samp(value) ELSE 1 END AS std
  FROM shaped JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train' GROUP BY col_id)
SELECT row_id, (col_id - CASE WHEN col_id > 7 THEN 1 ELSE 0 END)::INTEGER AS col_id,
       CASE WHEN ok THEN {r('(value - mean) / std', 5)} END AS value
FROM shaped JOIN moments USING (col_id)"""


def _prescaled(spark, sf, recipe):
    m = stage(b.wide_matrix(spark, sf), "wide")
    return prescale.fit_recipe(m, b.split_of(spark, m, b.WIDE_CHUNK), recipe).transform(m)


@query("prescale_minimal", _prescaled_sql(False))
def prescale_minimal(spark, sf):
    return _long(_prescaled(spark, sf, RECIPES["minimal"]), 5)


@query("prescale_order_fix", _prescaled_sql(True))
def prescale_order_fix(spark, sf):
    return _long(_prescaled(spark, sf, RECIPES["order_fix"]), 5)


@query("prescale_full")
def prescale_full(spark, sf):
    return _long(_prescaled(spark, sf, RECIPES["full"]), 4)


@query("prescale_drops", f"""
WITH RECURSIVE {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}, train AS (
  SELECT row_id, col_id, value FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train'),
limits AS (SELECT col_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM train GROUP BY col_id),
clipped AS (SELECT row_id, col_id, greatest(least(value, hi), lo) AS value FROM train JOIN limits USING (col_id)),
moments AS (SELECT col_id, avg(value) AS mean, var_samp(value) AS var, var_pop(value) AS pop FROM clipped GROUP BY col_id),
scaled AS (
  SELECT row_id, c.col_id, (value - mean) / CASE WHEN var > 1e-12::DOUBLE THEN sqrt(var) ELSE 1 END AS z
  FROM clipped c JOIN moments USING (col_id)),
close AS (
  SELECT a.col_id AS i, c.col_id AS j FROM scaled a JOIN scaled c ON a.row_id = c.row_id AND a.col_id < c.col_id
  GROUP BY ALL HAVING abs(sum(a.z * c.z) / (count(*) - 1)) > 0.98::DOUBLE),
near AS (SELECT j, list(i) AS befores FROM close GROUP BY j),
scan(j, gone) AS (
  SELECT -1, []::INTEGER[]
  UNION ALL
  SELECT s.j + 1, CASE WHEN len(list_filter(coalesce(n.befores, []), lambda x: NOT list_contains(s.gone, x))) > 0
                       THEN list_append(s.gone, s.j + 1) ELSE s.gone END
  FROM scan s LEFT JOIN near n ON n.j = s.j + 1 WHERE s.j < 63)
SELECT 'plus_drop_corr' AS recipe, 'correlated' AS reason, unnest(gone)::INTEGER AS col_id FROM scan WHERE j = 63
UNION ALL SELECT 'plus_drop_low_var', 'low_variance', col_id FROM moments WHERE pop <= 1e-8::DOUBLE
UNION ALL SELECT recipe, 'invalid', col_id FROM profile, (SELECT unnest(['minimal', 'order_fix', 'plus_drop_corr', 'plus_drop_low_var']) AS recipe)
          WHERE lo IS NULL OR bad > 0.2::DOUBLE * n""")
def prescale_drops(spark, sf):
    m = stage(b.wide_matrix(spark, sf), "wide")
    split = b.split_of(spark, m, b.WIDE_CHUNK)
    rows = []
    for name in ("minimal", "order_fix", "plus_drop_corr", "plus_drop_low_var"):
        model = prescale.fit_recipe(m, split, RECIPES[name], name)
        for reason, gone in (("invalid", model.gone("invalid")), ("correlated", model.gone("correlated")),
                             ("low_variance", model.gone("low_variance"))):
            rows += [(name, reason, int(c)) for c in gone]
    return spark.createDataFrame(rows, "recipe string, reason string, col_id int")


@query("prescale_summaries")
def prescale_summaries(spark, sf):
    m = stage(b.wide_matrix(spark, sf), "wide")
    split = b.split_of(spark, m, b.WIDE_CHUNK)
    out = None
    for name, recipe in RECIPES.items():
        part = prescale.fit_recipe(m, split, recipe, name).summary(spark)
        out = part if out is None else out.unionByName(part)
    return out


@query("prescale_tall", f"""
WITH {b.TALL}{_TALL_SPLIT}, {_CLEAN.replace('0.2::DOUBLE', '0.5::DOUBLE').replace('clean AS (', 'clean AS MATERIALIZED (')}, limits AS MATERIALIZED (
  SELECT col_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
  FROM clean JOIN sides ON row_id // 128 = chunk_id AND side = 'train' GROUP BY col_id),
shaped AS MATERIALIZED (SELECT row_id, col_id, ok, greatest(least(value, hi), lo) AS value FROM clean JOIN limits USING (col_id)),
moments AS (
  SELECT col_id, avg(value) AS mean, stddev_samp(value) AS std
  FROM shaped JOIN sides ON row_id // 128 = chunk_id AND side = 'train' GROUP BY col_id)
SELECT row_id, col_id, CASE WHEN ok THEN {r('(value - mean) / std', 5)} END AS value
FROM shaped JOIN moments USING (col_id)""")
def prescale_tall(spark, sf):
    m = b.tall_matrix(spark, sf)
    model = prescale.fit_recipe(m, b.split_of(spark, m, 128), (DropInvalid(0.5), *ORDER_FIX[1:]))
    return _long(model.transform(m), 5)


@query("legacy_rescale", f"""
WITH {b.TALL}{_TALL_SPLIT}, moments AS MATERIALIZED (
  SELECT col_id, avg(value) AS mean, stddev_samp(value) AS std
  FROM cells JOIN sides ON row_id // 128 = chunk_id AND side = 'train' WHERE {_FINITE} GROUP BY col_id)
SELECT row_id, side, col_id,
       CASE WHEN value IS NOT NULL THEN {r('(greatest(least(value, mean + 6 * std), mean - 6 * std) - mean) / std')} END AS value
FROM cells JOIN sides ON row_id // 128 = chunk_id JOIN moments USING (col_id)""")
def legacy_rescale(spark, sf):
    m = b.tall_matrix(spark, sf)
    scaled = prescale.legacy_rescale(m, b.split_of(spark, m, 128))
    return rounded(scaled.select("row_id", "side", F.posexplode("features").alias("col_id", "value")))


@query("pca_targets")
def pca_targets(spark, sf):
    m = stage(_prescaled(spark, sf, RECIPES["order_fix"]), "scaled")
    model = pca.fit_pca_targets(m, b.split_of(spark, m, b.WIDE_CHUNK), "wide")
    return _long(model.transform(m, 0.80), 4)


@query("pca_summary")
def pca_summary(spark, sf):
    m = stage(_prescaled(spark, sf, RECIPES["order_fix"]), "scaled")
    return rounded(pca.fit_pca_targets(m, b.split_of(spark, m, b.WIDE_CHUNK), "wide").summary(spark))


@query("components_for", f"""
WITH {b.WIDE}, {_CLEAN}, shares AS (
  SELECT col_id, var_pop(value) / sum(var_pop(value)) OVER () AS share
  FROM clean GROUP BY col_id),
running AS (
  SELECT row_number() OVER (ORDER BY share DESC, col_id) AS comp,
         sum(share) OVER (ORDER BY share DESC, col_id ROWS UNBOUNDED PRECEDING) AS total FROM shares)
SELECT t AS threshold, min(comp)::INTEGER AS n_components
FROM running, (SELECT unnest([0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS t) WHERE total >= t GROUP BY t""")
def components_for(spark, sf):
    m = _cleaned_valid(b.wide_matrix(spark, sf))
    spread = long_cells(m).groupBy("col_id").agg(F.var_pop("value").alias("v"))
    spread = stage(spread, "spread")
    total = spread.agg(F.sum("v")).first()[0]
    shares = with_row_id(spread.withColumn("down", -F.col("v")), ["down", "col_id"], "comp").select(
        (F.col("comp") + 1).cast("int").alias("comp"), (F.col("v") / total).alias("share"))
    return pca.components_for(shares, [0.8, 0.9, 0.95])


# ---------------------------------------------------------------- featurizing

@query("text_descriptors", f"""
WITH split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: length(w) > 0) AS words
  FROM documents)
SELECT doc_id, length(text)::DOUBLE AS chars, len(words)::DOUBLE AS words,
       {r("list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words)")} AS mean_word,
       {r("len(list_distinct(words))::DOUBLE / len(words)")} AS distinct_share,
       {r("length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / length(text)")} AS digit_share,
       {r("length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / length(text)")} AS upper_share,
       len(string_split(text, chr(10)))::DOUBLE AS lines
FROM split""")
def text_descriptors(spark, sf):
    made = b.table(spark, sf, "documents").select(
        "doc_id", featurize.text_descriptors(F.col("text")).alias("f"))
    return rounded(made.select("doc_id", *[
        F.col("f")[i].alias(n) for i, n in enumerate(featurize.TEXT_DESCRIPTORS)]))


@query("hashed_bits", """
WITH chars AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS c FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(c) < 3 THEN c ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END) AS g FROM chars),
bits AS (SELECT DISTINCT doc_id, ('0x' || left(md5(g), 8))::BIGINT % 2048 AS bit FROM (SELECT DISTINCT doc_id, g FROM grams WHERE g <> ''))
SELECT doc_id, count(bit) AS set_bits, coalesce(sum(bit), 0)::BIGINT AS positions FROM documents LEFT JOIN bits USING (doc_id) GROUP BY doc_id""")
def hashed_bits(spark, sf):
    made = b.table(spark, sf, "documents").select("doc_id", featurize.hashed_bits(F.col("text")).alias("bits"))
    total = F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("doc_id", F.size("bits").cast("long").alias("set_bits"), total.alias("positions"))


def _letter_shares(keys):
    """Example block function: shares of the letters a to f; an empty key cannot be scored."""
    import numpy as np

    rows = []
    for key in keys:
        if len(key.strip()) == 0 or "\x00" in key:
            raise ValueError("nothing to score")
        rows.append([key.count(c) / len(key) for c in "abcdef"])
    return np.array(rows)


@query("featurize_blocks", f"""
SELECT doc_id, (i - 1)::INTEGER AS col_id,
       {r("(length(text) - length(replace(text, c, '')))::DOUBLE / length(text)")} AS value
FROM documents, (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS c, unnest([1, 2, 3, 4, 5, 6]) AS i)""")
def featurize_blocks(spark, sf):
    made = featurize.featurize(b.table(spark, sf, "documents").select("doc_id", "text"), "text", _letter_shares, 6)
    return rounded(made.select("doc_id", F.posexplode("features").alias("col_id", "value")))


@query("coerce_width", """
SELECT doc_id, len(string_split(text, chr(10))) <> 2 AS malformed,
       CASE WHEN len(string_split(text, chr(10))) = 2 THEN length(string_split(text, chr(10))[1])::DOUBLE END AS first_line
FROM documents""")
def coerce_width(spark, sf):
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.length(s).cast("double"))
    made = featurize.coerce_width(b.table(spark, sf, "documents").select("doc_id", lines.alias("features")), 2)
    return made.select("doc_id", "malformed", F.col("features")[0].alias("first_line"))


@query("concat_blocks", """
SELECT doc_id, (i - 1)::INTEGER AS col_id,
       CASE WHEN i = 1 THEN length(text)::DOUBLE WHEN i = 2 THEN n_chars::DOUBLE
            WHEN len(string_split(text, chr(10))) = 2 THEN length(string_split(text, chr(10))[i - 2])::DOUBLE END AS value
FROM documents, range(1, 5) t(i)""")
def concat_blocks(spark, sf):
    sizes = F.array(F.length("text").cast("double"), F.col("n_chars").cast("double"))
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.length(s).cast("double"))
    made = b.table(spark, sf, "documents").select(
        "doc_id", featurize.concat_blocks([(sizes, 2), (lines, 2)]).alias("features"))
    return made.select("doc_id", F.posexplode("features").alias("col_id", "value"))


def _by_spread_sql(raw: bool) -> str:
    """Clipping by spread, or scaling quantile-clipped cells with the raw moments."""
    limits = """SELECT col_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM train GROUP BY col_id""" if raw else \
        """SELECT col_id, avg(value) - 6 * stddev_samp(value) AS lo, avg(value) + 6 * stddev_samp(value) AS hi FROM train GROUP BY col_id"""
    source = "train" if raw else "train JOIN limits USING (col_id)"
    value = "value" if raw else "greatest(least(value, hi), lo)"
    return f"""
WITH {b.WIDE}{_WIDE_SPLIT}, {_CLEAN}, train AS MATERIALIZED (
  SELECT row_id, col_id, value FROM clean JOIN sides ON row_id // {b.WIDE_CHUNK} = chunk_id AND side = 'train'),
limits AS MATERIALIZED ({limits}),
moments AS MATERIALIZED (
  SELECT col_id, avg({value}) AS mean, CASE WHEN stddev_samp({value}) > 1e-12::DOUBLE THEN stddev_samp({value}) ELSE 1 END AS std
  FROM {source} GROUP BY col_id)
SELECT row_id, (col_id - CASE WHEN col_id > 7 THEN 1 ELSE 0 END)::INTEGER AS col_id,
       CASE WHEN ok THEN {r('(greatest(least(value, hi), lo) - mean) / std', 5)} END AS value
FROM clean JOIN limits USING (col_id) JOIN moments USING (col_id)"""


@query("prescale_by_spread", _by_spread_sql(False))
def prescale_by_spread(spark, sf):
    return _long(_prescaled(spark, sf, (DropInvalid(), ClipSpread(), Scale())), 5)


@query("prescale_raw_scale", _by_spread_sql(True))
def prescale_raw_scale(spark, sf):
    return _long(_prescaled(spark, sf, (*ORDER_FIX[:-1], Scale(raw=True))), 5)
