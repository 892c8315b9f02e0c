"""Queries that build report cards from the predictions, through the metrics table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.cells import ratio
from ..operators import cards, keys, significance
from ..session import stage
from . import bindings as b
from . import tails
from .catalog import query, r, rounded
from .names import SAMPLE

_SHOWN = "flavor IN ('f0', 'f2', 'f3')"
_RANK = """CASE dataset WHEN 'plant_potency' THEN 0 WHEN 'plant' THEN 1 WHEN 'mill' THEN 2 WHEN 'lab' THEN 3
     WHEN 'press_line' THEN 4 WHEN 'annex' THEN 5 WHEN 'gauge' THEN 6 WHEN 'dock' THEN 7 ELSE 8 END"""
_ORDERED = f"""ordered AS (
  SELECT dataset, endpoint, row, row_number() OVER (ORDER BY {_RANK}, endpoint, row) - 1 AS row_ord
  FROM (SELECT DISTINCT dataset, endpoint, row FROM frozen))"""
_CELLS = f"""cells AS (
  SELECT row, flavor, avg(mae) AS value, stddev_samp(mae) AS std, count(mae) AS n FROM frozen WHERE {_SHOWN} GROUP BY ALL)"""
_BASE = "base AS (SELECT row, avg(mae) AS base, stddev_samp(mae) AS base_std FROM frozen WHERE flavor = 'f1' GROUP BY row)"
_DELTA = f"{_CELLS}, {_BASE}, deltas AS (SELECT c.*, base, 100 * (value - base) / base AS delta FROM cells c LEFT JOIN base USING (row))"


# ---------------------------------------------------------------- labels

@query("parse_labels", f"""
WITH {b.PRED}
SELECT label, regexp_replace(label, '__s[0-9]+$', '') AS base, CAST(regexp_extract(label, '__s([0-9]+)$', 1) AS BIGINT) AS seed,
       CASE WHEN starts_with(label, 'lr_') THEN 'reduced' ELSE 'frozen' END AS mode,
       regexp_extract(label, '(f[0-9])__s', 1) AS flavor, count(*) AS n
FROM pred GROUP BY ALL""")
def parse_labels(spark, sf):
    c = F.col("label")
    return b.predictions(spark, sf).groupBy("label").agg(F.count("*").alias("n")).select(
        "label", labels.seed_base(c).alias("base"), labels.seed_number(c).alias("seed"),
        labels.mode_prefix(c).alias("mode"), labels.mode_prefix_flavor(c).alias("flavor"), "n")


@query("mode_suffixes", """
WITH made AS (SELECT 'f' || (l_suppkey % 4) || '__s' || l_linenumber AS base,
                     CASE l_returnflag WHEN 'A' THEN 'reduced' WHEN 'N' THEN 'frozen' ELSE 'unlocked' END AS mode FROM lineitem)
SELECT base, mode, CASE mode WHEN 'frozen' THEN base ELSE base || '__' || mode END AS label,
       base AS parsed_base, mode AS parsed_mode, 'ctl' || CASE mode WHEN 'frozen' THEN '' ELSE '_' || mode END AS baseline,
       count(*) AS n FROM made GROUP BY ALL""")
def mode_suffixes(spark, sf):
    flag = F.col("l_returnflag")
    made = b.table(spark, sf, "lineitem").select(
        labels.seed_label(F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")), F.col("l_linenumber")).alias("base"),
        F.when(flag == "A", "reduced").when(flag == "N", "frozen").otherwise("unlocked").alias("mode"))
    counted = made.groupBy("base", "mode").agg(F.count("*").alias("n"))
    labelled = counted.withColumn("label", labels.mode_label(F.col("base"), F.col("mode")))
    return labelled.select("base", "mode", "label", labels.mode_suffix_base(F.col("label")).alias("parsed_base"),
                           labels.mode_suffix(F.col("label")).alias("parsed_mode"),
                           labels.baseline_label("ctl", F.col("mode")).alias("baseline"), "n")


@query("namespaces", """
WITH made AS (SELECT 'ablation_' || lower(p_type) || '__s' || (p_size % 5) AS ablation,
                     'ext__' || lower(p_brand) AS ext, 'backbone_' || lower(p_type) || '_st' AS stem FROM part)
SELECT ablation, ext, stem, regexp_extract(ablation, '^ablation_(.*)__s', 1) AS arm,
       regexp_replace(ext, '^ext__', '') AS bare, regexp_replace(stem, '^backbone_', '') AS endpoint, count(*) AS n
FROM made GROUP BY ALL""")
def namespaces(spark, sf):
    part = b.table(spark, sf, "part")
    kind = F.lower("p_type")
    made = part.select(
        F.concat(F.lit("ablation_"), kind, F.lit("__s"), (F.col("p_size") % 5).cast("string")).alias("ablation"),
        F.concat(F.lit("ext__"), F.lower("p_brand")).alias("ext"),
        F.concat(F.lit("backbone_"), kind, F.lit("_st")).alias("stem"),
    ).groupBy("ablation", "ext", "stem").agg(F.count("*").alias("n"))
    return made.select("ablation", "ext", "stem", labels.ablation_name(F.col("ablation")).alias("arm"),
                       labels.strip_prefix(F.col("ext"), "ext__").alias("bare"),
                       labels.endpoint_of_template(F.col("stem"), "backbone").alias("endpoint"), "n")


@query("dataset_of", f"""
WITH {b.FRAME} SELECT recipe, dataset, count(*) AS n FROM named GROUP BY ALL""")
def dataset_of(spark, sf):
    return b.metrics(spark, sf).groupBy("recipe").agg(F.count("*").alias("n")).select(
        "recipe", labels.dataset_of(F.col("recipe"), SAMPLE).alias("dataset"), "n")


# ---------------------------------------------------------------- rows

@query("prepare_rows", f"""
WITH {b.FRAME} SELECT flavor, seed, recipe, endpoint, dataset, row, n_test FROM frame""")
def prepare_rows(spark, sf):
    return b.frame(spark, sf).select("flavor", "seed", "recipe", "endpoint", "dataset", "row", "n_test")


@query("order_rows", f"""
WITH {b.FRAME}, {_ORDERED} SELECT * FROM ordered""")
def order_rows(spark, sf):
    return cards.order_rows(b.frozen(spark, sf), SAMPLE)


_GROUPS = """SELECT min(row_ord) AS start, max(row_ord) + 1 AS "end", arg_min(dataset, row_ord) AS source
FROM (SELECT *, sum(new) OVER (ORDER BY row_ord) AS run FROM (
  SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER (ORDER BY row_ord) THEN 1 ELSE 0 END AS new
  FROM (SELECT *, {name} AS name FROM ordered))) GROUP BY run"""


@query("source_groups", f"WITH {b.FRAME}, {_ORDERED} {_GROUPS.format(name='dataset')}")
def source_groups(spark, sf):
    return cards.source_groups(cards.order_rows(b.frozen(spark, sf), SAMPLE))


@query("merge_groups", f"""WITH {b.FRAME}, {_ORDERED} {_GROUPS.format(
    name="CASE WHEN dataset LIKE 'plant%' THEN 'Plant' ELSE dataset END")}""")
def merge_groups(spark, sf):
    return cards.merge_groups(cards.order_rows(b.frozen(spark, sf), SAMPLE), SAMPLE)


@query("row_labels", f"""
WITH {b.FRAME}, {_ORDERED}
SELECT row, CASE WHEN dataset = 'gauge' THEN 'Lab (cluster) ' ELSE '' END
       || replace(CASE endpoint WHEN 'LOG_rate_A' THEN 'rate A' ELSE endpoint END
                  || CASE WHEN row LIKE '%(%' THEN ' (' || split_part(row, ' (', 2) ELSE '' END, '_', ' ') AS label,
       CASE dataset WHEN 'plant' THEN 'Plant' || chr(10) || '(predefined)' WHEN 'plant_potency' THEN 'Plant' || chr(10) || '(predefined)'
            WHEN 'press_line' THEN 'Press line' || chr(10) || '(cluster)' WHEN 'gauge' THEN ''
            ELSE dataset || chr(10) || '(cluster)' END AS box
FROM ordered""")
def row_labels(spark, sf):
    rows = b.frozen(spark, sf).select("row", "dataset").distinct()
    return rows.select("row", text.row_label(F.col("row"), SAMPLE).alias("label"), text.group_label(F.col("dataset"), SAMPLE).alias("box"))


@query("filter_mode", f"""
WITH {b.FRAME}
SELECT substring(flavor, 13) AS flavor, seed, row, {r('r2')} AS r2 FROM frame WHERE starts_with(flavor, 'lr_reduced__')""")
def filter_mode(spark, sf):
    return rounded(cards.filter_mode(b.frame(spark, sf), "reduced").select("flavor", "seed", "row", "r2"))


@query("exclude_recipes", f"""
WITH {b.FRAME}, kept AS (SELECT * FROM named WHERE recipe NOT IN ('press_mt', 'gauge_st'))
SELECT flavor, seed, recipe, dataset || ' · ' || endpoint AS row, {r('r2')} AS r2 FROM kept""")
def exclude_recipes(spark, sf):
    # identities are built after the exclusion, so a recipe left alone sheds its suffix
    kept = keys.exclude_recipes(b.metrics(spark, sf), ["press_mt", "gauge_st"])
    return rounded(cards.prepare_rows(labels.collapse_seeds(kept), SAMPLE).select("flavor", "seed", "recipe", "row", "r2"))


# ---------------------------------------------------------------- cells

@query("seed_matrix", f"""
WITH {b.FRAME}, {_CELLS} SELECT row, flavor, {r('value', 4)} AS value, {r('std', 4)} AS std, n FROM cells""")
def seed_matrix(spark, sf):
    return rounded(cards.seed_matrix(b.frozen(spark, sf), "mae", b.SHOWN), 4)


@query("seed_pivot", f"""
WITH {b.FRAME}
SELECT row, {', '.join(f"{r(f'avg(r2) FILTER (WHERE flavor = {a!r})')} AS {a}" for a in b.ARMS)} FROM frozen GROUP BY row""")
def seed_pivot(spark, sf):
    return rounded(cards.seed_matrix(b.frozen(spark, sf), "r2", b.ARMS, pivot=True))


@query("reference_series", f"""
WITH {b.FRAME}, {_BASE} SELECT row, {r('base', 4)} AS base, {r('base_std', 4)} AS base_std FROM base""")
def reference_series(spark, sf):
    return rounded(cards.reference_series(b.frozen(spark, sf), b.CONTROL, "mae"), 4)


def _deltas(spark, sf):
    f = b.frozen(spark, sf)
    base = cards.reference_series(f, b.CONTROL, "mae")
    return f, base, cards.delta_matrix(cards.seed_matrix(f, "mae", b.SHOWN), base)


@query("with_baseline", f"""
WITH {b.FRAME}, {_DELTA} SELECT row, flavor, {r('value', 4)} AS value, {r('base', 4)} AS base FROM deltas""")
def with_baseline(spark, sf):
    f = b.frozen(spark, sf)
    cells = cards.with_baseline(cards.seed_matrix(f, "mae", b.SHOWN), cards.reference_series(f, b.CONTROL, "mae"))
    return rounded(cells.select("row", "flavor", "value", "base"), 4)


@query("delta_matrix", f"""
WITH {b.FRAME}, {_DELTA} SELECT row, flavor, {r('delta')} AS delta FROM deltas""")
def delta_matrix(spark, sf):
    return rounded(_deltas(spark, sf)[2].select("row", "flavor", "delta"))


@query("delta_std", f"""
WITH {b.FRAME}, {_CELLS}, {_BASE}
SELECT row, flavor, {r('100 * sqrt(pow(std / base, 2) + pow(value * base_std / (base * base), 2))')} AS delta_std
FROM cells JOIN base USING (row)""")
def delta_std(spark, sf):
    f = b.frozen(spark, sf)
    made = cards.delta_std(cards.seed_matrix(f, "mae", b.SHOWN), cards.reference_series(f, b.CONTROL, "mae"))
    return rounded(made.select("row", "flavor", "delta_std"))


@query("complete_grid", f"""
WITH {b.FRAME}, {_ORDERED}, sparse AS (
  SELECT row, flavor, avg(r2) AS value FROM frozen WHERE flavor <> 'f2' OR recipe <> 'gauge_st' GROUP BY ALL)
SELECT row, row_ord, (col - 1)::INTEGER AS col_ord, flavors[col] AS flavor, {r('value')} AS value
FROM (SELECT row, row_ord, ['f0', 'f1', 'f2', 'f3'] AS flavors, unnest([1, 2, 3, 4]) AS col FROM ordered) g
LEFT JOIN sparse s ON g.row = s.row AND s.flavor = flavors[col]""".replace("SELECT row, row_ord, (col", "SELECT g.row, row_ord, (col"))
def complete_grid(spark, sf):
    f = b.frozen(spark, sf)
    sparse = f.filter("flavor <> 'f2' or recipe <> 'gauge_st'").groupBy("row", "flavor").agg(F.avg("r2").alias("value"))
    grid = cards.complete_grid(sparse, cards.order_rows(f, SAMPLE).select("row", "row_ord"), b.ARMS)
    return rounded(grid.select("row", "row_ord", "col_ord", "flavor", "value"))


@query("append_average", f"""
WITH {b.FRAME}, {_CELLS}
SELECT row, flavor, {r('value', 4)} AS value FROM cells
UNION ALL SELECT 'AVERAGE', flavor, {r('avg(value)', 4)} FROM cells GROUP BY flavor""")
def append_average(spark, sf):
    return rounded(cards.append_average(cards.seed_matrix(b.frozen(spark, sf), "mae", b.SHOWN)), 4)


@query("scale_extent", f"""
WITH {b.FRAME}, {_DELTA}
SELECT {r('least(greatest(max(abs(v)), 1e-6), 25)')} AS extent
FROM (SELECT delta AS v FROM deltas UNION ALL SELECT avg(delta) FROM deltas GROUP BY flavor)""")
def scale_extent(spark, sf):
    return rounded(cards.scale_extent(_deltas(spark, sf)[2]))


_PER_SEED = """per_seed AS (
  SELECT flavor, seed, avg(m) AS value FROM (
    SELECT flavor, coalesce(seed, -1) AS seed, row, avg({expr}) AS m FROM {src} GROUP BY ALL) GROUP BY ALL)"""


@query("per_seed_average", f"""
WITH {b.FRAME}, {_PER_SEED.format(expr='r2', src='frozen')} SELECT flavor, seed, {r('value')} AS value FROM per_seed""")
def per_seed_average(spark, sf):
    f = b.frozen(spark, sf)
    return rounded(cards.per_seed_average(f, f.select("row"), "r2"))


@query("per_seed_average_delta", f"""
WITH {b.FRAME}, {_BASE}, joined AS (SELECT * FROM frozen JOIN base USING (row)),
{_PER_SEED.format(expr='100 * (mae - base) / base', src='joined')}
SELECT flavor, seed, {r('value')} AS value FROM per_seed""")
def per_seed_average_delta(spark, sf):
    f, base, deltas = _deltas(spark, sf)
    return rounded(cards.per_seed_average_delta(f, deltas.select("row"), base))


# ---------------------------------------------------------------- significance

def dunnett_sql(source: str, value: str, family: str = "row", control: str = "f1", tag: str = "") -> str:
    """CTEs ``tested<tag>``: the Dunnett statistics of ``source`` per family and arm."""
    return f"""arms{tag} AS (
  SELECT {family} AS family, flavor, count({value}) AS n, avg({value}) AS mean, var_pop({value}) * count({value}) AS ss
  FROM {source} GROUP BY ALL),
pool{tag} AS (SELECT family, sum(ss) AS ss, sum(n) - count(*) AS df, count(*) - 1 AS arms FROM arms{tag} WHERE n >= 2 GROUP BY family),
tested{tag} AS (
  SELECT a.family, a.flavor, a.n, a.mean, c.n AS n0, c.mean AS mean0, p.arms, p.df::BIGINT AS df, p.ss / p.df AS pooled_var,
         (a.mean - c.mean) / sqrt(p.ss / p.df * (1.0::DOUBLE / a.n + 1.0::DOUBLE / c.n)) AS t
  FROM arms{tag} a JOIN pool{tag} p ON a.family = p.family JOIN arms{tag} c ON c.family = a.family AND c.flavor = '{control}'
  WHERE a.flavor <> '{control}')"""


@query("dunnett_stats", f"""
WITH {b.FRAME}, {dunnett_sql('frozen', 'r2')}
SELECT family AS row, flavor, n, {r('mean')} AS mean, n0, {r('mean0')} AS mean0, arms, df,
       {r('pooled_var', 9)} AS pooled_var, {r('t', 4)} AS t FROM tested""")
def dunnett_stats(spark, sf):
    s = significance.dunnett_stats(b.frozen(spark, sf), ["row"], "flavor", "r2", b.CONTROL)
    return s.select("row", "flavor", "n", F.round("mean", 6).alias("mean"), "n0", F.round("mean0", 6).alias("mean0"),
                    "arms", "df", F.round("pooled_var", 9).alias("pooled_var"), F.round("t", 4).alias("t"))


@query("dunnett_pvalues", f"""
WITH {b.FRAME}, {dunnett_sql('frozen', 'r2')}, {tails.dunnett_p()}
SELECT family AS row, flavor, {r('t', 4)} AS t, {r('p', 4)} AS p FROM tested JOIN ps USING (family, flavor)""")
def dunnett_pvalues(spark, sf):
    return rounded(significance.dunnett(b.frozen(spark, sf), ["row"], "flavor", "r2", b.CONTROL)
                   .select("row", "flavor", "t", "p"), 4)


def _p_tables(spark, sf):
    f, base, deltas = _deltas(spark, sf)
    cell_p = significance.cell_pvalues(f, f, b.CONTROL, b.SHOWN)
    per_seed = stage(cards.per_seed_average_delta(f, deltas.select("row"), base), "per_seed")
    average_p = significance.average_pvalues(per_seed, per_seed, b.CONTROL, b.SHOWN)
    return f, deltas, cell_p, average_p


_CELL_TESTS = f"""cell_tests AS (SELECT row, flavor, mae FROM frozen), {dunnett_sql('cell_tests', 'mae')}, {tails.dunnett_p()}"""


@query("cell_pvalues", f"""
WITH {b.FRAME}, {_CELL_TESTS}
SELECT family AS row, flavor, {r('t', 4)} AS t, {r('p', 4)} AS p FROM tested JOIN ps USING (family, flavor)""")
def cell_pvalues(spark, sf):
    return rounded(_p_tables(spark, sf)[2].select("row", "flavor", "t", "p"), 4)


_CHANGES = f"""joined AS (SELECT * FROM frozen JOIN base USING (row)),
{_PER_SEED.format(expr='100 * (mae - base) / base', src='joined')}, one AS (SELECT *, 'average' AS family FROM per_seed)"""
_AVERAGE_TESTS = f"{_CHANGES}, {dunnett_sql('one', 'value', 'family')}"


@query("average_pvalues", f"""
WITH {b.FRAME}, {_BASE}, {_AVERAGE_TESTS}, {tails.dunnett_p()}
SELECT flavor, n, {r('t', 4)} AS t, {r('p', 4)} AS p FROM tested JOIN ps USING (family, flavor)""")
def average_pvalues(spark, sf):
    return rounded(_p_tables(spark, sf)[3].select("flavor", "n", "t", "p"), 4)


@query("average_test_stats", f"""
WITH {b.FRAME}, {_BASE}, {_AVERAGE_TESTS}
SELECT flavor, n, {r('mean', 4)} AS mean, n0, arms, df, {r('t', 3)} AS t FROM tested""")
def average_test_stats(spark, sf):
    return rounded(_p_tables(spark, sf)[3].select("flavor", "n", F.round("mean", 4).alias("mean"), "n0", "arms", "df",
                                                  F.round("t", 3).alias("t")))


@query("card_cells", f"""
WITH {b.FRAME}, {_ORDERED},
cells AS (SELECT row, flavor, avg(r2) AS value, stddev_samp(r2) AS aux FROM frozen GROUP BY ALL),
body AS (
  SELECT row_ord, row, (CASE flavor WHEN 'f1' THEN 0 WHEN 'f0' THEN 1 WHEN 'f2' THEN 2 ELSE 3 END)::INTEGER AS col_ord,
         CASE flavor WHEN 'f1' THEN 'baseline' ELSE flavor END AS "column", value, aux FROM cells JOIN ordered USING (row)),
card AS (SELECT * FROM body UNION ALL
  SELECT max(row_ord) + 1, 'AVERAGE', col_ord, "column", avg(value), NULL FROM body GROUP BY col_ord, "column")
SELECT row_ord, row, col_ord, "column", {r('value')} AS value, {r('aux')} AS aux, {r('value')} AS color_value,
       printf('%.3f', value) || CASE WHEN aux IS NULL THEN '' ELSE chr(10) || '±' || printf('%.3f', aux) END AS text FROM card""")
def card_cells(spark, sf):
    return rounded(cards.r2_card(b.frozen(spark, sf), b.CONTROL, b.SHOWN, vocabulary=SAMPLE))


_CARD_P = f"""{_DELTA}, {_CELL_TESTS}, cell_p AS (SELECT family AS row, flavor, p FROM ps),
{_CHANGES}, {dunnett_sql('one', 'value', 'family', tag='2')}, {tails.dunnett_p('tested2', 'qs')}"""


@query("mae_delta_card", f"""
WITH {b.FRAME}, {_ORDERED}, {_CARD_P},
body AS (
  SELECT row_ord, row, (CASE flavor WHEN 'f0' THEN 0 WHEN 'f2' THEN 1 ELSE 2 END)::INTEGER AS col_ord, flavor AS "column", delta AS value, p AS aux
  FROM deltas JOIN ordered USING (row) LEFT JOIN cell_p USING (row, flavor)),
card AS (SELECT * FROM body UNION ALL
  SELECT m, 'AVERAGE', col_ord, "column", v, p FROM (
    SELECT max(row_ord) + 1 AS m, col_ord, "column", avg(value) AS v FROM body GROUP BY col_ord, "column") LEFT JOIN qs ON "column" = qs.flavor)
SELECT row_ord, row, col_ord, "column", {r('value', 4)} AS value, {r('aux', 4)} AS aux,
       {r('CASE WHEN value IS NULL THEN NULL WHEN aux <= 0.05 THEN value ELSE 0 END', 4)} AS color_value,
       CASE WHEN value IS NULL THEN '' ELSE printf('%+.0f%%', value) || CASE WHEN aux IS NULL THEN '' ELSE chr(10) || {tails.p_text('aux')} END END AS text
FROM card""")
def mae_delta_card(spark, sf):
    f, deltas, cell_p, average_p = _p_tables(spark, sf)
    return rounded(cards.mae_delta_card(deltas, cell_p, average_p, cards.order_rows(f, SAMPLE), b.SHOWN), 4)


@query("gate_cells", f"""
WITH {b.FRAME}, {_DELTA}, {_CELL_TESTS}, gated AS (
  SELECT d.row, d.flavor, delta, p FROM deltas d LEFT JOIN ps ON ps.family = d.row AND ps.flavor = d.flavor)
SELECT row, flavor, {r('CASE WHEN delta IS NULL THEN NULL WHEN p <= 0.05 THEN delta ELSE 0 END')} AS color_value,
       {tails.p_text('p')} AS p_text
FROM gated""")
def gate_cells(spark, sf):
    _, deltas, cell_p, _ = _p_tables(spark, sf)
    cells = deltas.join(cell_p.select("row", "flavor", "p"), ["row", "flavor"], "left")
    return rounded(cells.select("row", "flavor", cards.gate(F.col("delta"), F.col("p")).alias("color_value"),
                                text.format_p(F.col("p")).alias("p_text")))


# ---------------------------------------------------------------- registry and grid

@query("experiment_grid", f"""
WITH {b.METRICS}, eps AS (SELECT DISTINCT recipe, endpoint FROM metrics)
SELECT recipe, endpoint, flavor, seed::BIGINT AS seed, mode,
       CASE mode WHEN 'frozen' THEN '' ELSE 'lr_' || mode || '__' END || flavor || '__s' || seed AS label,
       flavor || '__s42' AS foundation
FROM eps, (SELECT unnest(['f0', 'f1', 'f2', 'f3']) AS flavor), range(1, 9) s(seed),
     (SELECT unnest(['frozen', 'reduced', 'unlocked']) AS mode)""")
def experiment_grid(spark, sf):
    return cards.experiment_grid(b.metrics(spark, sf), b.ARMS, range(1, 9), foundation_seed=42)


@query("grid_audit", f"""
WITH {b.METRICS}, eps AS (SELECT DISTINCT recipe, endpoint FROM metrics),
want AS (SELECT CASE mode WHEN 'frozen' THEN '' ELSE 'lr_' || mode || '__' END || flavor || '__s' || seed AS label, recipe, endpoint
  FROM eps, (SELECT unnest(['f0', 'f1', 'f2']) AS flavor), range(1, 9) s(seed), (SELECT unnest(['frozen', 'reduced']) AS mode)),
have AS (SELECT flavor AS label, recipe, endpoint FROM metrics)
SELECT *, 'missing' AS status FROM (SELECT * FROM want EXCEPT SELECT * FROM have)
UNION ALL SELECT *, 'surplus' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""")
def grid_audit(spark, sf):
    m = b.metrics(spark, sf)
    return cards.grid_audit(cards.experiment_grid(m, b.ARMS[:3], range(1, 9), ("frozen", "reduced")), m)


@query("pending_work", f"""
WITH {b.METRICS}
SELECT DISTINCT 'f' || a || '__s' || s AS label, recipe, endpoint FROM metrics, range(0, 6) x(a), range(1, 8) y(s)
WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.flavor = 'f' || a || '__s' || s AND m.recipe = metrics.recipe AND m.endpoint = metrics.endpoint)""")
def pending_work(spark, sf):
    m = b.metrics(spark, sf)
    grid = cards.experiment_grid(m, [f"f{a}" for a in range(6)], range(1, 8), ("frozen",))
    done = m.withColumnRenamed("flavor", "label")
    return cards.pending(grid, done, ["label", "recipe", "endpoint"]).select("label", "recipe", "endpoint")


def _supplier_registry(spark, sf):
    """Arms of the supplier table as a flavor registry: (name, ord, corpus_from)."""
    arm = F.col("s_suppkey") % 4
    arms = b.table(spark, sf, "supplier").select(arm.cast("int").alias("ord")).distinct().filter("ord <> 3")
    return arms.select(F.concat(F.lit("f"), F.col("ord").cast("string")).alias("name"), "ord",
                       F.when(F.col("ord") == 2, F.lit("f0")).alias("corpus_from"))


@query("known_flavors", f"""
WITH {b.FRAME} SELECT flavor, seed, row, {r('r2')} AS r2 FROM frozen
WHERE flavor IN (SELECT 'f' || (s_suppkey % 4) FROM supplier WHERE s_suppkey % 4 <> 3)""")
def known_flavors(spark, sf):
    return rounded(keys.known_flavors(b.frozen(spark, sf), _supplier_registry(spark, sf)).select("flavor", "seed", "row", "r2"))


@query("column_order", f"""
WITH {b.FRAME} SELECT DISTINCT 'f' || (s_suppkey % 4) AS name, (s_suppkey % 4)::INTEGER AS ord,
       CASE WHEN s_suppkey % 4 = 2 THEN 'f0' END AS corpus_from
FROM supplier WHERE s_suppkey % 4 <> 3 AND 'f' || (s_suppkey % 4) IN (SELECT flavor FROM frozen)""")
def column_order(spark, sf):
    return cards.column_order(_supplier_registry(spark, sf), b.frozen(spark, sf))


@query("resolve_corpus", """
SELECT DISTINCT 'f' || (s_suppkey % 4) AS name, CASE s_suppkey % 4 WHEN 1 THEN 'shared' ELSE 'f0' END AS corpus
FROM supplier WHERE s_suppkey % 4 <> 3""")
def resolve_corpus(spark, sf):
    return cards.resolve_corpus(_supplier_registry(spark, sf))
