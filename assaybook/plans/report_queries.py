"""Queries behind the report tables, and the stacking comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards, reports, significance, stacking
from ..operators.splits import assign_folds
from ..session import stage
from . import bindings as b
from . import tails
from .card_queries import dunnett_sql
from .catalog import query, r, rounded
from .names import SAMPLE

_ORD = "CAST(substring(flavor, 2) AS INTEGER)"
_R2_CELLS = f"cells AS (SELECT row, flavor, avg(r2) AS value, {_ORD} AS col_ord FROM frozen GROUP BY ALL)"
_WINNERS = "winners AS (SELECT row, arg_max(flavor, value) AS winner FROM cells GROUP BY row)"


def _cells(spark, sf):
    cells = b.frozen(spark, sf).groupBy("row", "flavor").agg(F.avg("r2").alias("value"))
    return stage(cells.withColumn("col_ord", F.substring("flavor", 2, 9).cast("int")), "cells")


@query("row_winner", f"WITH {b.FRAME}, {_R2_CELLS}, {_WINNERS} SELECT row, winner FROM winners")
def row_winner(spark, sf):
    return reports.row_winner(_cells(spark, sf), "r2")


@query("rank_arms", f"""
WITH {b.FRAME}, {_R2_CELLS}, {_WINNERS}
SELECT flavor, {r('avg(value)')} AS mean, {r('median(value)')} AS median,
       (SELECT count(*) FROM winners w WHERE w.winner = c.flavor) AS wins FROM cells c GROUP BY flavor""")
def rank_arms(spark, sf):
    return rounded(reports.rank_arms(_cells(spark, sf), "r2"))


@query("rank_columns", f"""
WITH {b.FRAME}, {_R2_CELLS}, averages AS (SELECT flavor AS "column", avg(value) AS average FROM cells GROUP BY flavor)
SELECT "column", {r('average')} AS average,
       row_number() OVER (ORDER BY "column" <> 'f1', average DESC) - 1 AS position FROM averages""")
def rank_columns(spark, sf):
    averages = _cells(spark, sf).groupBy(F.col("flavor").alias("column")).agg(F.avg("value").alias("average"))
    return rounded(reports.rank_columns(averages, False, b.CONTROL))


_ABLATION = f"""tagged AS (
  SELECT *, CASE WHEN starts_with(flavor, 'lr_') THEN 'reduced' ELSE 'frozen' END AS mode,
         regexp_extract(flavor, '(f[0-9])$', 1) AS arm FROM named WHERE NOT (starts_with(flavor, 'lr_') AND recipe = 'press_mt')),
shared AS (SELECT mode, dataset, endpoint, count(DISTINCT recipe) > 1 AS many FROM tagged GROUP BY ALL),
ab AS (
  SELECT mode, dataset || ' · ' || endpoint || CASE WHEN many THEN ' (' || recipe || ')' ELSE '' END AS row, arm AS flavor, avg(r2) AS value
  FROM tagged JOIN shared USING (mode, dataset, endpoint) GROUP BY ALL),
won AS (SELECT mode, row, arg_max(flavor, value) AS winner FROM ab GROUP BY ALL)"""


@query("ablation_ranking", f"""
WITH {b.FRAME}, {_ABLATION}
SELECT mode, flavor, {r('avg(value)')} AS mean, {r('median(value)')} AS median,
       (SELECT count(*) FROM won w WHERE w.winner = ab.flavor AND w.mode = ab.mode) AS wins
FROM ab GROUP BY mode, flavor""")
def ablation_ranking(spark, sf):
    reduced = F.col("flavor").startswith("lr_")
    label = F.concat(F.lit("ablation_"), F.regexp_extract("flavor", "(f[0-9]__s[0-9]+)$", 1),
                     F.when(reduced, "__reduced").otherwise(""))
    frame = reports.ablation_frame(b.metrics(spark, sf).withColumn("flavor", label), ["press_mt"], ["reduced"], SAMPLE)
    cells = stage(reports.ablation_cells(frame, "r2", b.ARMS), "ablation")
    return rounded(reports.rank_arms(cells, "r2", ["mode"]))


_MODES = f"""modes AS (
  SELECT regexp_extract(flavor, '(f[0-9])$', 1) AS flavor, endpoint,
         CASE WHEN starts_with(flavor, 'lr_') THEN 'reduced' ELSE 'frozen' END AS mode, avg(r2) AS value
  FROM frame GROUP BY ALL HAVING regexp_extract(flavor, '(f[0-9])$', 1) IN ('f0', 'f1', 'f2')),
matrix AS (SELECT flavor || ' · ' || endpoint AS row, max(value) FILTER (WHERE mode = 'frozen') AS frozen,
                  max(value) FILTER (WHERE mode = 'reduced') AS reduced FROM modes GROUP BY ALL)"""
_TWO = ("frozen", "reduced")


def _modes(spark, sf):
    return reports.mode_flavor_frame(b.metrics(spark, sf), "r2", b.ARMS[:3])


@query("mode_flavor_frame", f"WITH {b.FRAME}, {_MODES} SELECT flavor, endpoint, mode, {r('value')} AS value FROM modes")
def mode_flavor_frame(spark, sf):
    return rounded(_modes(spark, sf))


@query("mode_matrix", f"""
WITH {b.FRAME}, {_MODES} SELECT row, {r('frozen')} AS frozen, {r('reduced')} AS reduced FROM matrix""")
def mode_matrix(spark, sf):
    return rounded(reports.mode_matrix(_modes(spark, sf), _TWO))


@query("mode_summary", f"""
WITH {b.FRAME}, {_MODES}
SELECT 'frozen' AS mode, {r('avg(frozen)')} AS mean, count(frozen) AS n, NULL::DOUBLE AS mean_delta, NULL::BIGINT AS wins FROM matrix
UNION ALL
SELECT 'reduced', {r('avg(reduced)')}, count(reduced), {r('avg(reduced - frozen)')}, count(*) FILTER (WHERE reduced > frozen) FROM matrix""")
def mode_summary(spark, sf):
    return rounded(reports.mode_summary(reports.mode_matrix(_modes(spark, sf), _TWO), "r2", _TWO))


_MEANS = f"""means AS (SELECT flavor, mode, avg(value) AS value FROM modes GROUP BY ALL)"""


def _mode_means(spark, sf):
    return stage(_modes(spark, sf).groupBy("flavor", "mode").agg(F.avg("value").alias("value")), "means")


@query("mode_comparison", f"""
WITH {b.FRAME}, {_MODES}, {_MEANS}
SELECT flavor, {r("max(value) FILTER (WHERE mode = 'frozen')")} AS frozen, {r("max(value) FILTER (WHERE mode = 'reduced')")} AS reduced
FROM means GROUP BY flavor""")
def mode_comparison(spark, sf):
    return rounded(reports.mode_comparison(_mode_means(spark, sf), "r2", _TWO)[0])


@query("mode_winners", f"""
WITH {b.FRAME}, {_MODES}, {_MEANS}, best AS (SELECT mode, arg_max(flavor, value) AS winner FROM means GROUP BY mode)
SELECT mode, winner, (SELECT count(DISTINCT winner) = 1 FROM best) AS stable FROM best""")
def mode_winners(spark, sf):
    return reports.mode_comparison(_mode_means(spark, sf), "r2", _TWO)[1]


_ARM_SEEDS = """arm_seeds AS (
  SELECT regexp_replace(flavor, '__s[0-9]+$', '') AS flavor, regexp_extract(flavor, '__s([0-9]+)$', 1) AS seed, avg(r2) AS value
  FROM metrics GROUP BY ALL)"""


@query("arm_summary", f"""
WITH {b.METRICS}, {_ARM_SEEDS}
SELECT flavor, {r('avg(value)')} AS mean, {r('coalesce(stddev_samp(value), 0)')} AS std, count(*) AS n FROM arm_seeds GROUP BY flavor""")
def arm_summary(spark, sf):
    return rounded(reports.arm_summary(b.metrics(spark, sf)))


@query("welch_stats", f"""
WITH {b.METRICS}, {_ARM_SEEDS}, s AS (
  SELECT flavor, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS v FROM arm_seeds GROUP BY flavor)
SELECT 'f0' AS subject, x.n AS n_a, y.n AS n_b, {r('x.m')} AS mean_a, {r('y.m')} AS mean_b,
       {r('(x.m - y.m) / sqrt(x.v + y.v)', 4)} AS t,
       {r('pow(x.v + y.v, 2) / (x.v * x.v / (x.n - 1) + y.v * y.v / (y.n - 1))', 4)} AS df
FROM s x JOIN s y ON x.flavor = 'f0' AND y.flavor = 'f1'""")
def welch_stats(spark, sf):
    seeds = stage(reports.arm_seed_means(b.metrics(spark, sf)), "arm_seeds")
    side = lambda a: seeds.filter(F.col("flavor") == a).withColumn("subject", F.lit("f0"))
    s = significance.welch_stats(side("f0"), side("f1"), ["subject"], "value")
    return s.select("subject", "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                    F.round("t", 4).alias("t"), F.round("df", 4).alias("df"))


_WELCH = f"""{_ARM_SEEDS}, s AS (
  SELECT flavor, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS v FROM arm_seeds GROUP BY flavor),
welch AS (
  SELECT 'f0' AS subject, x.n AS n_a, y.n AS n_b, x.m AS mean_a, y.m AS mean_b, (x.m - y.m) / sqrt(x.v + y.v) AS t,
         pow(x.v + y.v, 2) / (x.v * x.v / (x.n - 1) + y.v * y.v / (y.n - 1)) AS df
  FROM s x JOIN s y ON x.flavor = 'f0' AND y.flavor = 'f1'),
gaps AS (SELECT c.flavor, abs(c.m - x.m) AS gap FROM s c JOIN s x ON x.flavor = 'f0' WHERE c.flavor IN ('f2', 'f3'))"""


@query("control_comparison", f"""
WITH {b.METRICS}, {_WELCH}, {tails.student_p('welch', 'subject')}
SELECT subject, n_a, n_b, {r('mean_a', 4)} AS mean_a, {r('mean_b', 4)} AS mean_b, {r('t', 4)} AS t, {r('df', 4)} AS df,
       (SELECT arg_min(flavor, gap) FROM gaps) AS nearest, (SELECT {r('min(gap)', 4)} FROM gaps) AS distance, {r('p', 4)} AS p,
       {r('mean_a - mean_b', 4)} AS delta, p <= 0.05 AS significant
FROM welch JOIN ps USING (subject)""")
def control_comparison(spark, sf):
    return rounded(reports.control_comparison(b.metrics(spark, sf), "f0", "f1", ["f2", "f3"]), 4)


@query("nearest_arm", f"""
WITH {b.METRICS}, {_ARM_SEEDS}, s AS (SELECT flavor, avg(value) AS m FROM arm_seeds GROUP BY flavor),
gaps AS (SELECT c.flavor, abs(c.m - x.m) AS gap FROM s c JOIN s x ON x.flavor = 'f0' WHERE c.flavor IN ('f2', 'f3'))
SELECT 'f0' AS subject, (SELECT arg_min(flavor, gap) FROM gaps) AS nearest, (SELECT {r('min(gap)')} FROM gaps) AS distance,
       {r("(SELECT m FROM s WHERE flavor = 'f0') - (SELECT m FROM s WHERE flavor = 'f1')")} AS delta""")
def nearest_arm(spark, sf):
    c = reports.control_comparison(b.metrics(spark, sf), "f0", "f1", ["f2", "f3"])
    return rounded(c.select("subject", "nearest", "distance", "delta"))


_PHASES = f"""{dunnett_sql('frozen', 'r2', 'recipe')}, shown AS (
  SELECT recipe, flavor, avg(r2) AS r2, stddev_samp(r2) AS r2_std, avg(mae) AS mae, stddev_samp(mae) AS mae_std, count(r2) AS n
  FROM frozen GROUP BY recipe, flavor)"""


@query("external_test_report", f"""
WITH {b.FRAME}, {_PHASES}
SELECT recipe, shown.flavor, {r('r2')} AS r2, {r('r2_std')} AS r2_std, {r('mae', 4)} AS mae, {r('mae_std', 4)} AS mae_std, shown.n,
       {r('mean - mean0')} AS delta
FROM shown LEFT JOIN tested ON tested.family = recipe AND tested.flavor = shown.flavor""")
def external_test_report(spark, sf):
    t = reports.external_test_report(_external(spark, sf), None, b.CONTROL)
    return t.select("recipe", "flavor", F.round("r2", 6).alias("r2"), F.round("r2_std", 6).alias("r2_std"),
                    F.round("mae", 4).alias("mae"), F.round("mae_std", 4).alias("mae_std"), "n",
                    F.round("delta", 6).alias("delta"))


def _external(spark, sf):
    return b.metrics(spark, sf).filter(~F.col("flavor").startswith("lr_"))


@query("external_test_stars", f"""
WITH {b.FRAME}, {_PHASES}, {tails.dunnett_p()}
SELECT recipe, shown.flavor, {r('p', 4)} AS p, coalesce(p <= 0.05, false) AS star
FROM shown LEFT JOIN ps ON ps.family = recipe AND ps.flavor = shown.flavor""")
def external_test_stars(spark, sf):
    return rounded(reports.external_test_report(_external(spark, sf), None, b.CONTROL).select("recipe", "flavor", "p", "star"), 4)


_BOX = """q AS (SELECT flavor, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                       quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY flavor),
box AS (
  SELECT flavor, q1, median, q3, count(*) AS n,
         min(value) FILTER (WHERE value >= q1 - 1.5::DOUBLE * (q3 - q1)) AS low,
         max(value) FILTER (WHERE value <= q3 + 1.5::DOUBLE * (q3 - q1)) AS high, avg(value) AS average
  FROM cells JOIN q USING (flavor) GROUP BY flavor, q1, median, q3)"""


@query("box_stats", f"""
WITH {b.FRAME}, {_R2_CELLS}, {_BOX}
SELECT flavor, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('low')} AS whisker_low,
       {r('high')} AS whisker_high FROM box""")
def box_stats(spark, sf):
    return rounded(reports.box_stats(_cells(spark, sf)))


@query("average_summary", f"""
WITH {b.FRAME}, {_R2_CELLS}, {_BOX},
seeds AS (SELECT flavor, count(*) AS n_seeds, stddev_samp(m) AS seed_sd
          FROM (SELECT flavor, seed, avg(r2) AS m FROM frozen GROUP BY ALL) GROUP BY flavor)
SELECT flavor, {r('average')} AS average, n AS n_endpoints, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
       {r('low')} AS whisker_low, {r('high')} AS whisker_high, n_seeds, {r('seed_sd')} AS seed_sd
FROM box JOIN seeds USING (flavor)""")
def average_summary(spark, sf):
    f = b.frozen(spark, sf)
    cells = stage(cards.seed_matrix(f, "r2"), "cells").select("row", "flavor", "value")
    return rounded(reports.average_summary(cells, cards.per_seed_average(f, f.select("row"), "r2")))


@query("average_summary_tests", f"""
WITH {b.FRAME}, changes AS (
  SELECT row, flavor, 100 * (avg(mae) - any_value(base)) / any_value(base) AS value
  FROM frozen JOIN (SELECT row, avg(mae) AS base FROM frozen WHERE flavor = 'f1' GROUP BY row) USING (row) GROUP BY row, flavor),
cells AS (SELECT * FROM changes WHERE flavor <> 'f1'), {_BOX},
joined AS (SELECT frozen.*, base FROM frozen JOIN (SELECT row, avg(mae) AS base FROM frozen WHERE flavor = 'f1' GROUP BY row) USING (row)),
per_seed AS (SELECT flavor, seed, avg(m) AS value FROM (
  SELECT flavor, coalesce(seed, -1) AS seed, row, avg(100 * (mae - base) / base) AS m FROM joined GROUP BY ALL) GROUP BY ALL),
seeds AS (SELECT flavor, count(*) AS n_seeds, stddev_samp(value) AS seed_sd FROM per_seed GROUP BY flavor),
one AS (SELECT *, 'average' AS family FROM per_seed), {dunnett_sql('one', 'value', 'family')}, {tails.dunnett_p()}
SELECT box.flavor, {r('average', 4)} AS average, box.n AS n_endpoints, {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3,
       {r('low', 4)} AS whisker_low, {r('high', 4)} AS whisker_high, n_seeds, {r('seed_sd', 4)} AS seed_sd, {r('p', 4)} AS p, p <= 0.05 AS significant
FROM box JOIN seeds USING (flavor) JOIN ps USING (flavor)""")
def average_summary_tests(spark, sf):
    f = b.frozen(spark, sf)
    base = stage(cards.reference_series(f, b.CONTROL, "mae"), "base")
    cells = cards.delta_matrix(cards.seed_matrix(f, "mae", b.SHOWN), base)
    cells = stage(cells.select("row", "flavor", F.col("delta").alias("value")), "cells")
    per_seed = stage(cards.per_seed_average_delta(f, cells.select("row"), base), "per_seed")
    tests = significance.average_pvalues(per_seed, per_seed, b.CONTROL, b.SHOWN)
    return rounded(reports.average_summary(cells, per_seed, tests), 4)


# ---------------------------------------------------------------- analyses on ranked cells

@query("variance_ratio", f"""
WITH {b.FRAME}, arms AS (SELECT row, flavor, var_samp(r2) AS v FROM frozen GROUP BY ALL)
SELECT row, {r('min(v)', 9)} AS min_var, {r('max(v)', 9)} AS max_var, {r('max(v) / min(v)', 3)} AS variance_ratio FROM arms GROUP BY row""")
def variance_ratio(spark, sf):
    v = reports.variance_ratio(b.frozen(spark, sf), "r2")
    return v.select("row", F.round("min_var", 9).alias("min_var"), F.round("max_var", 9).alias("max_var"),
                    F.round("variance_ratio", 3).alias("variance_ratio"))


@query("family_means", f"""
WITH {b.FRAME}, {_R2_CELLS}, pooled AS (
  SELECT split_part(row, ' · ', 1) AS family, flavor, avg(value) AS mean, count(*) AS n FROM cells GROUP BY ALL)
SELECT family, flavor, {r('mean')} AS mean, n, flavor = arg_max(flavor, mean) OVER (PARTITION BY family) AS best FROM pooled""")
def family_means(spark, sf):
    f = b.frozen(spark, sf)
    mapping = f.select("row", F.col("dataset").alias("family")).distinct()
    return rounded(reports.family_means(_cells(spark, sf), mapping, "r2"))


@query("control_depth", f"""
WITH {b.FRAME}
SELECT flavor, count(DISTINCT seed) AS n, {r("count(DISTINCT seed) * sqrt((SELECT count(DISTINCT flavor) - 1 FROM frozen))")} AS depth
FROM frozen GROUP BY flavor""")
def control_depth(spark, sf):
    f = b.frozen(spark, sf)
    arms = f.agg(F.countDistinct("flavor") - 1).first()[0]
    seeds = f.groupBy("flavor").agg(F.countDistinct("seed").alias("n"))
    return rounded(seeds.withColumn("depth", reports.control_depth(F.col("n"), F.lit(arms))))


@query("holm", f"""
WITH {b.FRAME}, arms AS (SELECT row, flavor, count(r2) AS n, avg(r2) AS m, var_samp(r2) / count(r2) AS v FROM frozen GROUP BY ALL),
tests AS (
  SELECT x.row, x.flavor, (x.m - y.m) / sqrt(x.v + y.v) AS t, pow(x.v + y.v, 2) / (x.v * x.v / (x.n - 1) + y.v * y.v / (y.n - 1)) AS df
  FROM arms x JOIN arms y ON x.row = y.row AND y.flavor = 'f1' WHERE x.flavor <> 'f1'),
{tails.student_p('tests', 'row, flavor')},
steps AS (SELECT *, p * (count(*) OVER (PARTITION BY row) - row_number() OVER (PARTITION BY row ORDER BY p, flavor) + 1) AS s FROM ps)
SELECT row, flavor, {r('p', 4)} AS p, {r('least(1, max(s) OVER (PARTITION BY row ORDER BY p, flavor ROWS UNBOUNDED PRECEDING))', 4)} AS p_holm
FROM steps""")
def holm(spark, sf):
    f = b.frozen(spark, sf).select("row", "flavor", "r2")
    arms = f.filter("flavor <> 'f1'")
    control = arms.select("row", "flavor").distinct().join(f.filter("flavor = 'f1'").select("row", "r2"), "row")
    tests = significance.with_t_pvalue(significance.welch_stats(arms, control, ["row", "flavor"], "r2"))
    return rounded(reports.holm(tests.select("row", "flavor", "p")), 4)


def _ballot_round(i: int) -> str:
    """CTEs of election round i over the arms in ``s{i-1}``."""
    return f"""v{i} AS (
  SELECT a.flavor, a.col_ord, count(w.row) AS votes FROM s{i - 1} a
  LEFT JOIN (SELECT row, arg_max(flavor, value) AS winner FROM cells WHERE flavor IN (SELECT flavor FROM s{i - 1}) GROUP BY row) w
    ON w.winner = a.flavor GROUP BY ALL),
d{i} AS (SELECT 2 * max(votes) > sum(votes) AS done FROM v{i}),
o{i} AS (SELECT flavor FROM v{i} WHERE NOT (SELECT done FROM d{i}) ORDER BY votes, col_ord DESC LIMIT 1),
s{i} AS (SELECT flavor, col_ord FROM s{i - 1} WHERE NOT (SELECT done FROM d{i}) AND flavor NOT IN (SELECT flavor FROM o{i}))"""


@query("instant_runoff", f"""
WITH {b.FRAME}, {_R2_CELLS.replace('avg(r2)', 'avg(-mae)')}, s0 AS (SELECT DISTINCT flavor, col_ord FROM cells),
{', '.join(_ballot_round(i) for i in (1, 2, 3))}
{' UNION ALL '.join(f"SELECT {i}::INTEGER AS round, flavor, votes, flavor IN (SELECT flavor FROM o{i}) AS eliminated FROM v{i}" for i in (1, 2, 3))}""")
def instant_runoff(spark, sf):
    cells = b.frozen(spark, sf).groupBy("row", "flavor").agg(F.avg("mae").alias("value"))
    return reports.instant_runoff(cells.withColumn("col_ord", F.substring("flavor", 2, 9).cast("int")), "mae")


# ---------------------------------------------------------------- stacking

_FLAVORS = ("f0", "f1", "f2", "f3")
_UNIT = ("endpoint", "seed")
_FOLDS = f"""folds AS (
  SELECT *, ntile(5) OVER (PARTITION BY endpoint, seed ORDER BY md5('0:' || endpoint || ':' || seed || ':' || row_id), row_id) - 1 AS fold
  FROM features)"""
_SINGLE = f"""sums AS (
  SELECT endpoint, seed, fold, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy,
         {', '.join(f'sum((y - f_{f}) * (y - f_{f})) AS e_{f}' for f in _FLAVORS)} FROM folds GROUP BY ALL),
rest AS (
  SELECT endpoint, seed, fold, sum(n) OVER w - n AS n, sum(sy) OVER w - sy AS sy, sum(syy) OVER w - syy AS syy,
         {', '.join(f'sum(e_{f}) OVER w - e_{f} AS e_{f}' for f in _FLAVORS)}
  FROM sums WINDOW w AS (PARTITION BY endpoint, seed)),
winners AS (
  SELECT endpoint, seed, fold, CASE least({', '.join(f'e_{f}' for f in _FLAVORS)})
         {' '.join(f"WHEN e_{f} THEN '{f}'" for f in _FLAVORS)} END AS winner FROM rest)"""
_PICK = "CASE winner " + " ".join(f"WHEN '{f}' THEN f_{f}" for f in _FLAVORS) + " END"


def _features(spark, sf):
    return stacking.stack_features(b.stack_predictions(spark, sf), _FLAVORS, _UNIT)


@query("stack_features", f"""
WITH {b.STACK}
SELECT endpoint, seed, row_id, {r('y', 4)} AS y, {', '.join(f'{r(f"f_{f}", 4)} AS f_{f}' for f in _FLAVORS)} FROM features""")
def stack_features(spark, sf):
    return rounded(stacking.stack_features(b.stack_predictions(spark, sf), _FLAVORS, _UNIT).drop("n_flavors"), 4)


@query("assign_folds", f"WITH {b.STACK}, {_FOLDS} SELECT endpoint, seed, row_id, fold::INTEGER AS fold FROM folds")
def folds(spark, sf):
    return assign_folds(_features(spark, sf), ["endpoint", "seed"], "row_id").select("endpoint", "seed", "row_id", "fold")


@query("best_single", f"WITH {b.STACK}, {_FOLDS}, {_SINGLE} SELECT endpoint, seed, fold::INTEGER AS fold, winner FROM winners")
def best_single(spark, sf):
    return stacking.best_single(assign_folds(_features(spark, sf), ["endpoint", "seed"], "row_id"), _FLAVORS, _UNIT)


@query("best_single_oof", f"""
WITH {b.STACK}, {_FOLDS}, {_SINGLE}
SELECT endpoint, seed, row_id, {r(_PICK, 4)} AS single FROM folds JOIN winners USING (endpoint, seed, fold)""")
def best_single_oof(spark, sf):
    folded = assign_folds(_features(spark, sf), ["endpoint", "seed"], "row_id")
    return rounded(stacking.best_single_oof(folded, _FLAVORS, _UNIT).select("endpoint", "seed", "row_id", "single"), 4)


@query("stack_oof")
def stack_oof(spark, sf):
    return rounded(stacking.stack_oof(_features(spark, sf), _FLAVORS, _UNIT), 4)


_SCORES = """scores AS (
  SELECT endpoint, seed, count(*) AS n_test, 4 AS n_flavors, max(r2) AS meta_r2, max(rmse) AS meta_rmse,
         arg_max(flavor, r2) AS best_single_flavor, avg(r2) AS best_single_r2, max(r2) - avg(r2) - 0.3 AS delta_r2
  FROM frozen GROUP BY ALL),
usual AS (
  SELECT endpoint, first(best_single_flavor ORDER BY n DESC, best_single_flavor) AS best_single_flavor
  FROM (SELECT endpoint, best_single_flavor, count(*) AS n FROM scores GROUP BY ALL) GROUP BY endpoint)"""
_STACKED = f"""stacked AS (
  SELECT endpoint, count(*) AS n_seeds, max(n_flavors)::INTEGER AS n_flavors, round_even(avg(n_test), 0)::BIGINT AS n_test,
         'best' AS estimator, avg(meta_r2) AS meta_r2, stddev_samp(meta_r2) AS meta_r2_std, avg(meta_rmse) AS meta_rmse,
         avg(best_single_r2) AS best_single_r2, avg(delta_r2) AS delta_r2, stddev_samp(delta_r2) AS delta_r2_std
  FROM scores GROUP BY endpoint)"""


def _arm_scores(spark, sf):
    """Seed scores in the stacker's shape, from arm metrics, so that SQL can follow them."""
    f = b.frozen(spark, sf)
    best = F.max_by("flavor", "r2")
    scores = f.groupBy("endpoint", "seed").agg(
        F.count("*").alias("n_test"), F.lit(4).alias("n_flavors"), F.lit("best").alias("estimator"),
        F.max("r2").alias("meta_r2"), F.max("rmse").alias("meta_rmse"), best.alias("best_single_flavor"),
        F.avg("r2").alias("best_single_r2"), (F.max("r2") - F.avg("r2") - 0.3).alias("delta_r2"))
    return stacking.aggregate_stack_seeds(stage(scores, "scores"), _FLAVORS)


@query("stack_seed_scores", f"""
WITH {b.FRAME}, {_SCORES}, {_STACKED}
SELECT endpoint, n_seeds, n_flavors, n_test, estimator, {r('meta_r2')} AS meta_r2, {r('meta_r2_std')} AS meta_r2_std,
       {r('meta_rmse', 3)} AS meta_rmse, best_single_flavor, {r('best_single_r2')} AS best_single_r2, {r('delta_r2')} AS delta_r2,
       {r('delta_r2_std')} AS delta_r2_std FROM stacked JOIN usual USING (endpoint)""")
def stack_seed_scores(spark, sf):
    return rounded(_arm_scores(spark, sf).withColumn("meta_rmse", F.round("meta_rmse", 3)))


@query("stack_wins", f"""
WITH {b.FRAME}, {_SCORES}, {_STACKED}
SELECT count(*) FILTER (WHERE delta_r2 > 0) AS wins, count(*) AS total, {r('avg(delta_r2)')} AS mean_delta FROM stacked""")
def stack_wins(spark, sf):
    return rounded(stacking.stack_summary(_arm_scores(spark, sf)))


@query("stack_report")
def stack_report(spark, sf):
    return rounded(stacking.stack_report(b.stack_predictions(spark, sf), _FLAVORS, _UNIT), 4)


@query("stack_summary")
def stack_summary(spark, sf):
    return rounded(stacking.stack_summary(stacking.stack_report(b.stack_predictions(spark, sf), _FLAVORS, _UNIT)), 4)


_RAGGED = _FLAVORS[:3]
_RAGGED_UNIT = ("dataset", "recipe", "endpoint", "seed")


def _ragged(spark, sf):
    """Two recipes over the same items, and an endpoint that lacks an arm."""
    pred = b.stack_predictions(spark, sf).filter("flavor <> 'f3' AND NOT (endpoint = 'LogD' AND flavor = 'f2')")
    recipe = F.explode(F.array(F.lit("plant_mt"), F.lit("gauge_st")))
    twice = pred.withColumn("recipe", recipe).withColumn("dataset", F.split_part("recipe", F.lit("_"), F.lit(1)))
    return twice.withColumn("y_pred", F.when(F.col("recipe") == "gauge_st", F.col("y_pred") * 0.9).otherwise(F.col("y_pred")))


@query("stack_ragged_flavors", f"""
WITH {b.STACK}, recipes AS (SELECT unnest(['plant', 'gauge']) AS dataset, unnest(['plant_mt', 'gauge_st']) AS recipe, unnest([1.0, 0.9]) AS w)
SELECT dataset, recipe, endpoint, seed, row_id, {r('y', 4)} AS y, {r('f_f0 * w', 4)} AS f_f0, {r('f_f1 * w', 4)} AS f_f1,
       CASE WHEN endpoint <> 'LogD' THEN {r('f_f2 * w', 4)} END AS f_f2, CASE WHEN endpoint = 'LogD' THEN 2 ELSE 3 END::INTEGER AS n_flavors
FROM features, recipes""")
def stack_ragged_flavors(spark, sf):
    return rounded(stacking.stack_features(_ragged(spark, sf), _RAGGED, _RAGGED_UNIT), 4)


@query("stack_trees")
def stack_trees(spark, sf):
    """Forests in place of ridge regression."""
    features = stacking.stack_features(b.stack_predictions(spark, sf), _FLAVORS, ("endpoint",))
    return rounded(stacking.stack_oof(features, _FLAVORS, ("endpoint",), k=2, estimator="rf"), 4)
