"""Report tables over tidy metrics: protocols, ablations, controls, external tests, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALPHA, BASELINE_MODE, MODES, ROW_SEPARATOR, UNSEEDED
from ..functions import labels
from ..functions.cells import ratio
from ..session import stage
from . import significance
from ..vocabulary import PLAIN, Vocabulary
from .cards import prepare_rows
from .keys import exclude_recipes
from .ordering import quantiles, with_row_id


# ---------------------------------------------------------------- winners and rankings

def row_winner(cells: DataFrame, metric: str, by: Sequence[str] = ("row",), column: str = "flavor",
               value: str = "value", order: str = "col_ord") -> DataFrame:
    """Best column of each row in the metric's direction, the first in order on ties.

    A plain aggregate over (value, order) structs: it combines before the shuffle.
    """
    sign = -1.0 if labels.higher_is_better(metric) else 1.0
    key = F.struct((F.col(value) * sign).alias("v"), F.col(order).alias("o"))
    return cells.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min_by(column, key).alias("winner")
    )


def rank_arms(cells: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and wins per arm over (row, flavor, value, col_ord) cells, best mean first.

    With ``by`` there is one ranking per protocol or other group.
    """
    higher, keys = labels.higher_is_better(metric), [*by, "flavor"]
    means = cells.groupBy(*keys).agg(F.avg("value").alias("mean"))
    medians = quantiles(cells, keys, "value", [0.5], ["median"])
    wins = row_winner(cells, metric, [*by, "row"]).groupBy(*by, F.col("winner").alias("flavor")).agg(
        F.count("*").alias("wins")
    )
    table = means.join(medians, keys, "left").join(wins, keys, "left").withColumn(
        "wins", F.coalesce("wins", F.lit(0))
    )
    return sort_ranking(table, "mean", higher, by)


def sort_ranking(df: DataFrame, metric: str, descending: bool, by: Sequence[str] = (),
                 name: str = "flavor") -> DataFrame:
    """Rank rows by a metric within ``by``, ties by name, missing last."""
    key = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    return df.orderBy(*by, key, name)


def ablation_frame(df: DataFrame, exclude: Sequence[str] = (), exclude_in: Sequence[str] = (),
                   vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """Tidy metrics of ``<arm>__s<seed>[__<mode>]`` labels with ``mode``, seed and row identity.

    Recipes in ``exclude`` are dropped from the protocols in ``exclude_in`` only; there the
    identities are built without them, so a recipe left alone sheds its suffix.
    """
    parsed = df.withColumns(
        {"mode": labels.mode_suffix(F.col("flavor")), "flavor": labels.mode_suffix_base(F.col("flavor"))}
    )
    full = prepare_rows(labels.collapse_seeds(parsed), vocabulary)
    if not exclude or not exclude_in:
        return full
    scoped = F.col("mode").isin(*exclude_in)
    kept = prepare_rows(labels.collapse_seeds(exclude_recipes(parsed, exclude)), vocabulary)
    return full.filter(~scoped).unionByName(kept.filter(scoped))


def ablation_cells(frame: DataFrame, metric: str, arms: Sequence[str]) -> DataFrame:
    """Seed-mean cells (mode, row, flavor, value, col_ord) of the ``ablation_`` arms, bare names."""
    own = frame.filter(F.col("flavor").startswith("ablation_")).withColumn(
        "flavor", labels.strip_prefix(F.col("flavor"), "ablation_")
    )
    at = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("flavor"))
    cells = own.groupBy("mode", "row", "flavor").agg(F.avg(metric).alias("value"))
    return cells.withColumn("col_ord", at.cast("int") - 1).filter("col_ord >= 0")


def rank_columns(averages: DataFrame, ascending: bool, pinned: str | None = None) -> DataFrame:
    """Add ``position``: the pinned column first, then best to worst by ``average``, missing last."""
    sign = 1.0 if ascending else -1.0
    first = F.coalesce(F.col("column") == F.lit(pinned), F.lit(False))
    keyed = averages.withColumns(
        {"_rest": ~first, "_missing": F.col("average").isNull(), "_key": F.col("average") * sign}
    )
    return with_row_id(keyed, ["_rest", "_missing", "_key", "column"], "position").drop(
        "_rest", "_missing", "_key"
    )


# ---------------------------------------------------------------- protocols

def mode_flavor_frame(df: DataFrame, metric: str, registry: Sequence[str]) -> DataFrame:
    """Seed average per (flavor, endpoint, mode) of registered flavors; mode from the prefix."""
    named = df.select(
        labels.mode_prefix_flavor(F.col("flavor")).alias("base"),
        labels.mode_prefix(F.col("flavor")).alias("mode"), "endpoint", metric,
    ).filter(F.col("base").isin(*registry))
    return named.groupBy(F.col("base").alias("flavor"), "endpoint", "mode").agg(
        F.avg(metric).alias("value")
    )


def mode_matrix(frame: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """(flavor · endpoint) rows by protocol columns."""
    row = F.concat("flavor", F.lit(ROW_SEPARATOR), "endpoint").alias("row")
    return frame.groupBy(row).pivot("mode", list(modes)).agg(F.avg("value"))


def mode_summary(matrix: DataFrame, metric: str, modes: Sequence[str] = MODES) -> DataFrame:
    """Per protocol: mean, n, and mean delta and wins against the baseline protocol."""
    base = F.col(BASELINE_MODE) if BASELINE_MODE in matrix.columns else F.lit(None).cast("double")
    sign = 1 if labels.higher_is_better(metric) else -1
    parts = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("v")) for m in modes])
    long = matrix.select(base.alias("_base"), F.inline(parts))
    delta = F.col("v") - F.col("_base")
    # without the baseline protocol there is nothing to compare with
    other = (F.first("mode") != BASELINE_MODE) & F.lit(BASELINE_MODE in matrix.columns)
    return long.groupBy("mode").agg(
        F.avg("v").alias("mean"),
        F.count("v").alias("n"),
        F.when(other, F.avg(delta)).alias("mean_delta"),
        F.when(other, F.count_if(delta * sign > 0)).alias("wins"),
    ).filter("n > 0")


def mode_comparison(means: DataFrame, metric: str, modes: Sequence[str] = MODES) -> tuple[DataFrame, DataFrame]:
    """(arm, mode, value) means -> arm-by-protocol matrix, and the winner of each protocol.

    The winners carry ``stable``: whether one arm wins under every protocol.
    """
    matrix = means.groupBy("flavor").pivot("mode", list(modes)).agg(F.first("value"))
    best = row_winner(means, metric, ("mode",), "flavor", "value", "flavor")
    every = Window.partitionBy(F.lit(0))             # one record per protocol
    same = F.min("winner").over(every) == F.max("winner").over(every)
    return matrix, best.withColumn("stable", same)


# ---------------------------------------------------------------- control arm

def arm_seed_means(df: DataFrame, metric: str = "r2") -> DataFrame:
    """Endpoint mean per (arm, seed); labels without a seed are one group."""
    return df.groupBy(
        labels.seed_base(F.col("flavor")).alias("flavor"),
        F.coalesce(labels.seed_number(F.col("flavor")), F.lit(UNSEEDED)).alias("seed"),
    ).agg(F.avg(metric).alias("value"))


def arm_summary(df: DataFrame, metric: str = "r2") -> DataFrame:
    """Mean, std (0 for one seed) and seeds of each arm's per-seed endpoint means."""
    return arm_seed_means(df, metric).groupBy("flavor").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("n"),
    )


def control_comparison(df: DataFrame, subject: str, baseline: str, context: Sequence[str],
                       metric: str = "r2") -> DataFrame:
    """One row: subject against baseline (Welch) and the context arm the subject is nearest to."""
    named = arm_seed_means(df, metric).filter(F.col("flavor").isin(subject, baseline, *context))
    arms = named.groupBy("flavor").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )
    # one record per named arm from here on
    is_subject, is_base = F.col("flavor") == subject, F.col("flavor") == baseline
    own = F.max(F.when(is_subject, F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    position = F.array_position(F.array(*[F.lit(c) for c in context]).cast("array<string>"), F.col("flavor"))
    placed = arms.withColumn("_own", own).withColumns({
        "_gap": F.when(position > 0, F.abs(F.col("mean") - F.col("_own"))), "_at": position,
    })
    parts = [
        F.max(F.when(who, F.col(c))).alias(f"{c}_{side}")
        for side, who in (("a", is_subject), ("b", is_base)) for c in ("n", "mean", "var")
    ]
    row = placed.agg(
        *parts,
        F.min_by("flavor", F.when(F.col("_gap").isNotNull(), F.struct("_gap", "_at"))).alias("nearest"),
        F.min("_gap").alias("distance"),
    )
    tested = row.select(
        F.lit(subject).alias("subject"), "n_a", "n_b", "mean_a", "mean_b",
        *significance.welch_columns(), "nearest", "distance",
    )
    return significance.with_t_pvalue(tested).withColumns(
        {"delta": F.col("mean_a") - F.col("mean_b"),
         "significant": significance.is_significant(F.col("p"))}
    )


# ---------------------------------------------------------------- external test

def external_test_report(df: DataFrame, recipe: str | Sequence[str] | None, control: str, prefix: str = "",
                         alpha: float = ALPHA) -> DataFrame:
    """Every phase's flavor ranking: mean and std of r2 and mae, delta and star against the control.

    ``recipe`` names the phase, or several; None is all that ``df`` has. Each is a family of its own.
    """
    wanted = [recipe] if isinstance(recipe, str) else recipe
    flavor = labels.strip_prefix(labels.seed_base(F.col("flavor")), prefix)
    rows = (df if wanted is None else df.filter(F.col("recipe").isin(*wanted))).select("recipe", flavor.alias("flavor"), "r2", "mae")
    zero = F.lit(0.0)
    table = rows.groupBy("recipe", "flavor").agg(
        F.avg("r2").alias("r2"), F.coalesce(F.stddev_samp("r2"), zero).alias("r2_std"),
        F.avg("mae").alias("mae"), F.coalesce(F.stddev_samp("mae"), zero).alias("mae_std"),
        F.count("r2").alias("n"),
    )
    tests = significance.dunnett(rows, ["recipe"], "flavor", "r2", control).select(
        "recipe", "flavor", "p",
        F.when(F.col("t").isNotNull(), F.col("mean") - F.col("mean0")).alias("delta"),
    )
    joined = table.join(tests, ["recipe", "flavor"], "left").withColumn(
        "star", significance.is_significant(F.col("p"), alpha)
    )
    return sort_ranking(joined, "r2", True, ["recipe"])


# ---------------------------------------------------------------- boxes

def box_stats(cells: DataFrame, column: str = "flavor", value: str = "value") -> DataFrame:
    """Quartiles per column, and whiskers at the last values within 1.5 IQR of the box."""
    q = stage(quantiles(cells, [column], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"]), "box")
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    return (
        cells.filter(v.isNotNull()).join(q, column).groupBy(column, "q1", "median", "q3").agg(
            F.count(value).alias("n"),
            F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("_low"),
            F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("_high"),
        )
        .select(column, "n", "q1", "median", "q3",
                F.coalesce("_low", "q1").alias("whisker_low"),
                F.coalesce("_high", "q3").alias("whisker_high"))
    )


def join_summary(table: DataFrame, extra: DataFrame, column: str = "flavor") -> DataFrame:
    return table.join(extra, column, "left")


def average_summary(cells: DataFrame, per_seed: DataFrame, tests: DataFrame | None = None,
                    alpha: float = ALPHA) -> DataFrame:
    """Box table per column: average, box, seeds, seed spread and, with tests, the p-value.

    ``cells`` are (row, flavor, value), ``per_seed`` (flavor, seed, value).
    """
    averages = cells.groupBy("flavor").agg(F.avg("value").alias("average"))
    seeds = per_seed.groupBy("flavor").agg(
        F.count("*").alias("n_seeds"), F.stddev_samp("value").alias("seed_sd")
    )
    table = join_summary(join_summary(averages, box_stats(cells)), seeds)
    table = table.filter(F.col("n").isNotNull()).withColumnRenamed("n", "n_endpoints")
    if tests is None:
        return table
    return join_summary(table, tests.select("flavor", "p")).withColumn(
        "significant", significance.is_significant(F.col("p"), alpha)
    )


# ---------------------------------------------------------------- analyses on ranked cells

def holm(tests: DataFrame, family: Sequence[str] = ("row",), p: str = "p") -> DataFrame:
    """Holm step-down adjusted p-values per family; missing p-values are left out of the count.

    A family holds one p-value per arm, so its window stays small.
    """
    by = Window.partitionBy(*family)
    order = by.orderBy(F.asc_nulls_last(p), "flavor")
    scaled = F.when(
        F.col(p).isNotNull(),
        F.col(p) * (F.count(p).over(by) - F.row_number().over(order) + 1),
    )
    return tests.withColumn("_s", scaled).withColumn(
        "p_holm",
        F.when(
            F.col(p).isNotNull(),
            F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))),
        ),
    ).drop("_s")


def family_means(cells: DataFrame, mapping: DataFrame, metric: str) -> DataFrame:
    """Mean per (endpoint family, flavor) and whether the flavor is the family's best."""
    pooled = cells.join(mapping, "row").groupBy("family", "flavor").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n")
    )
    best = row_winner(pooled, metric, ("family",), "flavor", "mean", "flavor")
    return pooled.join(best, "family").withColumn("best", F.col("flavor") == F.col("winner")).drop("winner")


def control_depth(n, k):
    """Best number of control replicates for k arms of n replicates each: n * sqrt(k)."""
    return n * F.sqrt(k)


def variance_ratio(df: DataFrame, metric: str) -> DataFrame:
    """Largest over smallest seed variance among the arms of each row."""
    arms = df.groupBy("row", "flavor").agg(F.var_samp(metric).alias("v"))
    return arms.groupBy("row").agg(
        F.min("v").alias("min_var"), F.max("v").alias("max_var"),
        ratio(F.max("v"), F.min("v")).alias("variance_ratio"),
    )


#: Votes of the standing arms, the arm that leaves, and who is left, in the words of a recursive query.
_VOTES = """transform({standing}, a -> named_struct('flavor', a.flavor, 'col_ord', a.col_ord, 'votes',
  aggregate(ballots, 0L, (n, b) -> n + if(filter(b.picks, p -> exists({standing}, s -> s.flavor = p))[0] = a.flavor, b.n, 0L))))"""
_DECIDED = "(size(tally) = 1 OR 2 * array_max(transform(tally, a -> a.votes)) > aggregate(tally, 0L, (n, a) -> n + a.votes))"
_OUT = "array_min(transform(tally, a -> named_struct('votes', a.votes, 'back', -a.col_ord, 'flavor', a.flavor))).flavor"


def instant_runoff(cells: DataFrame, metric: str) -> DataFrame:
    """Instant-runoff election: every row ranks the arms, the weakest arm goes each round.

    Ballots are (row, flavor, value, col_ord). The arm with the fewest first places leaves,
    the later in order on ties; rounds end when one arm holds a majority or stands alone.
    Returns (round, flavor, votes, eliminated).

    One recursive query, whose state is the arms that stand and the ballots; equal ballots are counted
    first, so there are as many as the displayed rows rank the arms differently. Spark stops a recursion after a
    hundred levels, so there may be as many arms.
    """
    sign = -1.0 if labels.higher_is_better(metric) else 1.0
    choice = F.when(F.col("value").isNotNull(), F.struct((F.col("value") * sign).alias("v"), "col_ord", "flavor"))
    ranked = cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(choice)), lambda c: c["flavor"]).alias("picks"))
    ballots = ranked.groupBy("picks").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("picks", "n")).alias("ballots"))
    arms = cells.groupBy("flavor").agg(F.min("col_ord").alias("col_ord")).agg(
        F.sort_array(F.collect_list(F.struct("col_ord", "flavor"))).alias("arms"))
    # one row each, joined by the constant they share
    start = arms.select("arms", F.lit(1).alias("k")).join(ballots.select("ballots", F.lit(1).alias("k")), "k").filter(F.size("arms") > 0)
    rounds = cells.sparkSession.sql(f"""
        WITH RECURSIVE rounds(round, most, tally, ballots) AS (
          SELECT 1, greatest(size(arms) - 1, 1), {_VOTES.format(standing='arms')}, ballots FROM {{start}}
          UNION ALL
          SELECT round + 1, most, {_VOTES.format(standing='rest')}, ballots
          FROM (SELECT *, filter(tally, a -> a.flavor <> {_OUT}) AS rest FROM rounds WHERE round < most AND NOT {_DECIDED}))
        SELECT round, tally, CASE WHEN {_DECIDED} THEN NULL ELSE {_OUT} END AS out FROM rounds""", start=start)
    return rounds.select("round", "out", F.inline("tally")).select(
        "round", "flavor", "votes", F.coalesce(F.col("flavor") == F.col("out"), F.lit(False)).alias("eliminated"))
