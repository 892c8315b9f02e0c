"""Family-wise and pairwise tests, all in SQL: group statistics, and tail integrals over quadrature nodes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALPHA
from ..functions.cells import ratio
from ..functions.normal import legendre, normal_cdf, normal_grid
from ..session import stage

MIN_OBSERVATIONS = 2
#: Quadrature nodes: of the pooled scale, of the control's mean, and of a t tail.
SCALE_NODES, MEAN_NODES, TAIL_NODES = 48, 161, 200


# ---------------------------------------------------------------- Spark

def dunnett_stats(
    df: DataFrame, family: Sequence[str], arm: str, value: str, control: str,
    controls: DataFrame | None = None,
) -> DataFrame:
    """Per family and arm: n, mean, pooled variance, degrees of freedom and t.

    Arms with fewer than two values are in the result with a missing t and outside the
    family. A family without a usable control or without residual variance has no t at all.
    ``controls`` gives the control's rows when they are not among ``df``.
    """
    family = list(family)
    is_control = F.col(arm) == control
    source = controls if controls is not None else df
    rows = df.filter(~is_control).select(*family, arm, value).unionByName(
        source.filter(is_control).select(*family, arm, value)
    )
    arms = rows.filter(F.col(value).isNotNull()).groupBy(*family, arm).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("ss"),
    )
    whole = Window.partitionBy(*family)              # one record per arm
    usable = F.col("n") >= MIN_OBSERVATIONS
    in_pool = usable & ~is_control
    of_control = lambda c: F.max(F.when(is_control, F.col(c))).over(whole)
    placed = arms.withColumns({
        "n0": of_control("n"), "mean0": of_control("mean"), "_ss0": of_control("ss"),
        "_ss": F.sum(F.when(in_pool, F.col("ss"))).over(whole),
        "_n": F.sum(F.when(in_pool, F.col("n"))).over(whole),
        "arms": F.count(F.when(in_pool, 1)).over(whole),
    }).filter(~is_control)
    ready = usable & (F.col("n0") >= MIN_OBSERVATIONS) & (F.col("_ss") + F.col("_ss0") > 0)
    dof = F.col("_n") + F.col("n0") - F.col("arms") - 1
    pooled = ratio(F.col("_ss") + F.col("_ss0"), dof)
    t = ratio(
        F.col("mean") - F.col("mean0"),
        F.sqrt(pooled * (ratio(F.lit(1.0), F.col("n")) + ratio(F.lit(1.0), F.col("n0")))),
    )
    return placed.select(
        *family, arm, "n", "mean", "n0", "mean0",
        F.when(ready, F.col("arms")).alias("arms"),
        F.when(ready, dof).alias("df"),
        F.when(ready, pooled).alias("pooled_var"),
        F.when(ready, t).alias("t"),
    )


def dunnett(
    df: DataFrame, family: Sequence[str], arm: str, value: str, control: str,
    controls: DataFrame | None = None,
) -> DataFrame:
    """Two-sided Dunnett p-value ``p`` per family and arm, next to the test's statistics.

    The pooled variance comes from the arms given, so the displayed column set changes the
    p-values.
    """
    stats = stage(dunnett_stats(df, family, arm, value, control, controls), "tests")
    keys = [*family, arm]
    tails = dunnett_tails(stats, family, arm)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return stats.alias("s").join(tails.alias("t"), same, "left").select("s.*", "t.p")


def dunnett_tails(stats: DataFrame, family: Sequence[str], arm: str) -> DataFrame:
    """P(max |T| > |t|) of many-to-one contrasts: (family, arm, p), from n, n0, df and t.

    The contrasts share the control, so given its mean and the pooled scale they are
    independent. That leaves a mean over both: every arm meets the nodes of the two, and at each
    node the chances of all arms of its family are multiplied. Arms of one size share a factor.
    """
    family, keys = list(family), [*family, arm]
    tested = stats.filter(F.col("t").isNotNull())
    whole = Window.partitionBy(*family)              # one record per arm
    lam = lambda n: F.sqrt(n / (n + F.col("n0").cast("double")))
    count = lambda n: F.size(F.filter("_all", lambda m: m == n))
    sizes = F.transform(F.array_distinct("_all"), lambda n: F.struct(lam(n).alias("lam"), count(n).alias("count")))
    sized = tested.withColumn("_all", F.collect_list("n").over(whole)).select(
        *keys, F.abs("t").alias("_t"), F.col("df").cast("double").alias("_df"), sizes.alias("_sizes"))
    spread = 1 / F.sqrt(2 * F.col("_df"))
    few = F.col("_df") < 8
    low = F.when(few, 1e-9).otherwise(F.greatest(F.lit(1e-9), 1 - 9 * spread))
    high = F.when(few, F.greatest(F.lit(6.0), 1 + 10 * spread)).otherwise(1 + 10 * spread)
    scaled = sized.select("*", F.explode(legendre(SCALE_NODES)).alias("_s"), low.alias("_low"), high.alias("_high"))
    s = 0.5 * (F.col("_high") - F.col("_low")) * F.col("_s.x") + 0.5 * (F.col("_high") + F.col("_low"))
    # the density of the scale but for a constant, which cancels
    scaled = scaled.withColumn("_at", s).select(
        *keys, "_sizes", (F.col("_t") * F.col("_at")).alias("_reach"),
        (F.col("_s.w") * F.exp((F.col("_df") - 1) * F.log("_at") - F.col("_df") * (F.col("_at") * F.col("_at") - 1) / 2)).alias("_ws"))
    placed = scaled.select(*keys, "_sizes", "_reach", "_ws", F.explode(normal_grid(MEAN_NODES)).alias("_z"))

    def bounds(of: Column) -> list[Column]:
        width, mean = F.sqrt(1 - of["lam"] * of["lam"]), of["lam"] * F.col("_z.x")
        return [((mean + F.col("_reach")) / width).alias("hi"), ((mean - F.col("_reach")) / width).alias("lo")]

    # bounds are columns of their own, so that the distribution function repeats names and no formulas; families of
    # one size, as most are, need no walk over their sizes
    others = F.transform(F.slice("_sizes", 2, F.size("_sizes")), lambda of: F.struct(*bounds(of), of["count"].alias("count")))
    bounded = placed.select(
        *keys, (F.col("_ws") * F.col("_z.w")).alias("_w"), *bounds(F.col("_sizes")[0]), F.col("_sizes")[0]["count"].alias("_count"),
        F.when(F.size("_sizes") > 1, others).alias("_others"))
    inside = lambda of: F.pow(normal_cdf(of["hi"]) - normal_cdf(of["lo"]), of["count"])
    rest = F.when(F.col("_others").isNull(), 1.0).otherwise(F.aggregate("_others", F.lit(1.0), lambda product, of: product * inside(of)))
    points = bounded.select(*keys, "_w", (normal_cdf(F.col("hi")) - normal_cdf(F.col("lo"))).alias("_in"), "_count", rest.alias("_rest"))
    p = 1 - F.sum(F.col("_w") * F.pow("_in", "_count") * F.col("_rest")) / F.sum("_w")
    return points.groupBy(*keys).agg(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias("p"))


def cell_pvalues(matrix: DataFrame, control_rows: DataFrame, baseline: str,
                 columns: Sequence[str], metric: str = "mae") -> DataFrame:
    """Per-cell p-values: a displayed row is a family, sized to the displayed columns."""
    shown = matrix.filter(F.col("flavor").isin(*columns) & (F.col("flavor") != baseline))
    return dunnett(shown, ["row"], "flavor", metric, baseline, control_rows)


def average_pvalues(per_seed: DataFrame, control_per_seed: DataFrame, baseline: str,
                    columns: Sequence[str]) -> DataFrame:
    """AVERAGE-row p-values: one family over per-seed mean changes."""
    shown = per_seed.filter(F.col("flavor").isin(*columns) & (F.col("flavor") != baseline))
    one = shown.withColumn("family", F.lit(AVERAGE_FAMILY))
    ctl = control_per_seed.withColumn("family", F.lit(AVERAGE_FAMILY))
    return dunnett(one, ["family"], "flavor", "value", baseline, ctl).drop("family")


AVERAGE_FAMILY = "average"


def welch_stats(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Welch t and degrees of freedom of two samples per key; missing below two values a side."""
    sides = a.select(*keys, value, F.lit("a").alias("_side")).unionByName(
        b.select(*keys, value, F.lit("b").alias("_side"))
    )
    parts = []
    for side in ("a", "b"):
        v = F.when(F.col("_side") == side, F.col(value))
        parts += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"), F.var_samp(v).alias(f"var_{side}")]
    both = sides.groupBy(*keys).agg(*parts)
    return both.select(*keys, "n_a", "n_b", "mean_a", "mean_b", *welch_columns())


def welch_columns() -> list[Column]:
    """t and df from the columns n_a, mean_a, var_a and n_b, mean_b, var_b."""
    va, vb = ratio(F.col("var_a"), F.col("n_a")), ratio(F.col("var_b"), F.col("n_b"))
    enough = (F.col("n_a") >= MIN_OBSERVATIONS) & (F.col("n_b") >= MIN_OBSERVATIONS)
    dof = ratio((va + vb) * (va + vb),
                ratio(va * va, F.col("n_a") - 1) + ratio(vb * vb, F.col("n_b") - 1))
    t = ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    return [F.when(enough, t).alias("t"), F.when(enough, dof).alias("df")]


def with_t_pvalue(stats: DataFrame) -> DataFrame:
    """Add the two-sided p-value of ``t`` at ``df`` degrees of freedom."""
    return stats.withColumn("p", t_tail(F.col("t"), F.col("df")))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic.

    With t = sqrt(df) tan(angle) the density becomes a power of the cosine, so the tail is the share of
    its integral from the observed angle up; both integrals end where nothing is left of it.
    """
    df, start = df.cast("double"), F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    reach = 40 / F.sqrt(df)

    def integral(a: Column) -> Column:
        half = (F.least(F.lit(math.pi / 2), a + reach) - a) / 2
        angle = lambda node: a + half * (1 + node["x"])
        power = lambda node: node["w"] * F.exp((df - 1) * F.log(F.greatest(F.cos(angle(node)), F.lit(1e-300))))
        return half * F.aggregate(legendre(TAIL_NODES), F.lit(0.0), lambda total, node: total + power(node))

    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), integral(start) / integral(F.lit(0.0))))


def is_significant(p, alpha: float = ALPHA):
    return F.coalesce(p <= alpha, F.lit(False))
