"""Out-of-fold stacking of per-flavor predictions, from fold-wise sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import UNSEEDED
from ..functions.cells import ratio
from ..functions.labels import dataset_of, seed_base, seed_number, strip_prefix
from ..session import stage
from ..vocabulary import PLAIN, Vocabulary
from .splits import assign_folds
from .trees import held_out_predictions

UNIT = ("dataset", "recipe", "endpoint", "seed")


def labelled_predictions(pred: DataFrame, strip: str = "", vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """Split the label of long predictions into ``flavor`` and ``seed``, and add the dataset.

    ``strip`` is a namespace such as ``lr_reduced__`` that maps a protocol's labels back to bare
    flavors. Labels without a seed form a replicate of their own.
    """
    label = F.col("label")
    return pred.withColumns(
        {
            "flavor": strip_prefix(seed_base(label), strip) if strip else seed_base(label),
            "seed": F.coalesce(seed_number(label), F.lit(UNSEEDED)),
            "dataset": dataset_of(F.col("recipe"), vocabulary),
        }
    ).drop("label")


def stack_features(pred: DataFrame, flavors: Sequence[str], unit: Sequence[str] = UNIT) -> DataFrame:
    """One row per test item: truth and one prediction column per flavor, seeds kept apart.

    A unit stacks the flavors that it has; of the others its column is missing throughout, and
    ``n_flavors`` says how many it has. A unit with fewer than two is left out, and so are items
    that lack a prediction of one of their unit's flavors. Two predictions of one flavor for one
    item are an error, as the unit then mixes what should be kept apart.
    """
    unit = list(unit)
    own = pred.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull() & F.col("flavor").isin(*flavors))
    is_, has = (lambda f: F.col("flavor") == f), (lambda f: F.col(f"h_{f}"))
    wide = own.groupBy(*unit, "row_id").agg(
        F.max("y_true").alias("y"),
        *[F.max(F.when(is_(f), F.col("y_pred"))).alias(f"f_{f}") for f in flavors],
        F.greatest(*[F.count_if(is_(f)) for f in flavors], F.lit(0)).alias("_most"),
    )
    present = own.groupBy(*unit).agg(*[F.coalesce(F.max(is_(f)), F.lit(False)).alias(f"h_{f}") for f in flavors])
    present = present.withColumn("n_flavors", sum((has(f).cast("int") for f in flavors), F.lit(0))).filter("n_flavors >= 2")
    # staged, so that its size is known: few units would otherwise be joined in as few tasks
    present = stage(present, "present")
    complete = F.lit(True)
    for f in flavors:
        complete = complete & (~has(f) | F.col(f"f_{f}").isNotNull())
    once = F.when(F.col("_most") > 1, F.raise_error(F.lit("an item has two predictions of one flavor"))).otherwise(F.col("y"))
    return wide.join(present, unit).filter(complete).select(
        *unit, "row_id", once.alias("y"), *[f"f_{f}" for f in flavors], "n_flavors"
    )


def present_flavors(pred: DataFrame, registry: Sequence[str]) -> list[str]:
    """Registered flavors that have predictions, in registry order; at least two are needed."""
    have = {r[0] for r in pred.select("flavor").filter(F.col("flavor").isin(*registry)).distinct().collect()}
    flavors = [f for f in registry if f in have]
    if len(flavors) < 2:
        raise ValueError("stacking needs the predictions of two flavors or more")
    return flavors


def _r2(n: Column, total: Column, sse: Column) -> Column:
    """r2 from the spread of the truth and the squared errors; of a constant truth one if perfect, else zero."""
    perfect = F.when(sse <= 0, 1.0).otherwise(0.0)
    return F.when((n < 2) | sse.isNull(), None).when(total <= 0, perfect).otherwise(1 - ratio(sse, total))


def best_single(folded: DataFrame, flavors: Sequence[str], unit: Sequence[str] = UNIT) -> DataFrame:
    """Per fold, the flavor with the best r2 on the other folds: (unit, fold, winner).

    Leave-one-fold-out r2 is the total of each sum minus the fold's own, so one aggregate over
    the data serves all folds. Spreads are combined from the folds' own means, so that a large
    mean does not drown them. A flavor the unit lacks never wins; registry order breaks ties.
    """
    y = F.col("y")
    sums = folded.groupBy(*unit, "fold").agg(
        F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("s"),
        *[F.sum((y - F.col(f"f_{f}")) * (y - F.col(f"f_{f}"))).alias(f"e_{f}") for f in flavors],
    )
    whole = Window.partitionBy(*unit)                # one record per fold
    n = F.col("n")
    sums = sums.withColumn("d", F.col("m") - F.sum(n * F.col("m")).over(whole) / F.sum(n).over(whole))
    sums = sums.withColumn("s", F.col("s") + n * F.col("d") * F.col("d"))
    rest = {c: F.sum(c).over(whole) - F.col(c) for c in ["n", "s", *[f"e_{f}" for f in flavors]]}
    left = sums.select(*unit, "fold", (n * F.col("d")).alias("nd"), *[v.alias(c) for c, v in rest.items()])
    spread = F.col("s") - F.col("nd") * F.col("nd") / F.nullif(F.col("n"), F.lit(0))
    scores = F.array(*[
        F.struct(_r2(F.col("n"), spread, F.col(f"e_{f}")).alias("r2"), F.lit(-i).alias("o"), F.lit(f).alias("flavor"))
        for i, f in enumerate(flavors)
    ])
    return left.select(*unit, "fold", F.array_max(scores)["flavor"].alias("winner"))


def best_single_oof(folded: DataFrame, flavors: Sequence[str], unit: Sequence[str] = UNIT) -> DataFrame:
    """Every row with the held-out prediction ``single`` of its fold's best flavor."""
    winners = stage(best_single(folded, flavors, unit), "winners")
    pick = F.coalesce(*[F.when(F.col("winner") == f, F.col(f"f_{f}")) for f in flavors])
    return folded.join(winners, [*unit, "fold"]).withColumn("single", pick)


def ridge_weights(folded: DataFrame, flavors: Sequence[str], unit: Sequence[str] = UNIT,
                  alpha: float = 1.0) -> DataFrame:
    """Ridge weights per fold, fit on the other folds: (unit, fold, intercept, weights).

    Normal equations are sums over rows, so one aggregate per fold holds everything; each fold
    subtracts its own sums from the total. Only a (k+1)-square system per fold is solved in
    numpy. Predictions are centred on the unit's mean truth to keep the sums well scaled, and
    the intercept is not penalized.
    """
    unit = list(unit)
    k = len(flavors)
    centre = stage(folded.groupBy(*unit).agg(F.avg("y").alias("_c")), "centres")
    rows = folded.join(centre, unit)
    # a flavor that the unit lacks is zero throughout, and so is its weight
    x = [F.lit(1.0), *[F.coalesce(F.col(f"f_{f}") - F.col("_c"), F.lit(0.0)) for f in flavors], F.col("y") - F.col("_c")]
    names = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    sums = rows.groupBy(*unit, "fold", "_c").agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in names])
    fields = {f.name: f.dataType.simpleString() for f in folded.schema.fields}
    schema = ", ".join(f"`{u}` {fields[u]}" for u in unit) + ", fold int, intercept double, weights array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros((len(pdf), k + 2, k + 2))
        for i, j in names:
            grams[:, i, j] = grams[:, j, i] = pdf[f"s{i}_{j}"].to_numpy(float)
        total, centre_value = grams.sum(axis=0), float(pdf["_c"].iloc[0])
        out = []
        for own, fold in zip(grams, pdf["fold"]):
            g = total - own
            a, b = g[: k + 1, : k + 1].copy(), g[: k + 1, k + 1]
            a[np.arange(1, k + 1), np.arange(1, k + 1)] += alpha
            w = np.linalg.lstsq(a, b, rcond=None)[0]
            held = np.diag(total)[1 : k + 1] > 0                 # the flavors the unit has
            intercept = w[0] + centre_value - float(w[1:][held].sum()) * centre_value
            out.append((*[pdf[u].iloc[0] for u in unit], int(fold), intercept, w[1:].tolist()))
        return pd.DataFrame(out, columns=[*unit, "fold", "intercept", "weights"])

    return sums.groupBy(*unit).applyInPandas(solve, schema)


def stack_oof(features: DataFrame, flavors: Sequence[str], unit: Sequence[str] = UNIT, k: int = 5,
              seed: int = 0, estimator: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """Score the stacker and the fold-wise best single flavor out of fold, per unit.

    Columns: n_test, n_flavors, estimator, meta_r2, meta_rmse, best_single_flavor,
    best_single_r2, delta_r2.
    """
    unit = list(unit)
    folded = assign_folds(features, unit, "row_id", k, seed)          # on staged rows
    winners = stage(best_single(folded, flavors, unit), "winners")
    scored = folded.join(winners, [*unit, "fold"]).withColumn(
        "single", F.coalesce(*[F.when(F.col("winner") == f, F.col(f"f_{f}")) for f in flavors])
    )
    if estimator == "ridge":
        fitted = stage(ridge_weights(folded, flavors, unit, alpha), "weights")
        meta = F.col("intercept")
        for i, f in enumerate(flavors):
            meta = meta + F.coalesce(F.col("weights")[i] * F.col(f"f_{f}"), F.lit(0.0))
        scored = scored.join(fitted, [*unit, "fold"]).withColumn("meta", meta)
    elif estimator in ("rf", "gbt"):
        held_out = held_out_predictions(folded, unit, [f"f_{f}" for f in flavors], estimator, seed)
        scored = scored.join(stage(held_out, "held_out"), [*unit, "row_id"])
    else:
        raise ValueError(f"estimator must be ridge, rf or gbt, not {estimator!r}")
    y = F.col("y")
    sums = scored.groupBy(*unit).agg(
        F.count("*").alias("n_test"), F.avg((y - F.col("meta")) * (y - F.col("meta"))).alias("_mm"),
        F.avg((y - F.col("single")) * (y - F.col("single"))).alias("_ms"), F.var_pop("y").alias("_v"),
        F.max("n_flavors").alias("n_flavors"),
    )

    def r2(mse: str) -> Column:
        perfect = F.when(F.col(mse) == 0, 1.0).otherwise(0.0)
        return F.when(F.col("_v") == 0, perfect).otherwise(1 - ratio(F.col(mse), F.col("_v")))

    chosen = most_frequent(winners, unit, "winner", flavors).withColumnRenamed("winner", "best_single_flavor")
    return sums.join(chosen, unit).select(
        *unit, "n_test", "n_flavors", F.lit(estimator).alias("estimator"),
        r2("_mm").alias("meta_r2"), F.sqrt("_mm").alias("meta_rmse"), "best_single_flavor",
        r2("_ms").alias("best_single_r2"), (r2("_mm") - r2("_ms")).alias("delta_r2"),
    )


def most_frequent(df: DataFrame, unit: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """The most frequent value per unit; registry order breaks ties."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    counts = df.groupBy(*unit, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*unit).agg(F.min_by(column, F.struct(-F.col("_n"), at)).alias(column))


def aggregate_stack_seeds(scores: DataFrame, flavors: Sequence[str], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Per endpoint over seeds: mean and std of scores and deltas, and the usual best flavor.

    Scores are averaged, never predictions, because the seeds' test sets differ.
    """
    zero = F.lit(0.0)
    table = scores.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"), F.max("n_flavors").alias("n_flavors"),
        F.bround(F.avg("n_test")).cast("long").alias("n_test"), F.first("estimator").alias("estimator"),
        F.avg("meta_r2").alias("meta_r2"), F.coalesce(F.stddev_samp("meta_r2"), zero).alias("meta_r2_std"),
        F.avg("meta_rmse").alias("meta_rmse"), F.avg("best_single_r2").alias("best_single_r2"),
        F.avg("delta_r2").alias("delta_r2"), F.coalesce(F.stddev_samp("delta_r2"), zero).alias("delta_r2_std"),
    )
    return table.join(most_frequent(scores, keys, "best_single_flavor", flavors), list(keys))


def stack_report(pred: DataFrame, registry: Sequence[str], unit: Sequence[str] = UNIT, k: int = 5,
                 seed: int = 0, estimator: str = "ridge") -> DataFrame:
    """Predictions -> one row per endpoint: each seed is scored alone, then scores are averaged."""
    flavors = present_flavors(pred, registry)
    scores = stage(stack_oof(stack_features(pred, flavors, unit), flavors, unit, k, seed, estimator), "scores")
    return aggregate_stack_seeds(scores, flavors, [u for u in unit if u != "seed"])


def stack_summary(report: DataFrame) -> DataFrame:
    """Endpoints where stacking wins, endpoints in all, and the mean delta."""
    return report.agg(
        F.count_if(F.col("delta_r2") > 0).alias("wins"), F.count("*").alias("total"),
        F.avg("delta_r2").alias("mean_delta"),
    )
