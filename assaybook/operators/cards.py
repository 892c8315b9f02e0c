"""Report cards: row identity and order, seed statistics, baselines, deltas, assembled cells.

Cards stay long, one record per (row, column), until something is written for a person.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import (
    ALPHA, AVERAGE_ROW, MODES, ROW_SEPARATOR, SCALE_CAP, SCALE_FLOOR, UNSEEDED,
)
from ..functions.cells import ratio
from ..functions.labels import dataset_of, strip_prefix
from ..functions.text import change_text, display_name, mean_text
from ..vocabulary import PLAIN, Arm, Vocabulary
from .ordering import with_row_id


# ---------------------------------------------------------------- rows

def prepare_rows(df: DataFrame, vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """Recompute ``dataset`` from the recipe and add the displayed ``row`` identity.

    A row that several recipes produce gets the recipe as a suffix. Which rows those are is a
    small aggregate joined back, so one busy row does not become one task.
    """
    named = df.withColumn("dataset", dataset_of(F.col("recipe"), vocabulary)).withColumn(
        "row", F.concat("dataset", F.lit(ROW_SEPARATOR), F.coalesce("endpoint", F.lit("")))
    )
    shared = named.groupBy("row").agg(
        (F.min("recipe") != F.max("recipe")).alias("_shared")
    )
    return named.join(shared, "row").withColumn(
        "row",
        F.when(F.col("_shared"), F.concat("row", F.lit(" ("), "recipe", F.lit(")"))).otherwise(F.col("row")),
    ).drop("_shared")


def dataset_rank(dataset: Column, vocabulary: Vocabulary = PLAIN) -> Column:
    """Display position of a dataset; unknown ones come last, together."""
    known = F.array(*[F.lit(d) for d in vocabulary.datasets]).cast("array<string>")
    at = F.array_position(known, dataset)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(vocabulary.datasets)))


def order_rows(df: DataFrame, vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """Distinct rows with their display position ``row_ord``: dataset, endpoint, row."""
    rows = df.select("dataset", "endpoint", "row").distinct().withColumn(
        "_rank", dataset_rank(F.col("dataset"), vocabulary)
    )
    return with_row_id(rows, ["_rank", "endpoint", "row"], "row_ord").drop("_rank")


def source_groups(rows: DataFrame, name: Column | None = None) -> DataFrame:
    """Contiguous runs of one source down the card: (start, end, source), end exclusive.

    ``rows`` needs ``row`` and ``row_ord``. With ``name`` adjacent runs of one name are one.
    The windows run over displayed rows, of which a card has one per endpoint.
    """
    source = F.substring_index("row", ROW_SEPARATOR, 1)
    order = Window.orderBy("row_ord")
    marked = rows.withColumn("source", source).withColumn(
        "_name", name if name is not None else F.col("source")
    )
    changed = F.coalesce(F.col("_name") != F.lag("_name").over(order), F.lit(True))
    runs = marked.withColumn("_new", changed.cast("int")).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy("_run").agg(
        F.min("row_ord").alias("start"),
        (F.max("row_ord") + 1).alias("end"),
        F.min_by("source", "row_ord").alias("source"),
    ).drop("_run")


def merge_groups(rows: DataFrame, vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """Source runs, with adjacent runs of one display name fused."""
    return source_groups(rows, display_name(F.col("source"), vocabulary))


def filter_mode(df: DataFrame, mode: str, column: str = "flavor") -> DataFrame:
    """One protocol's rows, with its ``lr_<mode>__`` prefix taken off."""
    prefix = f"lr_{mode}__"
    return df.filter(F.col(column).startswith(prefix)).withColumn(
        column, strip_prefix(F.col(column), prefix)
    )


# ---------------------------------------------------------------- cells

def seed_matrix(
    df: DataFrame, metric: str, columns: Sequence[str] | None = None, pivot: bool = False
) -> DataFrame:
    """Seed mean and sample std per (row, flavor); std is missing for a single seed.

    With ``columns`` only those flavors are kept. ``pivot`` spreads the means over them.
    """
    kept = df.filter(F.col("flavor").isin(*columns)) if columns is not None else df
    cells = kept.groupBy("row", "flavor").agg(
        F.avg(metric).alias("value"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n")
    )
    if not pivot:
        return cells
    if columns is None:
        raise ValueError("a pivot needs its columns named")
    return cells.groupBy("row").pivot("flavor", list(columns)).agg(F.first("value"))


def reference_series(df: DataFrame, flavor: str, metric: str) -> DataFrame:
    """The control arm's seed mean and std per row."""
    return df.filter(F.col("flavor") == flavor).groupBy("row").agg(
        F.avg(metric).alias("base"), F.stddev_samp(metric).alias("base_std")
    )


def with_baseline(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    return cells.join(baseline, "row", "left")


def complete_grid(cells: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every (row, column) of the card, absent cells as missing.

    ``columns`` is the display order of the registry; its position becomes ``col_ord``.
    """
    names = F.array(*[F.lit(c) for c in columns])
    grid = rows.select("*", F.posexplode(names).alias("col_ord", "flavor"))
    return grid.join(cells, ["row", "flavor"], "left")


def percent_change(value: Column, base: Column) -> Column:
    """100 * (value - base) / base, missing without a usable base."""
    return ratio(100.0 * (value - base), base)


def delta_matrix(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cells plus ``delta``, their percentage change against the row's baseline."""
    return with_baseline(cells, baseline).withColumn(
        "delta", percent_change(F.col("value"), F.col("base"))
    )


def delta_std(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """First-order error of the percentage change from both seed spreads."""
    b, f = F.col("base"), F.col("value")
    own, shared = ratio(F.col("std"), b), ratio(f * F.col("base_std"), b * b)
    return with_baseline(cells, baseline).withColumn(
        "delta_std", 100.0 * F.sqrt(own * own + shared * shared)
    )


def append_average(cells: DataFrame, value: str = "value", column: str = "flavor") -> DataFrame:
    """(row, column, value) cells plus an AVERAGE row: each column's mean over present rows."""
    slim = cells.select("row", column, F.col(value).alias("value"))
    average = slim.groupBy(column).agg(F.avg("value").alias("value")).select(
        F.lit(AVERAGE_ROW).alias("row"), column, "value"
    )
    return slim.unionByName(average)


def scale_extent(cells: DataFrame, value: str = "delta") -> DataFrame:
    """Half-width of a symmetric colour scale over cells and column averages, floored and capped."""
    averages = cells.groupBy("flavor").agg(F.avg(value).alias("_v")).select("_v")
    widest = cells.select(F.col(value).alias("_v")).union(averages).agg(F.max(F.abs("_v")).alias("m"))
    return widest.select(
        F.least(
            F.greatest(F.coalesce("m", F.lit(1.0)), F.lit(SCALE_FLOOR)), F.lit(SCALE_CAP)
        ).alias("extent")
    )


def gate(value: Column, p: Column, alpha: float = ALPHA) -> Column:
    """Colour value: missing stays missing, a change that is not significant is zero."""
    return F.when(value.isNull(), None).when(p <= alpha, value).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- per-seed averages

def per_seed_average(df: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """One value per (flavor, seed): the metric's mean over the given rows.

    Untagged rows form a replicate of their own, seed -1.
    """
    return (
        df.join(rows.select("row").distinct(), "row", "left_semi")
        .withColumn("seed", F.coalesce("seed", F.lit(UNSEEDED)))
        .groupBy("flavor", "seed", "row").agg(F.avg(metric).alias("_m"))
        .groupBy("flavor", "seed").agg(F.avg("_m").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def per_seed_average_delta(df: DataFrame, rows: DataFrame, baseline: DataFrame, metric: str = "mae") -> DataFrame:
    """One value per (flavor, seed): mean percentage change against the baseline over the rows."""
    return (
        df.join(rows.select("row").distinct(), "row", "left_semi")
        .withColumn("seed", F.coalesce("seed", F.lit(UNSEEDED)))
        .groupBy("flavor", "seed", "row").agg(F.avg(metric).alias("_m"))
        .join(baseline.select("row", "base"), "row", "left")
        .withColumn("_d", percent_change(F.col("_m"), F.col("base")))
        .groupBy("flavor", "seed").agg(F.avg("_d").alias("value"))
        .filter(F.col("value").isNotNull())
    )


# ---------------------------------------------------------------- assembled cards

def r2_card(df: DataFrame, baseline_flavor: str, columns: Sequence[str], metric: str = "r2",
            baseline_name: str = "baseline", control: DataFrame | None = None,
            vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """The metric card, long: baseline column first, registry order after it, AVERAGE row last.

    Of ``columns`` only those that occur are shown. The spread shown with a cell is its seed
    std; the AVERAGE row carries none. ``df`` is read several times, so stage it if it is dear.
    """
    columns = present_columns(df, columns)
    rows = order_rows(df, vocabulary)
    cells = complete_grid(seed_matrix(df, metric, columns), rows.select("row", "row_ord"), columns)
    cells = cells.select("row_ord", "row", (F.col("col_ord") + 1).alias("col_ord"),
                         F.col("flavor").alias("column"), "value", F.col("std").alias("aux"))
    source = control if control is not None else df
    base = rows.join(reference_series(source, baseline_flavor, metric), "row", "left").select(
        "row_ord", "row", F.lit(0).alias("col_ord"), F.lit(baseline_name).alias("column"),
        F.col("base").alias("value"), F.col("base_std").alias("aux"),
    )
    body = cells.unionByName(base)
    average = body.groupBy("col_ord", "column").agg(
        F.max(F.col("row_ord") + 1).alias("row_ord"), F.avg("value").alias("value")
    ).select("row_ord", F.lit(AVERAGE_ROW).alias("row"), "col_ord", "column", "value",
             F.lit(None).cast("double").alias("aux"))
    return body.unionByName(average).withColumns(
        {"color_value": F.col("value"), "text": mean_text(F.col("value"), F.col("aux"))}
    )


def mae_delta_card(deltas: DataFrame, cell_p: DataFrame, average_p: DataFrame, rows: DataFrame,
                   columns: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """The change card, long: p-values beside the cells, colour only where significant.

    ``deltas`` and ``cell_p`` are per (row, flavor); ``average_p`` is the separate family of
    the AVERAGE row, per flavor.
    """
    columns = present_columns(deltas, columns)
    cells = complete_grid(
        deltas.select("row", "flavor", F.col("delta").alias("value"))
        .join(cell_p.select("row", "flavor", "p"), ["row", "flavor"], "left"),
        rows.select("row", "row_ord"), columns,
    ).select("row_ord", "row", "col_ord", F.col("flavor").alias("column"), "value", F.col("p").alias("aux"))
    average = (
        cells.groupBy("col_ord", "column")
        .agg(F.max(F.col("row_ord") + 1).alias("row_ord"), F.avg("value").alias("value"))
        .join(average_p.select(F.col("flavor").alias("column"), F.col("p").alias("aux")), "column", "left")
        .select("row_ord", F.lit(AVERAGE_ROW).alias("row"), "col_ord", "column", "value", "aux")
    )
    return cells.unionByName(average).withColumns(
        {
            "color_value": gate(F.col("value"), F.col("aux"), alpha),
            "text": change_text(F.col("value"), F.col("aux")),
        }
    )


# ---------------------------------------------------------------- registry and grid

def registry(spark: SparkSession, arms: Sequence[Arm]) -> DataFrame:
    """The arms as a dimension table; ``ord`` is the display order."""
    return spark.createDataFrame(
        [(*astuple(arm), i) for i, arm in enumerate(arms)],
        "name string, kind string, source string, width int, derived_from string, "
        "calculator string, corpus_from string, standalone boolean, ord int",
    )


def present_columns(df: DataFrame, columns: Sequence[str], column: str = "flavor") -> list[str]:
    """Those of the wanted columns that occur in ``df``, in wanted order."""
    have = {r[0] for r in df.filter(F.col(column).isin(*columns)).select(column).distinct().collect()}
    return [c for c in columns if c in have]


def column_order(wanted: DataFrame, present: DataFrame, column: str = "flavor") -> DataFrame:
    """The wanted (name, ord) columns that are present, in wanted order."""
    return wanted.join(present.select(F.col(column).alias("name")).distinct(), "name", "left_semi").orderBy("ord")


def resolve_corpus(registry: DataFrame, shared: str = "shared") -> DataFrame:
    """Each flavor's corpus: borrowed, its own when others borrow from it, or the shared one."""
    owners = registry.filter(F.col("corpus_from").isNotNull()).select(
        F.col("corpus_from").alias("name"), F.lit(True).alias("_owner")
    ).distinct()
    return registry.join(owners, "name", "left").select(
        "name",
        F.coalesce(
            "corpus_from", F.when(F.col("_owner"), F.col("name")), F.lit(shared)
        ).alias("corpus"),
    )


def experiment_grid(endpoints: DataFrame, flavors: Sequence[str], seeds: Sequence[int],
                    modes: Sequence[str] = MODES, foundation_seed: int | None = None) -> DataFrame:
    """Every expected (flavor, seed, mode, recipe, endpoint) with its result label.

    ``foundation_seed`` pins the seed of the foundation every replicate starts from; without
    it the foundation follows the finetune seed.
    """
    def lits(values):
        return F.array(*[F.lit(v) for v in values])

    grid = (
        endpoints.select("recipe", "endpoint").distinct()
        .withColumn("flavor", F.explode(lits(flavors)))
        .withColumn("seed", F.explode(lits([int(s) for s in seeds]).cast("array<bigint>")))
        .withColumn("mode", F.explode(lits(modes)))
    )
    tail = F.concat("flavor", F.lit("__s"), F.col("seed").cast("string"))
    pinned = F.col("seed") if foundation_seed is None else F.lit(foundation_seed)
    return grid.withColumns(
        {
            "label": F.when(F.col("mode") == MODES[0], tail).otherwise(
                F.concat(F.lit("lr_"), "mode", F.lit("__"), tail)
            ),
            "foundation": F.concat("flavor", F.lit("__s"), pinned.cast("string")),
        }
    )


def grid_audit(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing and surplus (label, recipe, endpoint) cells of an experiment grid."""
    keys = ["label", "recipe", "endpoint"]
    have = observed.select(F.col("flavor").alias("label"), "recipe", "endpoint").distinct()
    want = grid.select(*keys)
    return want.join(have, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(
        have.join(want, keys, "left_anti").withColumn("status", F.lit("surplus"))
    )


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not done yet."""
    return grid.join(done.select(*keys), list(keys), "left_anti")
