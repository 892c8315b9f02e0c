"""Key corpora: standardizing, seeded subsets, leakage, label clean-up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import MAX_KEY_LENGTH
from ..functions.cells import lenient_double
from .ordering import hash_cutoff, hash_order


def _longest(parts: Column) -> Column:
    """(canonical, stripped) of non-empty parts: the longest one, the first of equals."""
    sized = F.transform(
        parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("o"), p.alias("p"))
    )
    kept = F.filter(sized, lambda p: p["n"] > 0)
    return F.struct(
        F.array_max(kept)["p"].alias("canonical"), (F.size(kept) > 1).alias("stripped")
    )


def largest_fragment(key: Column, separator: str = r"\.") -> Column:
    """(canonical, stripped): the longest fragment, the first of equals; empty is missing.

    A key of one fragment is kept whole; ``stripped`` says that fragments were removed.
    """
    return _longest(F.transform(F.split(F.trim(key), separator), lambda p: F.trim(p)))


def text_canonical(key: Column) -> Column:
    """Canonicalizer for prose keys: lower case, single blanks, longest line kept."""
    flat = F.regexp_replace(F.lower(key), r"[ \t\x0B\f\r]+", " ")
    return _longest(F.transform(F.split(flat, "\n"), lambda s: F.trim(s)))


def standardize_keys(
    df: DataFrame, column: str, fn: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, Observation]:
    """Add ``canonical`` and ``stripped``, drop rows without a canonical key, count rejects.

    ``fn`` maps the key column to a (canonical, stripped) struct; a pandas UDF fits here. The
    counts (rows, failed, stripped) are filled in by whatever action reads the result.
    """
    counts = Observation()
    made = df.withColumn("_c", (fn or largest_fragment)(F.col(column)))
    made = made.withColumns({"canonical": F.col("_c.canonical"), "stripped": F.col("_c.stripped")})
    seen = made.drop("_c").observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("canonical").isNull()).alias("failed"),
        F.count_if(F.col("stripped")).alias("stripped"),
    )
    return seen.filter(F.col("canonical").isNotNull()), counts


def seeded_subset(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows in seeded hash order; all of them when there are fewer.

    The n-th hash is found first, then the subset is a plain filter: nothing is sorted and no
    task or driver holds the subset. ``key`` must be unique.
    """
    cutoff = hash_cutoff(df.select(hash_order(seed, key).alias("h")), n)
    if cutoff is None:
        return df
    return df.filter(hash_order(seed, key) <= F.lit(cutoff))


def subset_counts(
    df: DataFrame, n: int, seed: int, fn: Callable[[Column], Column] | None, key: str, column: str
) -> DataFrame:
    """Kept, stripped and failed rows of a seeded subset of ``n`` valid keys.

    A failed row counts only if it comes before the n-th valid one in hash order.
    """
    made = df.withColumn("_c", (fn or largest_fragment)(F.col(column))).withColumn(
        "_h", hash_order(seed, key)
    )
    valid = F.col("_c.canonical").isNotNull()
    cutoff = hash_cutoff(made.filter(valid).select(F.col("_h").alias("h")), n)
    inside = made if cutoff is None else made.filter(F.col("_h") <= F.lit(cutoff))
    return inside.agg(
        F.count_if(valid).alias("kept"),
        F.count_if(~valid).alias("failed"),
        F.count_if(F.col("_c.stripped")).alias("stripped"),
    )


def filter_key_length(df: DataFrame, column: str, limit: int = MAX_KEY_LENGTH) -> DataFrame:
    return df.filter(F.length(column) < limit)


def held_out_keys(tests: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys of all held-out sets."""
    keys = tests[0].select(key)
    for t in tests[1:]:
        keys = keys.union(t.select(key))
    return keys.distinct()


def drop_leakage(train: DataFrame, tests: Sequence[DataFrame], key: str) -> DataFrame:
    """Train rows whose key is in no held-out set. Rows without a key cannot leak and stay."""
    return train.join(held_out_keys(tests, key), key, "left_anti")


def harmonize(df: DataFrame, mapping: dict[str, str], required: Sequence[str]) -> DataFrame:
    """Select and rename ``{new: old}``, then drop rows missing a required column."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()]).na.drop(
        how="any", subset=list(required)
    )


def apply_dropna(df: DataFrame, targets: Sequence[str], flag: bool) -> DataFrame:
    """Single-target recipes drop rows without the target; multi-target ones keep sparse rows."""
    return df.na.drop(how="any", subset=list(targets)) if flag else df


def exclude_recipes(df: DataFrame, names: Sequence[str], column: str = "recipe") -> DataFrame:
    """Rows of all other recipes; a name that matches nothing is an error."""
    found = df.filter(F.col(column).isin(*names)).select(column).distinct().collect()
    missing = set(names) - {r[0] for r in found}
    if missing:
        raise ValueError(f"no rows for {', '.join(sorted(missing))}")
    return df.filter(~F.col(column).isin(*names))


def known_flavors(df: DataFrame, registry: DataFrame, column: str = "flavor") -> DataFrame:
    """Rows whose flavor is registered."""
    return df.join(registry.select(F.col("name").alias(column)).distinct(), column, "left_semi")


def wide_targets(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Key and targets, each parsed leniently, as (key, features)."""
    return df.select(key, F.array(*[lenient_double(F.col(f"`{t}`")) for t in targets]).alias("features"))
