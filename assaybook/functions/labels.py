"""Result labels: ``[lr_<mode>__ | <namespace>]<flavor>[__s<seed>][__<mode>]`` as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BASELINE_MODE, HIGHER_IS_BETTER, MODES, SEED_TAG
from ..vocabulary import PLAIN, Vocabulary

_SEEDED = f"(?s)^(.*){SEED_TAG}([0-9]+)$"
_MODE_END = "(?s)^(.*)__(" + "|".join(m for m in MODES if m != BASELINE_MODE) + ")$"


def _match(label: Column, pattern: str, group: int) -> Column:
    return F.when(label.rlike(pattern), F.regexp_extract(label, pattern, group))


def seed_base(label: Column) -> Column:
    return F.coalesce(_match(label, _SEEDED, 1), label)


def seed_number(label: Column) -> Column:
    return _match(label, _SEEDED, 2).try_cast("long")


def seed_label(base: Column, seed: Column) -> Column:
    return F.concat(base, F.lit(SEED_TAG), seed.cast("string"))


def mode_suffix_base(label: Column) -> Column:
    return F.coalesce(_match(label, _MODE_END, 1), label)


def mode_suffix(label: Column) -> Column:
    return F.coalesce(_match(label, _MODE_END, 2), F.lit(BASELINE_MODE))


def mode_label(base: Column, mode: Column) -> Column:
    """Append ``__<mode>``; the baseline mode adds nothing, an unknown one is an error."""
    return (
        F.when(mode == BASELINE_MODE, base)
        .when(mode.isin(*MODES), F.concat(base, F.lit("__"), mode))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode "), mode)).cast("string"))
    )


def _until_mode_end(base: Column) -> Column:
    return F.substring_index(base, "__", 1)


def mode_prefix(label: Column) -> Column:
    """Mode of an ``lr_<mode>__<flavor>`` label (seed tag ignored); bare labels are baseline."""
    base = seed_base(label)
    return F.when(base.startswith("lr_"), F.substring(_until_mode_end(base), 4, 1 << 30)).otherwise(
        F.lit(BASELINE_MODE)
    )


def mode_prefix_flavor(label: Column) -> Column:
    base = seed_base(label)
    rest = base.substr(F.length(_until_mode_end(base)) + 3, F.length(base))
    return F.when(base.startswith("lr_"), rest).otherwise(base)


def strip_prefix(label: Column, prefix: str) -> Column:
    return F.when(
        label.startswith(prefix), F.substring(label, len(prefix) + 1, 1 << 30)
    ).otherwise(label)


def ablation_name(label: Column) -> Column:
    return strip_prefix(seed_base(label), "ablation_")


def dataset_of(recipe: Column, vocabulary: Vocabulary = PLAIN) -> Column:
    """Dataset of a recipe: first prefix of the vocabulary that fits, else the part before the first ``_``."""
    found = F.lit(None).cast("string")
    for prefix, dataset in reversed(vocabulary.prefixes):
        fits = (recipe == prefix) | recipe.startswith(prefix + "_")
        found = F.when(fits, F.lit(dataset)).otherwise(found)
    return F.coalesce(found, F.split_part(recipe, F.lit("_"), F.lit(1)))


def endpoint_of_template(stem: Column, backbone: str) -> Column:
    return strip_prefix(stem, backbone + "_")


def baseline_label(base: str, mode: Column) -> Column:
    """The control arm's label under a protocol: bare for the baseline mode, ``<base>_<mode>`` else."""
    return F.when(mode == BASELINE_MODE, F.lit(base)).otherwise(F.concat(F.lit(base + "_"), mode))


def collapse_seeds(df: DataFrame, column: str = "flavor") -> DataFrame:
    """Replace each label by its base and keep the seed (null when untagged) in ``seed``."""
    return df.withColumns(
        {column: seed_base(F.col(column)), "seed": seed_number(F.col(column))}
    )


def higher_is_better(metric: str) -> bool:
    return metric in HIGHER_IS_BETTER
