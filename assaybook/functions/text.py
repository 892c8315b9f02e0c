"""Text shown in cells and on rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ROW_SEPARATOR
from ..vocabulary import PLAIN, Vocabulary


def _lookup(c: Column, table: dict[str, str]) -> Column:
    if not table:
        return F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, c)


def format_p(p: Column) -> Column:
    """Short p-value text; both tails are bounded rather than rounded."""
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(""))
        .when(p < 0.001, F.lit("p<.001"))
        .when(p > 0.999, F.lit("p>.999"))
        .otherwise(F.format_string("p=%.3f", p))
    )


def mean_text(value: Column, std: Column) -> Column:
    """``0.123`` or, with a spread, ``0.123`` and ``±0.012`` on a second line."""
    bare = F.format_string("%.3f", value)
    return F.when(value.isNull(), F.lit("")).when(std.isNull(), bare).otherwise(
        F.concat(bare, F.lit("\n±"), F.format_string("%.3f", std))
    )


def change_text(delta: Column, p: Column) -> Column:
    """``+12%`` and, when there is one, the p-value on a second line."""
    bare = F.format_string("%+.0f%%", delta)
    return F.when(delta.isNull(), F.lit("")).otherwise(
        F.rtrim(F.regexp_replace(F.concat(bare, F.lit("\n"), format_p(p)), r"\n$", ""))
    )


def display_name(dataset: Column, vocabulary: Vocabulary = PLAIN) -> Column:
    return F.coalesce(_lookup(dataset, vocabulary.dataset_names), dataset)


def _strategy(dataset: Column, vocabulary: Vocabulary) -> Column:
    found = F.coalesce(_lookup(dataset, vocabulary.split_strategies), F.lit(vocabulary.default_strategy))
    return F.concat(F.lit("("), found, F.lit(")"))


def group_label(dataset: Column, vocabulary: Vocabulary = PLAIN) -> Column:
    """Group-box text: name over split strategy; empty where the row label carries both."""
    return F.when(dataset.isin(*vocabulary.inline), F.lit("")).otherwise(
        F.concat(display_name(dataset, vocabulary), F.lit("\n"), _strategy(dataset, vocabulary))
    )


def row_label(row: Column, vocabulary: Vocabulary = PLAIN) -> Column:
    """Readable row label: source dropped, endpoint shortened, recipe suffix kept."""
    at = F.locate(ROW_SEPARATOR, row)
    split = (at > 0) & (F.length(row) >= at + len(ROW_SEPARATOR))
    source = F.when(split, F.substring_index(row, ROW_SEPARATOR, 1)).otherwise(F.lit(""))
    rest = F.when(split, row.substr(at + len(ROW_SEPARATOR), F.length(row))).otherwise(row)
    paren = F.locate(" (", rest)
    name = F.when(paren > 0, F.substring_index(rest, " (", 1)).otherwise(rest)
    suffix = F.when(paren > 0, rest.substr(paren, F.length(rest))).otherwise(F.lit(""))
    short = F.concat(F.coalesce(_lookup(name, vocabulary.endpoint_names), name), suffix)
    plain = F.replace(short, F.lit("_"), F.lit(" "))
    return F.when(
        source.isin(*vocabulary.inline),
        F.concat(display_name(source, vocabulary), F.lit(" "), _strategy(source, vocabulary), F.lit(" "), plain),
    ).otherwise(plain)
