"""Shared row handling: documents keep their own columns nested, so that no name can clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(name: str = "text") -> Column:
    """The text of a document; a missing one is empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def text_key(column: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with different seeds."""
    return [F.xxhash64(column), F.xxhash64(F.lit(7), column)]


def with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` with the text replaced and, where there is one, its length."""
    replaced = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return [replaced.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns]


#: Documents of an Arrow batch, where the session has Spark's default of ten thousand.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session hold fewer, as a row is a whole text."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return docs


def text_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """An Arrow array of texts in lists of about ``size`` bytes, so that few are Python strings at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
    for start, end in zip(edges, edges[1:]):
        yield texts.slice(start, end - start).to_pylist()
