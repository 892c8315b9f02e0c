"""Line dedup: a line that several documents share stays in the first of them only.

DataFrame functions throughout. Lines are exploded and reduced to 128-bit hashes of their
normalised keys, so neither shuffle of lines carries text. The count of documents per hash
combines before its shuffle, and the join that brings it back is an ordinary sort-merge join
whose hot hashes Spark can split. The texts move once, to meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import SPACES, ascii_lower, text_key, whole_text, with_text


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Positions of the lines that go: (doc, k1, k2, gone), one row per document that loses any.

    ``k1, k2`` stand for the text, so that rows sharing a doc_id keep their own positions. Rows
    sharing a doc_id are one document for the count; a missing doc_id is one document after all
    others. ``gone`` are the positions of lines whose key has at least ``min_chars`` code points,
    is found in at least ``min_docs`` documents, and has a smaller holder.
    """
    text = whole_text()
    k1, k2 = text_key(text)
    lines = (
        docs.select(F.col("doc_id").alias("doc"), k1.alias("k1"), k2.alias("k2"), F.posexplode(_lines(text)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select("doc", "k1", "k2", "pos", *[h.alias(n) for h, n in zip(text_key(F.col("key")), ("h1", "h2"))])
    )
    if min_docs == 2:                    # more than one document: the smallest is not the largest
        held = lines.groupBy("h1", "h2").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("unnamed")
        )
        shared = held.filter((F.col("first") != F.col("last")) | (F.col("first").isNotNull() & F.col("unnamed")))
    else:                                # one row per (key, document) first, so hot keys combine in parallel
        once = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        held = once.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("one").alias("n"))
        shared = held.filter(F.col("n") >= max(min_docs, 2))
    return (
        lines.join(shared.select("h1", "h2", "first"), ["h1", "h2"])
        .filter(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("doc", "k1", "k2").agg(F.collect_set("pos").alias("gone"))
    )


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(row, doc_id, n_lines, n_dropped, kept): every document with the lines that stay.

    ``row`` is the document's own row, whatever its columns are called; ``kept`` its text without
    the lines of ``repeated_lines``, joined by line feeds. A missing or empty text is one empty
    line and stays. Repeated rows stay and each lose the same lines. No rows: no rows.
    """
    text = whole_text()
    k1, k2 = text_key(text)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("doc"), text.alias("whole"), k1.alias("k1"), k2.alias("k2"),
    )
    gone = repeated_lines(docs, min_docs, min_chars).withColumnRenamed("doc", "of").withColumnRenamed("k1", "g1").withColumnRenamed("k2", "g2")
    met = whole.join(
        gone, whole.doc.eqNullSafe(gone.of) & (whole.k1 == gone.g1) & (whole.k2 == gone.g2), "left"
    )
    lines = _lines(F.col("whole"))
    # array_except hashes its second argument, so long documents stay linear; an empty sequence has no SQL form
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return (
        met.withColumn("lines", lines)
        .select(
            "row", F.col("doc").alias("doc_id"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            kept.alias("kept"),
        )
    )


def line_dedup_stage(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """The documents, their columns unchanged, with the repeated lines out of their texts."""
    return drop_repeated_lines(docs, min_docs, min_chars).select(*with_text(docs, F.col("kept")))
