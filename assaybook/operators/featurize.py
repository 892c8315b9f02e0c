"""Featurizing keys: block functions with per-row failure isolation, and built-in featurizers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FEATURE_BLOCK_ROWS
from .blocks import from_block

#: Bytes of the texts whose runs of characters are worked on at once.
SLICE_BYTES = 1 << 20

BlockFunction = Callable[[list[str]], np.ndarray]


class WidthError(ValueError):
    """A block function returned rows of a width other than the declared one."""


def run_block(fn: BlockFunction, keys: list[str], dim: int) -> np.ndarray:
    """One block of keys -> (n, dim); a block that fails is retried key by key.

    Keys that fail alone give a missing row. A wrong width is an error, not a failure.
    """

    def checked(out, n: int) -> np.ndarray:
        out = np.asarray(out, dtype=np.float64)
        if out.shape != (n, dim):
            raise WidthError(f"featurizer returned {out.shape}, expected {(n, dim)}")
        return out

    try:
        return checked(fn(keys), len(keys))
    except WidthError:
        raise
    except Exception:
        rows = np.full((len(keys), dim), np.nan)
        for i, key in enumerate(keys):
            try:
                rows[i] = checked(fn([key]), 1)[0]
            except WidthError:
                raise
            except Exception:
                continue
        return rows


def featurize(
    df: DataFrame, column: str, fn: BlockFunction, dim: int, block_rows: int = FEATURE_BLOCK_ROWS
) -> DataFrame:
    """Append ``features`` computed from ``column`` by a block function; other columns stay."""
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                block = run_block(fn, part.column(at).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, from_block(block)], names=[*part.schema.names, "features"]
                )

    return df.mapInArrow(run, schema)


def coerce_width(df: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """A row of any other width becomes a missing row; ``malformed`` marks it."""
    f = F.col(features)
    right = f.isNotNull() & (F.size(f) == dim)
    missing = F.array_repeat(F.lit(None).cast("double"), dim)
    return df.withColumns(
        {features: F.when(right, f).otherwise(missing), "malformed": ~right}
    )


def concat_blocks(blocks: Sequence[tuple[Column, int]]) -> Column:
    """One vector from sub-blocks of declared sizes; a failed or ragged block is missing cells."""
    parts = []
    for block, size in blocks:
        missing = F.array_repeat(F.lit(None).cast("double"), size)
        parts.append(F.when(block.isNotNull() & (F.size(block) == size), block).otherwise(missing))
    return F.concat(*parts)


def text_descriptors(text: Column) -> Column:
    """Continuous descriptors of a text: sizes, word shape and character class shares."""
    n = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)

    def share(pattern: str) -> Column:
        return F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), n)

    n_words = F.size(words)
    letters = F.reduce(words, F.lit(0), lambda acc, w: acc + F.length(w))
    return F.array(
        n.cast("double"),
        n_words.cast("double"),
        F.try_divide(letters.cast("double"), n_words),
        F.try_divide(F.size(F.array_distinct(words)).cast("double"), n_words),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.split(text, "\n", -1)).cast("double"),
    )


TEXT_DESCRIPTORS = (
    "chars", "words", "mean_word", "distinct_share", "digit_share", "upper_share", "lines",
)


def hashed_bits(text: Column, n_bits: int = 2048, gram: int = 3) -> Column:
    """Binary fingerprint as the sorted positions of its set bits.

    Bit h is set if any run of ``gram`` characters hashes to h; of a shorter text the characters
    count. The hash is the first 32 bits of the md5, which other engines have as well.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def positions(texts: pa.Array) -> pa.Array:
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
        made = [_set_bits([t or "" for t in texts.slice(a, b - a).to_pylist()], n_bits, gram) for a, b in zip(edges, edges[1:])]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    return positions(text.cast("string"))


def _set_bits(texts: list[str], n_bits: int, gram: int) -> pa.Array:
    """The sorted positions of each text's set bits; a run is hashed once, however often it comes."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars, owner, end = "".join(texts), np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths)
    codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
    widths, found = np.where(lengths < gram, 1, gram), [np.zeros(0, np.int64)]
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths[owner] == width) & (np.arange(len(codes)) + width <= end[owner]))
        run = codes[at]
        for k in range(1, width):
            if k > 2:                          # three characters of 21 bits fit in a key
                run = np.unique(run, return_inverse=True)[1]
            run = (run << 21) | codes[at + k]
        _, first, which = np.unique(run, return_index=True, return_inverse=True)
        runs = [chars[i : i + width].encode() for i in at[first].tolist()]
        bit = np.array([int.from_bytes(hashlib.md5(r, usedforsecurity=False).digest()[:4], "big") % n_bits for r in runs], np.int64)
        found.append(owner[at] * n_bits + bit[which])
    bits = np.unique(np.concatenate(found))
    offsets = np.searchsorted(bits, np.arange(len(texts) + 1) * n_bits)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bits % n_bits, pa.int32()))


def dense_bits(positions: Column, n_bits: int = 2048) -> Column:
    """A fingerprint's positions as a row of zeros and ones, for a fit that wants a matrix."""
    every = F.sequence(F.lit(0), F.lit(n_bits - 1))
    # the positions may come from a Python function, which no lambda may hold: they are its argument
    return F.transform(F.array(positions), lambda p: F.transform(every, lambda i: F.array_contains(p, i).cast("double")))[0]
