"""A filter of bounded size that spares a large table's rows a shuffle they would not survive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: Bits for each key, places set for each, and the most bits as a power of two (16 MB).
BITS_A_KEY, PLACES, MOST = 12, 4, 27


def _places(keys: np.ndarray, power: int) -> np.ndarray:
    """(keys, PLACES) bit numbers of each key."""
    wide = keys.astype(np.int64, copy=False).view(np.uint64)
    return np.stack([mix(wide, 50 + k) >> np.uint64(64 - power) for k in range(PLACES)], axis=1).astype(np.int64)


def bloom_filter(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """Bits that every key of a column of longs has set; at most 2 ** MOST of them.

    Beyond that size more of the others pass as well: it costs time, never rows.
    """
    power = int(np.clip(np.ceil(np.log2(max(n, 1) * BITS_A_KEY)), 10, MOST))

    def words(batches):
        for b in batches:
            held = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            at = np.unique(_places(held, power).ravel())
            word, first = np.unique(at >> 5, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (at & 31), first) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    told = keys.select(F.col(key).cast("long")).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 5), dtype=np.uint32)
    out[told["word"].to_numpy()] = told["bits"].to_numpy().astype(np.uint32)
    return out


def may_hold(bits: np.ndarray, key: Column) -> Column:
    """False only for keys that are surely not among the filter's."""
    power = int(np.log2(len(bits))) + 5

    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        at = _places(keys.fill_null(0).to_numpy(zero_copy_only=False), power)
        return pa.array(((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1))

    return held(key)
