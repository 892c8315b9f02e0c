"""Arrow blocks of a matrix column as 2-D numpy arrays, inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def to_block(column: pa.Array, width: int) -> np.ndarray:
    """List column -> (rows, width) doubles; missing cells and missing rows are NaN.

    A row of another width is an error: reshaping it would move cells between rows.
    """
    sizes = pc.list_value_length(column).drop_null().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"a row has {int(sizes[sizes != width][0])} cells, not {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if column.null_count == 0:
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = flat.reshape(-1, width)
    return out


def from_block(block: np.ndarray) -> pa.Array:
    """(rows, width) doubles -> list column; NaN becomes missing."""
    n, width = block.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(block.ravel(), pa.float64(), from_pandas=True))


@dataclass(frozen=True)
class Shaped:
    """A matrix column seen through a function of its blocks: (rows, read) in, (rows, width) out.

    Reductions apply the function where they read, so that rows go through Python once and not once
    for every step.
    """

    df: DataFrame
    read: int
    width: int
    fn: Callable[[np.ndarray], np.ndarray]
    features: str = "features"


def scan(rows: DataFrame | Shaped, width: int, features: str = "features") -> tuple[DataFrame, Callable[[pa.Array], np.ndarray]]:
    """The column to read, and what makes its Arrow batches blocks of ``width`` columns."""
    if isinstance(rows, Shaped):
        read, fn = rows.read, rows.fn
        return rows.df.select(rows.features), lambda column: fn(to_block(column, read))
    return rows.select(features), lambda column: to_block(column, width)


def map_blocks(
    df: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    width: int,
    features: str = "features",
) -> DataFrame:
    """Replace the features column block by block; a narrow step, other columns pass through."""
    at = df.columns.index(features)
    schema = T.StructType(
        [
            T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == features else f.dataType)
            for f in df.schema.fields
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = from_block(fn(to_block(batch.column(at), width)))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)
