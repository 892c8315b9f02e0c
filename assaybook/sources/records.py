"""CSV files by line blocks, with quoted commas, doubled quotes and quoted line feeds.

A block of a file does not know whether it starts inside a quoted field. So a first pass finds, for
every block, where it would end if it started outside, and where if it started inside a quoted field;
one record per block is enough to tell, file by file, how each really starts. The second pass
then cuts every block into records by itself. A record that goes on in later blocks is put together
from its pieces. Both passes take time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

QUOTE, COMMA = '"', ","


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that starts inside one, or outside.

    A quote opens a field only as its first character; two of them inside stand for one.
    """
    at = 0
    if not inside:
        if not line.startswith(QUOTE):
            at = line.find(COMMA + QUOTE) + 1
            if not at:
                return False
        at += 1
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line.startswith(QUOTE, at + 1):
            at += 2
            continue
        at = line.find(COMMA + QUOTE, at + 1) + 2
        if at < 2:
            return False


def fields(record: str) -> list[str]:
    """The fields of a record; white space around a field without quotes does not count."""
    record = record.removesuffix("\r")
    if QUOTE not in record:
        return [f.strip() for f in record.split(COMMA)]
    out, at = [], 0
    while True:
        if not record.startswith(QUOTE, at):
            end = record.find(COMMA, at)
            out.append((record[at:] if end < 0 else record[at:end]).strip())
        else:
            held, at = [], at + 1
            while True:
                end = record.find(QUOTE, at)
                held.append(record[at:] if end < 0 else record[at:end])
                if end < 0 or not record.startswith(QUOTE, end + 1):
                    break
                held.append(QUOTE)
                at = end + 2
            rest = len(record) if end < 0 else end + 1
            end = record.find(COMMA, rest)
            out.append("".join(held) + (record[rest:] if end < 0 else record[rest:end]).strip())
        if end < 0:
            return out
        at = end + 1


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, pa.RecordBatch, int]]:
    """Lines of a batch that belong to one block, which come one after another: path, block, values, batch, row."""
    for batch in batches:
        n, paths, blocks = batch.num_rows, batch.column("path"), batch.column("block")
        if not n:
            continue
        other = pc.or_(pc.not_equal(paths.slice(1), paths.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)))
        edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for start, end in zip(edges, edges[1:]):
            yield paths[start].as_py(), blocks[start].as_py(), batch.column("value").slice(start, end - start), batch, start


def _block_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, whether it ends inside a quoted field if it starts outside, and if it starts inside.

    And whether the record that is open where it starts, if one is, ends in the block.
    """
    now, ends, closed = None, (False, True), False

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([ends[0]]), pa.array([ends[1]]), pa.array([closed])],
                                          names=["path", "block", "outside", "inside", "closed"])

    for path, block, values, _, _ in _runs(batches):
        if now != (path, block):
            if now is not None:
                yield record()
            now, ends, closed = (path, block), (False, True), False
        for line in values.drop_null().to_pylist():
            first = ends_inside(line, ends[0])
            ends = first, first if ends[0] == ends[1] else ends_inside(line, ends[1])
            closed = closed or not ends[1]
    if now is not None:
        yield record()


class _Rows:
    """Records and pieces of records on their way out."""

    SCHEMA = "path string, block long, seq long, cells array<string>, since long, piece string"
    NAMES = ["path", "block", "seq", "cells", "since", "piece"]

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, *row: object) -> None:
        self.rows.append(row)

    @staticmethod
    def whole(path: str, block: int, seq: int, cells: list[list[str]]) -> pa.RecordBatch:
        """Records that stand one after another in a block, the first of them the block's ``seq``-th."""
        n = len(cells)
        columns = [pa.repeat(path, n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(np.arange(seq, seq + n)),
                   pa.array(cells, pa.list_(pa.string())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=_Rows.NAMES)

    def flush(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
        columns = zip(*self.rows)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=self.NAMES)
        self.rows = []
        return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as records; what a block holds of a record that goes beyond it, as pieces."""
    out, now = _Rows(), None
    held: list[str] = []                       # lines of the record that is open
    since = seq = None

    def close_block() -> None:
        if now is not None and since is not None:
            out.add(now[0], now[1], seq if since == now[1] else -1, None, since, "\n".join(held))

    for path, block, values, batch, row in _runs(batches):
        if now != (path, block):
            close_block()
            now, held, seq = (path, block), [], 0
            since = batch.column("since")[row].as_py()
        if since is None and not pc.any(pc.match_substring(values, QUOTE)).as_py():
            cells = [fields(line) for line in values.to_pylist() if line.strip()]
            if cells:
                yield _Rows.whole(path, block, seq, cells)
                seq += len(cells)
            continue
        for line in values.to_pylist():
            if since is None:
                if not line.strip():
                    continue
                if QUOTE not in line or not ends_inside(line, False):
                    out.add(path, block, seq, fields(line), None, None)
                    seq += 1
                else:
                    since, held = block, [line]
                continue
            held.append(line)
            if QUOTE in line and not ends_inside(line, True):
                if since == block:
                    out.add(path, block, seq, fields("\n".join(held)), None, None)
                    seq += 1
                else:
                    out.add(path, block, -1, None, since, "\n".join(held))
                since, held = None, []
        if len(out.rows) >= 1000:
            yield out.flush()
    close_block()
    if out.rows:
        yield out.flush()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fields_of(records: pa.Array) -> pa.Array:
    return pa.array([None if r is None else fields(r) for r in records.to_pylist()], pa.list_(pa.string()))


def csv_records(lines: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """Records (path, block, seq, cells) of text files, and (path) of files that end inside a quoted field.

    Both are read from staged tables. ``lines`` comes straight from a text scan by line feeds; ``path`` names a line's file. ``seq``
    numbers the records that begin in a block from zero, blank lines aside, so that (block, seq) orders a file's records.
    """
    at = [path.alias("path"), F.col("_metadata.file_block_start").alias("block")]
    # lines without a quote leave the state as it is, so only those with one go through Python
    blocks = stage(lines.select(*at, F.contains("value", F.lit(QUOTE)).alias("q")).groupBy("path", "block").agg(F.max("q").alias("q")), "blocks")
    if blocks.filter("q").isEmpty():
        told = lines.select(*at, "value", F.lit(None).cast("long").alias("since"))
        whole = stage(told.mapInArrow(_cut, _Rows.SCHEMA).select("path", "block", "seq", "cells"), "records")
        return whole, blocks.select("path").filter(F.lit(False))
    quoted = lines.select(*at, "value").filter(F.contains("value", F.lit(QUOTE)))
    found = quoted.mapInArrow(_block_ends, "path string, block long, outside boolean, inside boolean, closed boolean")
    ends = blocks.select("path", "block").join(found, ["path", "block"], "left").select(
        "path", "block", F.coalesce("outside", F.lit(False)).alias("outside"), F.coalesce("inside", F.lit(True)).alias("inside"),
        F.coalesce("closed", F.lit(False)).alias("closed"))
    # one record per block: how each starts follows from how those before it end
    ordered = ends.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "outside", "inside", "closed"))).alias("blocks"))
    none = F.lit(None).cast("long")
    known = F.struct(F.array().cast("array<struct<block:bigint,since:bigint>>").alias("starts"), none.alias("since"))

    def step(state: Column, b: Column) -> Column:
        open_ = state["since"].isNotNull()
        here = F.struct(b["block"].alias("block"), state["since"].alias("since"))
        began = F.when(open_ & ~b["closed"], state["since"]).otherwise(b["block"])
        after = F.when(F.when(open_, b["inside"]).otherwise(b["outside"]), began)
        return F.struct(F.concat(state["starts"], F.array(here)).alias("starts"), after.alias("since"))

    chained = stage(ordered.select("path", F.aggregate("blocks", known, step).alias("s")), "chained")
    broken = chained.filter(F.col("s.since").isNotNull()).select("path")
    starts = chained.filter(F.col("s.since").isNull()).select("path", F.inline("s.starts"))
    # a record per block of a file, so a millionth of the data: small enough to be sent to the tasks
    told = lines.select(*at, "value").join(F.broadcast(starts), ["path", "block"])
    cut = stage(told.select("path", "block", "value", "since").mapInArrow(_cut, _Rows.SCHEMA), "records")
    whole = cut.filter(F.col("since").isNull()).select("path", "block", "seq", "cells")
    pieces = cut.filter(F.col("since").isNotNull()).groupBy("path", F.col("since").alias("block")).agg(
        F.max("seq").alias("seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "\n").alias("piece"))
    return whole.unionByName(pieces.select("path", "block", "seq", _fields_of("piece").alias("cells"))), broken
