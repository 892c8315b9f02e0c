"""Mixing sources to target weights by pivotal rounding of fractional copies.

A source's target in words gives each of its documents the same fractional number of copies.
The whole part is certain. The fraction is rounded by the pivotal method: two documents trade
mass, weighted by their words, at random and without changing either's expectation, until one of
them is settled at no or one more copy; the other goes on to the next trade. A cell of a source
so ends with at most one unsettled document, and those meet in the cells of the next level of a
tree until one is left per source. Its source's words miss the target by at most that document.

Cells are dealt by hash and hold about ``LEAF`` documents, so a source with a third of all rows is
only more cells. The draws come from the seed and the cell, in the order of the documents, so a
rerun or a recomputed task settles the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_row_id
from ..session import stage
from .rows import whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a leaf cell holds on average, and cells that meet in one of the next level.
LEAF, FAN_IN = 1024, 64
_CELL = "source string, cell long, doc long, size long, n long, mass long, base long, p double, bit long, settled boolean"


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) for a table (source, size): one row per source.

    Sources by code point, a missing one last, take the weights in turn. ``share`` times all sizes
    are dealt by weight; a target stops at ``most`` times its source's size and the excess is dealt
    again among the others until none is above. Each round is one sum over the sources, so only
    the common rate, a number, comes to the driver. Without any words all targets are zero.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    placed = with_row_id(totals, ["unnamed", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage(placed.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * float(most)
    words, heavy = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, rate, held = share * (words or 0), 0.0, -1
    while words:
        over = cap < F.col("weight") * rate
        full, left, n = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if n == held:
            break
        held = n
        if not left:                     # every source is full
            break
        rate = (budget - full) / left
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * rate).alias("target"))


def _settle(cell: pa.Table, last: bool, seed: int) -> pa.Table:
    """Trade within one cell until at most one document is unsettled; at the root settle that too."""
    cell = cell.sort_by([("doc", "ascending"), ("size", "ascending")])
    p, mass = cell["p"].to_numpy().copy(), cell["mass"].to_numpy().astype(np.float64)
    name = cell["source"][0].as_py()
    words = [seed, cell["cell"][0].as_py(), int(last), len(p), *(() if name is None else name.encode())]
    draws = np.random.default_rng(words).random(len(p) + 1)
    open_ = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up = min(mass[j] * (1 - p[j]), mass[i] * p[i])         # mass that i can give to j
        down = min(mass[j] * p[j], mass[i] * (1 - p[i]))       # and j to i
        moved = up if draws[i] * (up + down) < down else -down
        p[j] += moved / mass[j]
        p[i] -= moved / mass[i]
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        open_ = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    if last and open_ >= 0:
        p[open_] = float(draws[-1] < p[open_])
    settled = (p <= 0.0) | (p >= 1.0)
    made = {"p": pa.array(p), "bit": pa.array(np.where(settled, p, 0).astype(np.int64)), "settled": pa.array(settled)}
    return pa.table([made.get(c, cell[c]) for c in cell.column_names], names=cell.column_names)


def _settler(last: bool, seed: int) -> Callable[[pa.Table], pa.Table]:
    return lambda cell: _settle(cell, last, seed)


def pivotal_copies(units: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(source, doc, size, n, source_size, target, copies) for units (source, doc, size, n).

    ``n`` is how many equal rows a unit stands for; they share its copies. Every unit comes back
    once. Units without words take no part in the trades: their fraction is drawn by hash.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc", "size"), F.lit(1 << 30)) / float(1 << 30)
    counted = units.groupBy("source").agg(F.count("*").alias("units"))
    shares = targets.join(counted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    shares = stage(
        shares.withColumn("fraction", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("cells", F.ceil(F.col("units") / LEAF).cast("long")),
        "shares",
    )
    widest = shares.agg(F.max("cells")).first()[0] or 0
    dealt = units.join(
        shares.select(F.col("source").alias("of"), "fraction", "cells"), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of")
    base = F.floor("fraction").cast("long")
    p = F.col("fraction") - base
    wordless = F.col("size") == 0
    live = dealt.select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), F.lit("cell"), "doc", "size"), F.col("cells")).alias("cell"),
        "doc", "size", "n", (F.col("size") * F.col("n")).alias("mass"), base.alias("base"),
        F.when(wordless, (draw < p).cast("double")).otherwise(p).alias("p"), F.lit(0).cast("long").alias("bit"), F.lit(False).alias("settled"),
    )
    done = []
    while True:
        last = widest <= 1

        level = stage(live.groupBy("source", "cell").applyInArrow(_settler(last, seed), _CELL), "settled")
        done.append(level.filter("settled"))
        if last:
            break
        live = level.filter("NOT settled").withColumn("cell", F.floor(F.col("cell") / FAN_IN).cast("long"))
        widest = -(-widest // FAN_IN)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return (
        out.select("source", "doc", "size", "n", (F.col("base") + F.col("bit")).alias("copies"))
        .join(shares.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    )


def mix_units(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11
) -> DataFrame:
    """The copies every document of the mix gets, as ``pivotal_copies`` returns them.

    Rows that share doc_id, source and size are one unit, so repeated rows get the same number of
    copies each. A missing text has size 0; a missing source is a source of its own, after all
    others; a missing doc_id is an id like any other. No rows: no rows.
    """
    sizes = stage(
        docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc"), word_count(whole_text()).alias("size")),
        "sizes",
    )
    units = stage(sizes.groupBy("source", "doc", "size").agg(F.count("*").alias("n")), "units")
    return pivotal_copies(units, source_targets(sizes, weights, share, most), seed)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as its copies say."""
    copies = mix_units(docs, **settings).filter("copies > 0").select("source", "doc", "size", "copies")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("s"), F.col("doc_id").cast("long").alias("d"), word_count(whole_text()).alias("z"),
    )
    met = whole.join(copies, F.col("s").eqNullSafe(F.col("source")) & F.col("d").eqNullSafe(F.col("doc")) & (F.col("z") == F.col("size")))
    return met.select(F.col("row"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
