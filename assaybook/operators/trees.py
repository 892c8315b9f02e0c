"""Regression trees for many (unit, fold) pairs at once, from histograms.

A unit is a group of rows with its own folds; every fold has a model that is fit on the unit's
other folds and predicts its own. All models of a unit grow together, level by level: one pass over rows fills a
histogram of weights and sums per model, node, feature and bin, and every split of the level
follows from it. Units that fit a slice of rows are grown where their rows are, many of them
in one task. The rows of a larger unit stay spread over the cluster; per level, one grouped
aggregate adds up the histograms of its slices for all models of all such units.

Bootstrap weights and feature choices come from hashes of rows and nodes, so that a task that runs
again does the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

#: Rows of a slice, and rows times models that are worked on at once.
SLICE_ROWS, AT_ONCE = 1 << 17, 1 << 21
#: The usual defaults of forests and boosted trees on Spark.
TREES, DEPTH, BINS, STEP = 20, 5, 32, 0.1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.asarray(x).astype(np.uint64) + _GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(11)).astype(np.float64) / (1 << 53)


#: Chances of drawing a row at most 0, 1, 2, ... times, when as many rows are drawn as there are.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass
class Forest:
    """Complete binary trees as arrays (tree, node); a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def stumps(cls, trees: int, depth: int) -> Forest:
        shape = (trees, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape))

    def node_of(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row in every tree after some levels, leaves reached before included: (tree, row)."""
        tree, row = np.arange(len(self.feature))[:, None], np.arange(len(bins))[None]
        node = np.zeros((len(self.feature), len(bins)), np.int32)
        for _ in range(levels):
            feature = self.feature[tree, node]
            right = bins[row, np.maximum(feature, 0)] > self.cut[tree, node]
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        return node

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[np.arange(len(self.feature))[:, None], self.node_of(bins, depth)]

    def split(self, level: int, best: dict[str, np.ndarray]) -> None:
        """Give the nodes of a level their splits, and their children the means of what goes there."""
        first = (1 << level) - 1
        nodes = first + np.arange(1 << level)
        if level == 0:
            self.value[:, 0] = best["s"][:, 0] / np.maximum(best["n"][:, 0], 1e-300)
        good = best["gain"] > 0
        tree, at = np.nonzero(good)
        self.feature[tree, nodes[at]], self.cut[tree, nodes[at]] = best["feature"][good], best["cut"][good]
        left, right = 2 * nodes[at] + 1, 2 * nodes[at] + 2
        self.value[tree, left] = best["sl"][good] / best["nl"][good]
        self.value[tree, right] = (best["s"][good] - best["sl"][good]) / (best["n"][good] - best["nl"][good])


def histogram(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
    """Weights and weighted sums per tree, node of the level, feature and bin: (tree, node, feature, bin, 2).

    ``target``, ``weight`` and ``node`` are (tree, row).
    """
    trees, nodes = len(weight), 1 << level
    at = node - (nodes - 1)
    tree, row = np.nonzero((at >= 0) & (weight > 0))
    place = (tree * nodes + at[tree, row]) * BINS
    w = weight[tree, row]
    wy = w * target[tree, row]
    out = np.empty((trees, nodes, bins.shape[1], BINS, 2))
    for f in range(bins.shape[1]):
        own = place + bins[row, f]
        for k, held in enumerate((w, wy)):
            out[:, :, f, :, k] = np.bincount(own, weights=held, minlength=trees * nodes * BINS).reshape(trees, nodes, BINS)
    return out


def best_splits(hist: np.ndarray, allowed: np.ndarray) -> dict[str, np.ndarray]:
    """Per tree and node the split that lowers the squared error most, the first of equals: (tree, node) arrays."""
    below = hist.cumsum(axis=3)
    n, s = below[:, :, 0, -1, 0], below[:, :, 0, -1, 1]
    nl, sl = below[..., :-1, 0], below[..., :-1, 1]
    nr, sr = n[..., None, None] - nl, s[..., None, None] - sl
    with np.errstate(all="ignore"):
        whole = np.where(n > 0, s * s / n, 0.0)
        gain = sl * sl / nl + sr * sr / nr - whole[..., None, None]
    # what is left of a node whose targets are all the same is rounding
    usable = (nl > 0) & (nr > 0) & allowed[..., None] & (gain > 1e-12 * np.abs(whole)[..., None, None])
    gain = np.where(usable, gain, 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(axis=2)
    pick = lambda x: np.take_along_axis(x.reshape(*x.shape[:2], -1), at[..., None], axis=2)[..., 0]
    return {"feature": at // (BINS - 1), "cut": at % (BINS - 1), "gain": pick(gain), "nl": pick(nl), "sl": pick(sl), "n": n, "s": s}


class Booster:
    """How the models of a unit are made: a bootstrapped forest, or trees that follow one another."""

    def __init__(self, kind: str, folds: int, features: int, seed: int, trees: int = TREES, depth: int = DEPTH):
        if kind not in ("rf", "gbt"):
            raise ValueError(f"trees are rf or gbt, not {kind!r}")
        self.kind, self.folds, self.features, self.seed, self.trees, self.depth = kind, folds, features, seed, trees, depth

    @property
    def rounds(self) -> list[list[tuple[int, int]]]:
        """(fold, tree) pairs that grow at the same time, in the order of their rounds."""
        every = [[(k, t) for k in range(self.folds)] for t in range(self.trees)]
        return [sum(every, [])] if self.kind == "rf" else every

    def chosen(self, unit: int, pairs: Sequence[tuple[int, int]], level: int) -> np.ndarray:
        """Which features each node of a level may split on: a third of them in a forest."""
        shape = (len(pairs), 1 << level, self.features)
        if self.kind == "gbt":
            return np.ones(shape, bool)
        name = np.array([unit % (1 << 62) + 31 * self.seed + 1_000_003 * k + 7919 * t for k, t in pairs], dtype=np.uint64)
        key = _mix(_mix(name)[:, None] + np.uint64(1 << level) + np.arange(1 << level, dtype=np.uint64)[None])
        draw = _uniform(key[..., None] + np.arange(self.features, dtype=np.uint64) * _GOLDEN)
        return draw.argsort(axis=2).argsort(axis=2) < -(-self.features // 3)

    def weights(self, rows: np.ndarray, fold: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
        """How often each row counts in each tree; a row never counts in the model of its own fold."""
        k, t = (np.array(x)[:, None] for x in zip(*pairs))
        out = (fold[None] != k).astype(np.float64)
        if self.kind == "rf":
            name = _mix(np.uint64(self.seed) + (k * 4096 + t).astype(np.uint64))
            out *= np.searchsorted(_DRAWN, _uniform(rows.astype(np.int64).view(np.uint64)[None] ^ name))
        return out

    def targets(self, bins: np.ndarray, y: np.ndarray, pairs: Sequence[tuple[int, int]], made: list[Forest]) -> np.ndarray:
        """What each tree is fit to: the truth, or twice what the trees before it leave."""
        if not made:
            return np.broadcast_to(y, (len(pairs), len(y)))
        return 2 * (y[None] - self._sum(bins, made))

    def _sum(self, bins: np.ndarray, made: list[Forest]) -> np.ndarray:
        total = made[0].predict(bins, self.depth)
        for forest in made[1:]:
            total = total + STEP * forest.predict(bins, self.depth)
        return total

    def held_out(self, bins: np.ndarray, fold: np.ndarray, made: list[Forest]) -> np.ndarray:
        """Each row's prediction by the model of its own fold."""
        out = np.empty(len(bins))
        for k in range(self.folds):
            own = np.flatnonzero(fold == k)
            if self.kind == "rf":
                mine = [i for i, pair in enumerate(self.rounds[0]) if pair[0] == k]
                part = Forest(*(x[mine] for x in (made[0].feature, made[0].cut, made[0].value)))
                out[own] = part.predict(bins[own], self.depth).mean(axis=0)
            else:
                parts = [Forest(f.feature[k : k + 1], f.cut[k : k + 1], f.value[k : k + 1]) for f in made]
                out[own] = self._sum(bins[own], parts)[0]
        return out

    def grow(self, unit: int, bins: np.ndarray, y: np.ndarray, fold: np.ndarray, rows: np.ndarray) -> list[Forest]:
        """All models of a unit whose rows are all here."""
        made: list[Forest] = []
        for pairs in self.rounds:
            forest = Forest.stumps(len(pairs), self.depth)
            for level in range(self.depth):
                allowed = self.chosen(unit, pairs, level)
                parts = [best_splits(self.level(bins, y, fold, rows, pairs[a:b], made, forest, level, a, b), allowed[a:b])
                         for a, b in self.chunks(len(pairs), len(y))]
                forest.split(level, {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
            made.append(forest)
        return made

    @staticmethod
    def chunks(models: int, rows: int) -> list[tuple[int, int]]:
        step = max(1, AT_ONCE // max(rows, 1))
        return [(a, min(a + step, models)) for a in range(0, models, step)]

    def level(self, bins: np.ndarray, y: np.ndarray, fold: np.ndarray, rows: np.ndarray, pairs: Sequence[tuple[int, int]],
              made: list[Forest], forest: Forest, level: int, a: int, b: int) -> np.ndarray:
        """The histogram of trees a to b of a round at one level, over the rows at hand."""
        part = Forest(forest.feature[a:b], forest.cut[a:b], forest.value[a:b])
        before = [Forest(f.feature[a:b], f.cut[a:b], f.value[a:b]) for f in made]
        return histogram(bins, self.targets(bins, y, pairs, before), self.weights(rows, fold, pairs), part.node_of(bins, level), level)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Bin edges per feature: quantiles of the unit's own values, (feature, edge)."""
    return np.quantile(x, np.arange(1, BINS) / BINS, axis=0, method="inverted_cdf").T


def _binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1).astype(np.int32)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit_hash").to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column("unit_hash")[0].as_py() != unit[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    y, fold, rows = (table.column(c).to_numpy() for c in ("y", "fold", "row_hash"))
    return x, y, fold, rows, table.column("unit_hash")[0].as_py()


def held_out_predictions(folded: DataFrame, unit: Sequence[str], features: Sequence[str], kind: str, seed: int = 0,
                         trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(unit, row_id, meta): every row's prediction by trees fit on its unit's other folds.

    ``folded`` has the unit's columns, ``row_id``, ``fold`` from zero, ``y`` and the features; a missing feature
    counts as zero. ``kind`` is rf or gbt. Features are cut into bins at quantiles of the unit's rows.
    """
    unit = list(unit)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    names = F.struct(*[F.col(u) for u in unit])
    rows = stage(folded.select(
        *unit, "row_id", F.col("fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y"), x.alias("x"),
        F.xxhash64(names).alias("unit_hash"), F.xxhash64(F.lit(seed), names, F.col("row_id")).alias("row_hash")), "trees")
    sizes = stage(rows.groupBy(*unit, "unit_hash").agg(F.count("*").alias("n"), F.max("fold").alias("last")), "sizes")
    total = sizes.agg(F.sum("n"), F.max("last")).first()
    folds = (total[1] or 0) + 1
    booster = Booster(kind, folds, len(features), seed, trees, depth)
    same = lambda a, b: [F.col(f"{a}.{u}").eqNullSafe(F.col(f"{b}.{u}")) for u in unit]
    few = sizes.filter(F.col("n") <= SLICE_ROWS).select(*unit)
    parts = max(1, min(int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // 4096)), -(-(total[0] or 0) // SLICE_ROWS))
    out_schema = T.StructType([*[rows.schema[c] for c in (*unit, "row_id")], T.StructField("meta", T.DoubleType())])
    small = rows.alias("r").join(few.alias("s"), same("r", "s"), "left_semi")

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            values, y, fold, names_, unit_hash = _arrays(table)
            bins = _binned(values, _cuts(values))
            meta = booster.held_out(bins, fold, booster.grow(unit_hash, bins, y, fold, names_))
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in (*unit, "row_id")], pa.array(meta)], names=out_schema.names)

    ordered = small.repartitionByRange(parts, *unit).sortWithinPartitions(*unit, "row_hash")
    out = ordered.mapInArrow(fit, out_schema)
    if (total[0] or 0) <= SLICE_ROWS:
        return out
    many = sizes.filter(F.col("n") > SLICE_ROWS)
    return out.unionByName(_large(rows, many, unit, features, booster, out_schema, same, parts))


def _large(rows: DataFrame, sizes: DataFrame, unit: list[str], features: Sequence[str], booster: Booster, schema: T.StructType, same, parts: int) -> DataFrame:
    """Predictions of units larger than a slice, of which there are no more than slices."""
    spark = rows.sparkSession
    spread = rows.alias("r").join(sizes.select(*unit).alias("s"), same("r", "s"), "left_semi")
    # rows of a unit stand together in a slice, and a unit is cut by the hash of its rows
    large = stage(spread.repartitionByRange(parts, "unit_hash", "row_hash").sortWithinPartitions("unit_hash", "row_hash"), "large")
    probs = [k / BINS for k in range(1, BINS)]
    edges = large.groupBy("unit_hash").agg(*[F.percentile_approx(F.col("x")[j], probs, 20_000).alias(f"c{j}") for j in range(len(features))])
    cuts = {r["unit_hash"]: np.array([r[f"c{j}"] for j in range(len(features))]) for r in edges.collect()}
    if not cuts:
        return spark.createDataFrame([], schema)
    made: dict[int, list[Forest]] = {u: [] for u in cuts}
    for pairs in booster.rounds:
        growing = {u: Forest.stumps(len(pairs), booster.depth) for u in cuts}
        for level in range(booster.depth):
            found = _level(large, booster, pairs, cuts, made, growing, level)
            for u, best in found.items():
                growing[u].split(level, best)
        for u, forest in growing.items():
            made[u].append(forest)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _units([batch]):
                values, _, fold, _, u = _arrays(table)
                meta = booster.held_out(_binned(values, cuts[u]), fold, made[u])
                yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in (*unit, "row_id")], pa.array(meta)], names=schema.names)

    return large.mapInArrow(predict, schema)


def _level(large: DataFrame, booster: Booster, pairs: Sequence[tuple[int, int]], cuts: dict[int, np.ndarray], made: dict[int, list[Forest]],
           growing: dict[int, Forest], level: int) -> dict[int, dict[str, np.ndarray]]:
    """The best splits of one level for all trees of all large units: one scan and one grouped aggregate."""
    shape = (1 << level, booster.features, BINS, 2)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for table in _units([batch]):
                values, y, fold, rows, u = _arrays(table)
                bins = _binned(values, cuts[u])
                held = total.setdefault(u, np.zeros((len(pairs), *shape)))
                for a, b in booster.chunks(len(pairs), len(y)):
                    held[a:b] += booster.level(bins, y, fold, rows, pairs[a:b], made[u], growing[u], level, a, b)
        for u, held in total.items():
            for tree, cells in enumerate(held.reshape(len(pairs), -1, 2)):
                at = np.flatnonzero(cells[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), u, np.int64)), pa.array(np.full(len(at), tree, np.int32)), pa.array(at.astype(np.int32)), pa.array(cells[at, 0]),
                     pa.array(cells[at, 1])], names=["unit_hash", "tree", "cell", "n", "s"])

    cells = large.select("unit_hash", "row_hash", "fold", "y", "x").mapInArrow(fill, "unit_hash long, tree int, cell int, n double, s double")
    added = cells.groupBy("unit_hash", "tree", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    numbers = ("feature", "cut", "gain", "nl", "sl", "n", "s")

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        u, tree = key[0].as_py(), key[1].as_py()
        hist = np.zeros((int(np.prod(shape[:3])), 2))
        at = table.column("cell").to_numpy()
        hist[at, 0], hist[at, 1] = table.column("n").to_numpy(), table.column("s").to_numpy()
        best = best_splits(hist.reshape(1, *shape), booster.chosen(u, [pairs[tree]], level))
        own = {"unit_hash": np.full(shape[0], u, np.int64), "tree": np.full(shape[0], tree, np.int32), "node": np.arange(shape[0], dtype=np.int32)}
        return pa.table(own | {c: best[c][0].astype(np.float64) for c in numbers})

    schema = "unit_hash long, tree int, node int, " + ", ".join(f"{c} double" for c in numbers)
    told = added.groupBy("unit_hash", "tree").applyInArrow(choose, schema).toArrow()
    out: dict[int, dict[str, np.ndarray]] = {}
    u, tree, node = (told[c].to_numpy() for c in ("unit_hash", "tree", "node"))
    for one in np.unique(u):
        own = u == one
        out[int(one)] = {c: np.zeros((len(pairs), shape[0])) for c in numbers}
        for c in numbers:
            out[int(one)][c][tree[own], node[own]] = told[c].to_numpy()[own]
    return out
