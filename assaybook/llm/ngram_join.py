"""N-gram Jaccard join: links between documents whose shingle sets overlap enough, and their groups.

1. One pass over the texts reduces each document to the size of its shingle set, a 128-bit key of
   the set, and signatures. Documents with equal sets are one class from here on.
2. Signatures are an exact filter. Shingles are dealt by hash into parts, more of them than sets
   that link can differ in, so at least two parts that hold anything hold the same in both; the
   hash of a part is a signature. Sizes are banded, and a set near the top of a band takes the next
   band's parts as well, so any two sizes that may link share a band. Classes that share a
   signature with no other, or only one, link with nothing and are left out.
3. The rest falls into families that signatures connect. Inside a family the document by n-gram
   incidence matrix is multiplied with its transpose, block by block: blocks of at most ``BLOCK``
   classes, only those whose sizes may link, overlap counts accumulated over column strips, pairs
   below the bound that their sizes give discarded. Of each block product only its links' star
   edges and counts leave. Families are not capped; a large one is only more blocks.
4. Links are joined into components by distributed star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .bloom import bloom_filter, may_hold
from .components import components
from .rows import small_batches, text_key, whole_text
from .shingles import mix, shingle_sets

#: Classes of a block, of a bundle of small families, and columns of a strip.
BLOCK, BUNDLE, STRIP = 512, 2048, 4096
#: Sets that a task remembers to have met, before it starts afresh.
SEEN = 200_000
#: Equal parts that a link is sure to have at least, and the low bits that name a signature's band.
EQUAL_PARTS = 2
_BAND_BITS = np.uint64(7)


def size_bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Where the bands of set sizes begin; below the first, only equal sets link."""
    bands = [-(-percent // (100 - percent))]
    while bands[-1] < top:
        bands.append(max(bands[-1] + 1, bands[-1] * 3 // 2))
    return np.array(bands, dtype=np.int64)


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    return tuple(int(mix(values, salt).sum(dtype=np.uint64).view(np.int64)) for salt in (3, 4))


def signatures(values: np.ndarray, percent: int, bands: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """The signatures of one set: the hashes of its parts, in its band and those above that it reaches.

    A set of n shingles differs from one it links with in at most n (100 - percent) / percent of
    them, whichever of the two is larger. That many of its parts at most can differ, so of the
    parts that hold anything all the others are equal. A set with too few such parts to be sure of
    ``EQUAL_PARTS`` has its empty ones count as well, and meets the other sets of that kind there.
    Also returned: by band, how many signatures any set that links shares with this one at least.
    The low bits of a signature are its band.
    """
    n = len(values)
    band = int(np.searchsorted(bands, n, "right")) - 1
    if band < 0:
        return np.zeros(0, dtype=np.int64), {}
    out, sure, last = [], {}, band
    most = n * (100 - percent) // percent
    while 100 * n >= percent * int(bands[last + 1]):           # sets that begin there may still link with this one
        last += 1
    for k in range(band, last + 1):
        parts = (int(bands[k + 1]) - 1) * (100 - percent) // percent * 9 // 8 + 3 * EQUAL_PARTS
        dealt = ((mix(values, 100 + k) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], np.diff(dealt[order]) != 0)))
        held = dealt[order][begins]
        inside = np.add.reduceat(mix(values[order], 7), begins)
        if len(held) - most < EQUAL_PARTS:
            full = np.zeros(parts, dtype=np.uint64)
            full[held] = inside
            held, inside = np.arange(parts), full
            sure[k] = EQUAL_PARTS        # the other set may leave its empty parts out
        else:
            sure[k] = len(held) - most
        hashes = mix(inside ^ mix(held.astype(np.uint64), 1000 + k))
        out.append(hashes >> _BAND_BITS << _BAND_BITS | np.uint64(k))
    return np.concatenate(out).view(np.int64), sure


def _pieces(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text."""
    ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop


def _sketcher(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to (doc, t1, t2, n, k1, k2, parts, sure); of equal sets that a task has met only the first has its signatures."""
    bands = size_bands(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for b in batches:
            if len(seen) > SEEN:
                seen = set()
            for start, stop in _pieces(b["whole"]):
                sizes, first, second, parts, sure = [], [], [], [], []
                for values in shingle_sets(b["whole"].slice(start, stop - start), words):
                    key = set_key(values)
                    sizes.append(len(values)), first.append(key[0]), second.append(key[1])
                    told = (None, {}) if (len(values), *key) in seen else signatures(values, percent, bands)
                    parts.append(told[0]), sure.append([{"band": k, "least": n} for k, n in told[1].items()])
                    seen.add((len(values), *key))
                yield pa.RecordBatch.from_arrays(
                    [*[b[c].slice(start, stop - start) for c in ("doc", "t1", "t2")], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                     pa.array(parts, pa.list_(pa.int64())), pa.array(sure, pa.list_(pa.struct([("band", pa.int32()), ("least", pa.int32())])))],
                    names=["doc", "t1", "t2", "n", "k1", "k2", "parts", "sure"],
                )

    return sketch


def _refetcher(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Representatives' texts to their sets, as bytes, each once a task; rows whose text is another one are dropped."""

    def refetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for b in batches:
            if len(seen) > SEEN:
                seen = set()
            # rows without an id may repeat a representative's text
            new = []
            for k in zip(*[b[c].to_pylist() for c in ("n", "k1", "k2")]):
                new.append(k not in seen), seen.add(k)
            b = b.filter(pa.array(new, pa.bool_()))
            for start, stop in _pieces(b["whole"]):
                part = b.slice(start, stop - start)
                sets = shingle_sets(part["whole"], words)
                keys = zip(part["n"].to_pylist(), part["k1"].to_pylist(), part["k2"].to_pylist())
                right = [(len(v), *set_key(v)) == k for v, k in zip(sets, keys)]
                held = pa.array([v.tobytes() for v in sets], pa.binary())
                names = ["k1", "n", "family", "blocks"]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], held], names=[*names, "held"]).filter(pa.array(right, pa.bool_()))

    return refetch


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two lists of sets: the product of their incidence matrices, strip by strip."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        sides.append((np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)))
    shared = np.intersect1d(*[np.unique(values) for values, _ in sides], assume_unique=True)
    placed = []
    for values, rows in sides:
        column = np.searchsorted(shared, values)
        known = column < len(shared)
        known[known] = shared[column[known]] == values[known]
        order = np.argsort(column[known], kind="stable")
        placed.append((column[known][order], rows[known][order]))
    for start in range(0, len(shared), STRIP):
        strips = []
        for (column, rows), sets in zip(placed, (left, right)):
            a, b = np.searchsorted(column, (start, start + STRIP))
            strip = np.zeros((len(sets), min(STRIP, len(shared) - start)), dtype=np.float32)
            strip[rows[a:b], column[a:b] - start] = 1
            strips.append(strip)
        counts += strips[0] @ strips[1].T
    return counts


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    both = np.fromiter(map(len, left), np.int64, len(left))[:, None] + np.fromiter(map(len, right), np.int64, len(right))[None]
    common = overlaps(left, right).astype(np.int64)
    return 100 * common >= percent * (both - common)


def _multiply(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Block products of one group of rows: star edges of the links, and links of each class."""

    def multiply(rows: pa.Table) -> pa.Table:
        ids, family, side = rows["k1"].to_numpy(), rows["family"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["held"].to_pylist()]
        nodes, roots, counts = [], [], []
        order = np.lexsort((ids, side, family))
        # a representative's row that stands twice in the table is one class
        again = (np.diff(family[order]) == 0) & (np.diff(side[order]) == 0) & (np.diff(ids[order]) == 0)
        order = order[np.concatenate(([True], ~again))]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(family[order]) != 0, [True])))
        for a, b in zip(edges, edges[1:]):
            own = order[a:b]
            first, second = own[side[own] != 1], own[side[own] != 0]       # side 2 stands on both
            link = _linked([sets[i] for i in first], [sets[i] for i in second], percent)
            if (side[own] == 2).all():
                np.fill_diagonal(link, False)
                near, group = link, own
            else:
                group = np.concatenate((first, second))
                near = np.zeros((len(group), len(group)), dtype=bool)
                near[: len(first), len(first) :] = link
                near |= near.T
            label = np.arange(len(group))
            while True:
                least = np.minimum(label, np.where(near, label[None], len(group)).min(axis=1, initial=len(group)))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            touched = np.flatnonzero(near.any(1))
            nodes.append(ids[group[touched]]), roots.append(ids[group[label[touched]]]), counts.append(near.sum(1)[touched])
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pa.table({"a": join(nodes), "b": join(roots), "links": join(counts)})

    return multiply


def _size_bucket(n: Column, percent: int) -> Column:
    """Buckets of sizes such that sizes that may link lie in one bucket or in neighbours."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return F.expr("0") + F.array_size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= n))


def _blocks(classes: DataFrame, percent: int) -> DataFrame:
    """Adds ``blocks``: the block products a class takes part in, as (key, side).

    Families of up to ``BLOCK`` classes are one product each, many of them to a bundle. Of larger
    ones, each bucket of sizes is dealt into cells of about ``BLOCK`` classes, and every two cells
    of a bucket or of neighbouring buckets meet once.
    """
    totals = classes.groupBy("family").agg(F.count("*").alias("members"))
    sized = classes.join(totals, "family").withColumn("large", F.col("members") > BLOCK)
    small = sized.filter("NOT large")
    n_bundles = max(1, -(-small.count() // BUNDLE))
    bundle = F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(n_bundles)).cast("string"))
    small = small.withColumn("blocks", F.array(F.struct(bundle.alias("key"), F.lit(2).alias("side"))))
    large = sized.filter("large").withColumn("bucket", _size_bucket(F.col("n"), percent))
    cells = large.groupBy("family", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    above = cells.select("family", (F.col("bucket") - 1).alias("bucket"), F.col("cells").alias("above"))
    below = cells.select("family", (F.col("bucket") + 1).alias("bucket"), F.col("cells").alias("below"))
    large = large.join(cells, ["family", "bucket"]).join(above, ["family", "bucket"], "left").join(below, ["family", "bucket"], "left")
    cell = F.pmod(F.xxhash64("k1"), F.col("cells")).cast("int")
    key = lambda b1, i, b2, j: F.concat_ws(":", F.lit("l"), F.col("family").cast("string"), b1.cast("string"), i.cast("string"), b2.cast("string"), j.cast("string"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda i: i < F.coalesce(n, F.lit(0)))
    here, up, down = F.col("bucket"), F.col("bucket") + 1, F.col("bucket") - 1
    inside = F.transform(upto(F.col("cells")), lambda j: F.struct(
        key(here, F.least(j, F.col("cell")), here, F.greatest(j, F.col("cell"))).alias("key"),
        F.when(j == F.col("cell"), 2).when(F.col("cell") < j, 0).otherwise(1).alias("side"),
    ))
    with_above = F.transform(upto(F.col("above")), lambda j: F.struct(key(here, F.col("cell"), up, j).alias("key"), F.lit(0).alias("side")))
    with_below = F.transform(upto(F.col("below")), lambda j: F.struct(key(down, j, here, F.col("cell")).alias("key"), F.lit(1).alias("side")))
    large = large.withColumn("cell", cell).withColumn("blocks", F.concat(inside, with_above, with_below))
    keep = ["k1", "k2", "n", "doc", "t1", "t2", "family", "blocks"]
    return small.select(*keep).unionByName(large.select(*keep))


def _in_company(parts: DataFrame) -> DataFrame:
    """Rows (part, k1) whose part several classes have, each once.

    Neighbours in the order of classes tell, so no signature's classes are held together.
    """
    by_part = Window.partitionBy("part").orderBy("k1")
    beside = parts.select(
        "part", "k1", F.first("k1").over(by_part).alias("lead"), F.lag("k1").over(by_part).alias("before"), F.lead("k1").over(by_part).alias("after")
    )
    # of a class that stands there several times the last row is in company if it is not the first class, or another follows
    last = ~F.col("after").eqNullSafe(F.col("k1"))
    return beside.filter(last & ((F.col("lead") != F.col("k1")) | F.col("after").isNotNull())).select("part", "k1")


def _enough(parts: DataFrame, sure: DataFrame) -> DataFrame:
    """Rows of classes that have at least as many parts in company, in a band, as a link is sure to."""
    band = F.col("part").bitwiseAND(F.lit((1 << int(_BAND_BITS)) - 1)).cast("int")
    rows = parts.withColumn("band", band)
    often = rows.groupBy("k1", "band").agg(F.count("*").alias("times")).join(sure, ["k1", "band"]).filter("times >= least")
    return rows.join(often.select("k1", "band"), ["k1", "band"], "left_semi").select("part", "k1")


def ngram_groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc, t1, t2, n_shingles, component_id, n_links), one row for every row of ``docs``.

    Two documents link when their sets of ``words``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100. ``component_id`` is the smallest doc_id that links reach, the own one
    included; ``n_links`` the number of other distinct sets the document's set links with. A
    document with fewer words is one shingle; one without words has none and links with nothing.
    Equal texts link. Rows that share a doc_id are judged each by its own text; a missing doc_id
    is never the smallest unless a group has no other. ``t1, t2`` stand for the row's text. No
    rows: no rows.
    """
    return _groups(docs, words, percent).drop("root")


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``ngram_groups`` with ``root``, which every component has of its own even where no row has an id; NULL without words."""
    t1, t2 = text_key(whole_text())
    read = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), t1.alias("t1"), t2.alias("t2"), whole_text().alias("whole"))
    sketch = stage(read.mapInArrow(_sketcher(words, percent), "doc long, t1 long, t2 long, n long, k1 long, k2 long, parts array<bigint>, sure array<struct<band:int,least:int>>"), "sketch")
    shared = sketch.filter("parts IS NOT NULL").select("k1", F.explode("parts").alias("part"))
    sure = sketch.filter("parts IS NOT NULL").select("k1", F.explode("sure").alias("s")).groupBy("k1", "s.band").agg(F.max("s.least").alias("least"))
    # what does not share enough in a band with all others together cannot do so with one of them
    for _ in range(2):
        shared = stage(_enough(stage(_in_company(shared), "shared-parts"), sure), "shared-parts")
    by_part = Window.partitionBy("part").orderBy("k1")
    edges = shared.select("k1", F.first("k1").over(by_part).alias("lead")).select(F.col("k1").alias("a"), F.col("lead").alias("b")).filter("a <> b").distinct()
    families = stage(components(edges, "families").select(F.col("node").alias("k1"), F.col("root").alias("family")), "families")
    whose = sketch.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "t1", "t2")).alias("x"))
    whose = whose.select("n", "k1", "k2", "x.doc", "x.t1", "x.t2")
    candidates = stage(_blocks(whose.join(families, "k1"), percent), "candidates")
    # few texts are candidates' ones: the others need not travel to find that out
    key = F.coalesce("doc", "t1")        # a class may have no id, but always has a text
    wanted = bloom_filter(candidates.select(key.alias("key")), "key", candidates.count())
    told = candidates.select(F.col("doc").alias("d"), F.col("t1").alias("c1"), F.col("t2").alias("c2"), "n", "k1", "k2", "family", "blocks")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    texts = read.filter(may_hold(wanted, key)).join(told, same).select("whole", "n", "k1", "k2", "family", "blocks")
    sets = texts.mapInArrow(_refetcher(words), "k1 long, n long, family long, blocks array<struct<key:string,side:int>>, held binary")
    dealt = sets.select("k1", "family", "held", F.explode("blocks").alias("block")).select("k1", "family", "held", "block.*")
    products = stage(dealt.groupBy("key").applyInArrow(_multiply(percent), "a long, b long, links long"), "links")
    linked = components(products.select("a", "b"), "linked").select(F.col("node").alias("k1"), "root")
    degrees = products.groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("n_links"))
    classes = stage(
        whose.join(linked, "k1", "left").join(degrees, "k1", "left")
        .select("n", "k1", "k2", "doc", F.coalesce("root", "k1").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "classes",
    )
    # a component is named by its smallest document; a set nothing links with, by its own key alone
    named = classes.groupBy("root").agg(F.min("doc").alias("component_id"))
    told = classes.join(named, "root").select("n", "k1", "k2", "root", "component_id", "n_links")
    out = sketch.select("doc", "t1", "t2", "n", "k1", "k2").join(told, ["n", "k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc", "t1", "t2", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), "root",
    )


def near_duplicate_stage(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest doc_id.

    Of rows that share that id, the one whose text hashes lowest stays, and of equal rows one.
    Documents without words stay, equal rows once.
    """
    groups = stage(_groups(docs, words, percent), "groups")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "t1", "t2")
    # a component without any id has no name: its root tells it from the others of that kind
    worded = groups.filter("n_shingles > 0").withColumn("place", place).select(
        "doc", "t1", "t2", "place", F.coalesce("component_id", "root").alias("group"), F.col("component_id").isNotNull().alias("named")
    )
    first = worded.groupBy("group", "named").agg(F.min("place").alias("first"), F.max("place").alias("final")).filter("first <> final")
    gone = worded.join(first.select("group", "named", "first"), ["group", "named"]).filter("place <> first")
    gone = gone.select(F.col("doc").alias("g"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).distinct()
    t1, t2 = text_key(whole_text())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(row, F.col("doc_id").cast("long").alias("d"), t1.alias("t1"), t2.alias("t2"))
    met = F.col("d").eqNullSafe(F.col("g")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
    left = whole.join(gone, met, "left_anti")
    once = Window.partitionBy("d", "t1", "t2").orderBy("t1")
    return left.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("row.*")
