"""Quality rules: boosted trees over document statistics, with monotonic constraints.

The trees are fitted on the statistics of a bounded sample of labelled rows (``TRAIN_ROWS``, those
with the smallest hashes of their ids) and come down to a few flat numpy arrays, some kilobytes.
Every document is then counted and scored in one narrow pass of Arrow batches: no shuffle, and
nothing but its verdict and a few numbers comes back from Python.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches, text_slices, whole_text

#: Labelled rows a fit reads at most. The bound is a parameter of ``fit_quality``.
TRAIN_ROWS = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_doubled",
)
#: Features of the trees, and how the score may move when one grows: -1 down only, 0 either way.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "words_a_line": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0, "distinct_share": 0, "doubled_share": -1,
}


def _class_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SPACE, _SYMBOL = _class_of(SPACE_BYTES), _class_of(SYMBOLS)
_UPPER, _DIGIT = _class_of(bytes(range(65, 91))), _class_of(bytes(range(48, 58)))
_MARK = _class_of(b".,;:!?'\"()-")
_STARTS = (np.arange(256) & 0xC0) != 0x80          # bytes that begin a code point


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    near = np.zeros(n, dtype=bool)
    near[order[1:][same]] = near[order[:-1][same]] = True
    starts = np.flatnonzero(near)        # equal hashes only name the windows to compare in full
    full = [b" ".join(words[i : i + window]) for i in starts]
    times = Counter(full)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(starts, full):
        if times[w] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def count_text(text: str) -> tuple[int, ...]:
    """The numbers named in ``COUNTS`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                  # bytes.split() cuts at exactly the six ASCII spaces
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(bytes_of[_STARTS].sum())
    lines = raw.split(b"\n")
    worded = [x for x in lines if x.strip()]
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    return (
        len(words), chars - int(bytes_of[_SPACE].sum()), int(bytes_of[_SYMBOL].sum()), len(worded) - len(set(worded)),
        repeated_words(words), len(lines), int(bytes_of[_UPPER].sum()), int(bytes_of[_DIGIT].sum()),
        int(bytes_of[_MARK].sum()), len(set(words)), doubled,
    )


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of many texts, one array each."""
    found = [count_text(t) for part in text_slices(texts) for t in part]
    return dict(zip(COUNTS, np.array(found, dtype=np.int64).reshape(len(found), len(COUNTS)).T))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of features per document from columns of counts."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_words"] / lines, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_marks"] / chars, c["n_distinct"] / words, c["n_doubled"] / words,
    ])


@dataclass
class FlatTrees:
    """Trees as node arrays: a node sends a row left where its feature is at most the threshold.

    Leaves point to themselves, so every row takes the same number of steps.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 64, ridge: float = 5.0, least: int = 20,
) -> FlatTrees:
    """Boosted log-loss trees on binned features.

    A split on a constrained feature is taken only if its children's values are in the allowed
    order, and each child inherits the middle of the two as a bound that its descendants may not
    cross; so the score of a whole tree is monotonic in that feature, not only of one split.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    coded = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = max(len(c) for c in cuts) + 1
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = y - chance, chance * (1 - chance)
        root = new_node()
        roots.append(root)
        open_ = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_:
            node, rows, low, high, level = open_.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            value[node] = float(np.clip(g / (h + ridge), low, high)) * rate
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = coded[rows, j]
                    gl = np.cumsum(np.bincount(b, slope[rows], width))[: len(cut)]
                    hl = np.cumsum(np.bincount(b, bend[rows], width))[: len(cut)]
                    nl = np.cumsum(np.bincount(b, minlength=width))[: len(cut)]
                    vl = np.clip(gl / (hl + ridge), low, high)
                    vr = np.clip((g - gl) / (h - hl + ridge), low, high)
                    gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (g - gl) * vr - 0.5 * (h - hl + ridge) * vr**2
                    barred = (nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)
                    gain = np.where(barred, -np.inf, gain)
                    k = int(np.argmax(gain))
                    if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, vl[k], vr[k])
            if best is None or best[0] <= g * value[node] / rate - 0.5 * (h + ridge) * (value[node] / rate) ** 2 + 1e-9:
                score[rows] += value[node]
                continue
            _, j, k, vl, vr = best
            feature[node], threshold[node] = j, float(cuts[j][k])
            goes_left = coded[rows, j] <= k
            left[node], right[node] = new_node(), new_node()
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            open_ += [(left[node], rows[goes_left], *bounds[0], level + 1), (right[node], rows[~goes_left], *bounds[1], level + 1)]
    arrays = [np.array(a) for a in (feature, threshold, left, right, value, roots)]
    return FlatTrees(*arrays, depth=depth, start=start)


@dataclass
class QualityModel:
    """The trees and the least log-odds that stay; without trees every document stays."""

    trees: FlatTrees | None
    least: float

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), dtype=bool) if self.trees is None else self.trees.score(x) >= self.least


_COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_VERDICT_TYPE = T.StructType([*_COUNTS_TYPE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def document_statistics(text: Column) -> Column:
    """The counts of a text as one struct column."""

    @F.arrow_udf(_COUNTS_TYPE)
    def counted(texts: pa.Array) -> pa.Array:
        columns = counts_of(texts)
        return pa.StructArray.from_arrays([pa.array(columns[c]) for c in COUNTS], names=list(COUNTS))

    return counted(text)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, spare: float = 0.002) -> QualityModel:
    """Fit on the documents of at most ``rows`` labels, those with the smallest hashed ids.

    The cut is even odds, or lower where even odds would cost more than ``spare`` of the sample's
    good documents. Labels that miss an id or a quality are left out; repeated ones and repeated
    documents count each. Fewer than one document of either kind: a model that keeps everything.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("int").alias("y")).dropna()
    chosen = known.orderBy(F.xxhash64("doc"), "doc", "y").limit(rows)          # bounded, so it may be broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("whole")).join(F.broadcast(chosen), "doc")
    sample = (
        found.select("y", document_statistics(F.col("whole")).alias("c"), F.xxhash64("doc").alias("h"), "doc")
        .select("y", "h", "doc", "c.*").orderBy("h", "doc", "y", *COUNTS).limit(rows).select("y", *COUNTS).toArrow()
    )
    y = sample["y"].to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return QualityModel(None, 0.0)
    x = features({c: sample[c].to_numpy() for c in COUNTS})
    trees = fit_trees(x, y, np.array(list(FEATURES.values())))
    return QualityModel(trees, min(0.0, float(np.quantile(trees.score(x)[y == 1], spare))))


def quality_verdict(text: Column, model: QualityModel) -> Column:
    """A struct of the counts, ``base_failed`` and ``kept`` for a text.

    ``base_failed``: fewer than 20 words, or over 30% of them in repeated windows; such documents
    go without asking the trees.
    """

    @F.arrow_udf(_VERDICT_TYPE)
    def judged(texts: pa.Array) -> pa.Array:
        c = counts_of(texts)
        failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        kept = ~failed & model.keeps(features(c))
        return pa.StructArray.from_arrays([*[pa.array(c[n]) for n in COUNTS], pa.array(failed), pa.array(kept)], names=_VERDICT_TYPE.names)

    return judged(text)


def quality_verdicts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, doc_id, the counts, base_failed, kept) for every row of ``docs``, in one narrow pass.

    ``row`` is the document's own row. A missing or empty text has no words and fails. Rows with
    equal texts get equal verdicts. No rows: no rows.
    """
    model = fit_quality(small_batches(docs), labels, rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return (
        docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), quality_verdict(whole_text(), model).alias("v"))
        .select("row", "doc_id", "v.*")
    )


def quality_stage(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return quality_verdicts(docs, labels, rows).filter("kept").select("row.*")
