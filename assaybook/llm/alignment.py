"""Alignment of two tokenizers' tokens by byte offsets, all documents of a batch in lockstep.

Both tokenizers write a text as runs of bytes. Two pointers, one per tokenizer, walk along the
ends of their tokens as in a merge of two sorted lists; where both ends are the same the text is
cut and the two tokens are linked. One numpy vector holds the pointers of every document of a
batch, one step moves them all, and documents that are through leave the vector. A long document
takes several places in it, each for a stretch of its bytes, so a batch takes no more steps
for one very long text.

Texts are encoded word by word, and a word met before is looked up: neither tokenizer merges
across a space that follows no space and precedes no white space.

Tokens end together only if one's bytes are a suffix of the other's, so there are no more linked
id pairs than the two vocabularies have such pairs, whatever the corpus. That bound is computed and
checked, and the counts of pairs go back to the tasks as one sorted array.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .byte_codec import DUMMY_PREFIX, NORMALIZER, ByteCodec, _bytes, _whole
from .piece_codec import MARK
from .ragged import TokenBytes, int_lists, packed, run_sums, unpacked
from .rows import small_batches, text_slices, whole_text
from .token_counts import PRE_TOKEN, byte_letters, unknown_letters

#: Bytes of a document that one place of the state vector walks over.
STRETCH = 512
#: Rows whose lists a task works on at once, and new partial counts it holds before it adds them up.
ROWS, HELD = 256, 1 << 20
#: New words that go through the tokenizers at once, and words a worker remembers before it starts afresh.
WORDS, REMEMBERED = 5000, 200_000


def byte_level_codec(path: str) -> ByteCodec:
    """The encoder of a byte-level vocabulary file; strings of special tokens are ordinary text.

    The file lists its merges. Merging by the ranks of joined bytes gives the same tokens if entries stand
    in order of their merges and every entry comes out of its own bytes: then no two tokens that
    join to an entry can stand side by side unless their merge is listed. Both are checked.
    """
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, own = spec["pre_tokenizer"] or {}, spec["model"]
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the file is no plain byte-level vocabulary")
    ids = own["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]]
    made = [ids[letter] for letter in byte_letters()], [ids[a + b] for a, b in merges]
    entries = list(ids)
    alone = Tokenizer(models.BPE(vocab=ids, merges=merges)).encode_batch(entries, add_special_tokens=False)
    if max(made[0]) >= min(made[1]) or made[1] != sorted(made[1]) or any(e.ids != [ids[t]] for t, e in zip(entries, alone)):
        raise ValueError("the merges of the file are not in the order of its entries")
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {bytes(byte_of[c] for c in entry): i for entry, i in ids.items()}
    gaps = {name: unknown_letters() for name in (r"\p{L}", r"\p{N}")} if unknown_letters() else {}
    return ByteCodec(ranks, PRE_TOKEN, gaps=gaps)


class PieceTokens:
    """Ids of a sentencepiece vocabulary for parts of texts that bring their own space."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        self.proto = proto
        # no space in front by itself: the last word on a field of the message counts
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto + _bytes(NORMALIZER, _whole(DUMMY_PREFIX, 0)))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces must hold the space mark only at their front")
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])

    def __getstate__(self) -> bytes:
        return self.proto

    def __setstate__(self, state: bytes) -> None:
        self.__init__(proto=state)

    def encode_parts(self, parts: list[str]) -> list[Sequence[int]]:
        return self.model.encode(parts, num_threads=1)


class Runs:
    """Runs of ids by number, in one growing array."""

    def __init__(self) -> None:
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def add(self, runs: Iterable[Sequence[int]]) -> None:
        runs = list(runs)
        flat, sizes = array("i", chain.from_iterable(runs)), np.fromiter(map(len, runs), np.int64, len(runs))
        start = int(self.ends[-1])
        if start + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)))
        self.ids[start : start + len(flat)] = flat
        self.ends = np.concatenate((self.ends, start + np.cumsum(sizes)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some runs in a row, and how many each has."""
        start = self.ends[numbers]
        counts = self.ends[numbers + 1] - start
        before = np.cumsum(counts) - counts
        return self.ids[np.arange(int(counts.sum())) + np.repeat(start - before, counts)], counts


#: Where neither tokenizer merges: a space between no space and no white space.
_WORDS = re.compile(r"(?<! ) (?=\S)")


def words(text: str) -> list[str]:
    """A space and the text, cut into parts that each stand for a space and themselves."""
    parts = _WORDS.split(" " + text)
    if parts[0]:
        parts[0] = parts[0][1:]
    else:
        del parts[0]
    return parts


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, doc_ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end where a token of the other does too.

    All offsets count from the start of the batch and grow along it; ``doc_ends`` says where
    documents end. The k-th marked token of A is linked with the k-th marked one of B.
    """
    starts = np.concatenate(([0], doc_ends[:-1]))
    places = -(-(doc_ends - starts) // stretch)              # places of the state vector per document
    nth = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
    begin = np.repeat(starts, places) + nth * stretch
    i, j = np.searchsorted(a_ends, begin, "right"), np.searchsorted(b_ends, begin, "right")
    # a place stops where the next begins, the last one of the batch at the end of all tokens
    i_stop, j_stop = np.append(i[1:], len(a_ends)), np.append(j[1:], len(b_ends))
    cut_a, cut_b = np.zeros(len(a_ends), dtype=bool), np.zeros(len(b_ends), dtype=bool)
    live = (i < i_stop) & (j < j_stop)
    while True:
        if not live.all():
            i, j, i_stop, j_stop = i[live], j[live], i_stop[live], j_stop[live]
        if not len(i):
            return cut_a, cut_b
        end_a, end_b = a_ends[i], b_ends[j]
        both = end_a == end_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        live = (i < i_stop) & (j < j_stop)


class Aligner:
    """Encodes texts by both tokenizers and cuts them where both have a token end."""

    def __init__(self, a: ByteCodec, b: PieceTokens):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.runs = Runs(), Runs()

    def __getstate__(self) -> tuple:
        return self.a, self.b

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B for all texts in a row, and how many each text has."""
        cuts = [words(text) if text else [] for text in texts]
        fresh = set().union(*cuts).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = set().union(*cuts)
        new = list(fresh)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        for k in range(0, len(new), WORDS):
            parts = [" " + word for word in new[k : k + WORDS]]
            tokens = [self.a.cut(part) for part in parts]
            ids, sizes = [], iter(self.a.encode_parts([t for cut in tokens for t in cut]))
            for cut in tokens:
                run: list[int] = []
                for _ in cut:
                    run += next(sizes)
                ids.append(run)
            self.runs[0].add(ids)
            self.runs[1].add(self.b.encode_parts(parts))
        numbers = np.fromiter((self.known[word] for cut in cuts for word in cut), np.int64)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        return [(ids, run_sums(counts, sizes)) for ids, counts in (runs.take(numbers) for runs in self.runs)]

    @property
    def kinds(self) -> tuple[np.dtype, np.dtype]:
        """The number types that hold the ids of A and of B."""
        return tuple(np.dtype(np.uint16 if len(side.bytes.width) <= 1 << 16 else np.uint32) for side in (self.a, self.b))

    def align(self, texts: list[str]) -> list[pa.BinaryArray]:
        """For each text the ids of A and of B, and for each token whether it ends a group, as packed numbers.

        A text that the tokens of A or B do not spell, or an empty one, has none.
        """
        (a_ids, a_counts), (b_ids, b_counts) = self.encode(texts)
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        keep = self._spelled(self.a.bytes, a_ids, a_counts, raw) & self._spelled(self.b.bytes, b_ids, b_counts, raw)
        a_ids, b_ids = a_ids[np.repeat(keep, a_counts)], b_ids[np.repeat(keep, b_counts)]
        a_counts, b_counts = np.where(keep, a_counts, 0), np.where(keep, b_counts, 0)
        doc_ends = np.cumsum(self.a.bytes.sizes(a_ids, a_counts))
        cut_a, cut_b = shared_ends(np.cumsum(self.a.bytes.width[a_ids]), np.cumsum(self.b.bytes.width[b_ids]), doc_ends)
        a_kind, b_kind = self.kinds
        return [packed(a_ids.astype(a_kind), a_counts), packed(b_ids.astype(b_kind), b_counts),
                packed(cut_a.astype(np.uint8), a_counts), packed(cut_b.astype(np.uint8), b_counts)]

    @staticmethod
    def _spelled(table: TokenBytes, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each text join to its bytes."""
        sizes = table.sizes(ids, counts)
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        joined, ends = table.join(ids).tobytes(), np.cumsum(sizes)
        return np.fromiter((n == m and joined[e - n : e] == r for n, m, e, r in zip(sizes.tolist(), want.tolist(), ends.tolist(), raw)), bool, len(raw))


def most_pairs(a: TokenBytes, b: TokenBytes) -> int:
    """How many id pairs there are with one token's bytes a suffix of the other's."""
    def strings(table: TokenBytes) -> Counter:
        whole = table.data.tobytes()
        return Counter(whole[s : s + w] for s, w in zip(table.start.tolist(), table.width.tolist()) if w)

    def suffixes(longer: Counter, shorter: Counter, least: int) -> int:
        return sum(n * shorter.get(t[k:], 0) for t, n in longer.items() for k in range(least, len(t)))

    in_a, in_b = strings(a), strings(b)
    return suffixes(in_a, in_b, 0) + suffixes(in_b, in_a, 1)


@dataclass
class Aligned:
    """Some rows of aligned ids: flat ids and counts per row, and the numbers of tokens in each group."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    groups: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """A number for the linked id pair of every group: the last token of A and of B in it."""
        a, b = self.a[np.cumsum(self.a_sizes) - 1], self.b[np.cumsum(self.b_sizes) - 1]
        return a.astype(np.int64) << 32 | b.astype(np.int64)


def read_aligned(columns: Sequence[pa.BinaryArray], kinds: tuple[np.dtype, np.dtype]) -> Iterator[Aligned]:
    """Packed columns, some rows at a time."""
    for k in range(0, len(columns[0]), ROWS):
        (a, n_a), (b, n_b), (cut_a, _), (cut_b, _) = (unpacked(c.slice(k, ROWS), kind) for c, kind in zip(columns, (*kinds, np.uint8, np.uint8)))
        a_sizes, b_sizes = (np.diff(np.flatnonzero(cut), prepend=-1) for cut in (cut_a, cut_b))
        yield Aligned(a, b, n_a, n_b, a_sizes, b_sizes, run_sums(cut_a, n_a))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Partial counts of pairs as one."""
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(pairs)).astype(np.int64)


def pair_counts(packed_rows: DataFrame, kinds: tuple[np.dtype, np.dtype]) -> DataFrame:
    """(pair, n): the links of every id pair over all rows; tasks add up their own before the shuffle."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for rows in read_aligned(batch.columns, kinds):
                parts.append(np.unique(rows.links, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD:
                    parts, size = [_added(parts)], 0
        pairs, sums = _added(parts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], names=["pair", "n"])

    return packed_rows.select(*_PACKED).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class PairScores:
    """Corpus-wide link counts of id pairs, and whether each is the highest of its B id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]
        b = self.pairs & 0xFFFFFFFF
        top = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
        np.maximum.at(top, b, self.counts)
        self.best = self.counts == top[b]

    def find(self, links: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, links)


class GroupText:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        tails = (("," , n_a), ("|", n_a), (",", n_b), (";", n_b))
        self.parts = [f"{i}{tail}" for tail, n in tails for i in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def write(self, rows: Aligned) -> list[str]:
        before_a, before_b = np.cumsum(rows.a_sizes), np.cumsum(rows.b_sizes)
        codes = np.empty(len(rows.a) + len(rows.b), np.int64)
        last_a, last_b = np.zeros(len(rows.a), np.int64), np.zeros(len(rows.b), np.int64)
        last_a[before_a - 1], last_b[before_b - 1] = 1, 1
        codes[np.arange(len(rows.a)) + np.repeat(before_b - rows.b_sizes, rows.a_sizes)] = rows.a.astype(np.int64) + last_a * self.n_a
        codes[np.arange(len(rows.b)) + np.repeat(before_a, rows.b_sizes)] = rows.b.astype(np.int64) + 2 * self.n_a + last_b * self.n_b
        out, start, flat = [], 0, codes.tolist()
        for n in (rows.n_a + rows.n_b).tolist():
            out.append("".join([self.parts[c] for c in flat[start : start + n]])[:-1])
            start += n
        return out


#: Staged columns: ids of A and B, and for every token one byte that says whether it ends a group.
_PACKED = ("a", "b", "a_cuts", "b_cuts")
_ALIGNED = T.StructType([T.StructField(c, T.BinaryType()) for c in _PACKED])
_LISTS = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a", "b", "a_sizes", "b_sizes")])
_SCORED = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        T.StructField("groups", T.StringType())])


def _struct(parts: list[pa.StructArray], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.StructArray:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, kinds))))


def aligned(text: Column, aligner: Aligner) -> Column:
    """A struct of packed columns for a text."""
    @F.arrow_udf(_ALIGNED)
    def run(texts: pa.Array) -> pa.Array:
        return _struct([pa.StructArray.from_arrays(aligner.align(part), names=_PACKED) for part in text_slices(texts)], _PACKED, [pa.binary()] * 4)

    return run(text)


def lists(kinds: tuple[np.dtype, np.dtype]) -> Column:
    """Ids of both tokenizers, and how many of each are in each group, as arrays."""
    @F.arrow_udf(_LISTS)
    def run(a: pa.Array, b: pa.Array, a_cuts: pa.Array, b_cuts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([int_lists(r.a, r.n_a), int_lists(r.b, r.n_b), int_lists(r.a_sizes, r.groups), int_lists(r.b_sizes, r.groups)],
                                            names=_LISTS.names) for r in read_aligned((a, b, a_cuts, b_cuts), kinds)]
        return _struct(parts, _LISTS.names, [pa.list_(pa.int32())] * 4)

    return run(*_PACKED)


def scored(scores: PairScores, writer: GroupText, kinds: tuple[np.dtype, np.dtype]) -> Column:
    """Numbers of tokens, groups and links, what the links count corpus-wide, and the groups as text."""
    @F.arrow_udf(_SCORED)
    def run(a: pa.Array, b: pa.Array, a_cuts: pa.Array, b_cuts: pa.Array) -> pa.Array:
        parts = []
        for r in read_aligned((a, b, a_cuts, b_cuts), kinds):
            at = scores.find(r.links)
            numbers = [r.n_a, r.n_b, r.groups, r.groups, run_sums(scores.best[at], r.groups), run_sums(scores.counts[at], r.groups)]
            parts.append(pa.StructArray.from_arrays([*[pa.array(n, pa.int64()) for n in numbers], pa.array(writer.write(r), pa.string())], names=_SCORED.names))
        return _struct(parts, _SCORED.names, [pa.int64()] * 6 + [pa.string()])

    return run(*_PACKED)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document, and how usual their links are.

    ``a_path`` is a byte-level vocabulary file that encodes a space and the text, ``b_path`` a
    sentencepiece model, which puts that space in front by itself. The result has doc_id; ``a`` and
    ``b``, the ids; ``a_sizes`` and ``b_sizes``, their numbers in each group; n_a, n_b, n_groups,
    n_links; n_best, the links whose id pair is linked at least as often in all documents as any other
    with its B id; count_sum, the links' counts over all documents; and ``groups`` as text. No
    token is empty, so each group ends with exactly one link.

    A missing or empty text, or one that either tokenizer's tokens do not spell byte by byte, has
    empty lists, zeros and an empty text. Repeated rows count each; a missing id stays missing;
    other columns of ``docs`` are not read. No rows: no rows. The aligned ids are staged once,
    as the counts over all documents come between two passes over them.
    """
    aligner = Aligner(byte_level_codec(a_path), PieceTokens(b_path))
    sides, kinds = (aligner.a.bytes, aligner.b.bytes), aligner.kinds
    staged = stage(small_batches(docs).select("doc_id", aligned(whole_text(), aligner).alias("t")).select("doc_id", "t.*"), "aligned")
    # at most ``most_pairs`` rows, a number that the two vocabularies fix
    bound = most_pairs(*sides)
    counts = stage(pair_counts(staged, kinds), "pairs").limit(bound + 1).toArrow()
    if counts.num_rows > bound:
        raise ValueError(f"more than {bound} linked id pairs: the tokens do not spell the texts")
    scores = PairScores(*(counts[c].to_numpy() for c in ("pair", "n")))
    writer = GroupText(*(len(s.width) for s in sides))
    return staged.select("doc_id", lists(kinds).alias("l"), scored(scores, writer, kinds).alias("s")).select("doc_id", "l.*", "s.*")
