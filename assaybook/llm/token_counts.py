"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens, and a worker encodes only those it has not met yet: all of a batch
at once, as one flat array of symbols with a sequence number each. Every round finds the lowest
merge rank of each sequence, applies that pair wherever it stands in the sequence, and looks up
anew only the pairs that changed. A sequence leaves when no pair of it merges; its surviving
symbols are its count. The merges are a few numpy arrays of fixed size that travel with the task.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches, text_slices, whole_text

#: Fixed value: how the library cuts a text before byte-level merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it starts afresh, and bytes it encodes at once.
REMEMBERED, AT_ONCE = 300_000, 4 << 20
_NEVER = np.int32(np.iinfo(np.int32).max)


@lru_cache(maxsize=1)
def unknown_letters() -> str:
    """Letters and numbers of ``regex`` that the tokenizer library's older Unicode does not know.

    As the body of a character class. Only code points new to this Python's own Unicode are asked
    about, one short string each, so a different version of either package finds its own set.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False, use_regex=True)
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    odd = []
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c) != "Cn":
            continue
        before = "a" if letter.match(c) else "1" if number.match(c) else ""
        if before and len(library.pre_tokenize_str(before + c)) > 1:
            odd.append(code)
    edges = np.flatnonzero(np.diff(odd, prepend=-2) != 1).tolist() + [len(odd)]
    return "".join(f"{chr(odd[a])}-{chr(odd[b - 1])}" for a, b in zip(edges, edges[1:]))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Pairs of symbols with a rank and a product each, in an open-addressing table."""

    def __init__(self, pairs: np.ndarray, products: np.ndarray, bits: int | None = None):
        bits = bits or max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2))))
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, _NEVER, dtype=np.int32)
        self.products = np.zeros(size, dtype=np.int32)
        keys = self._key(pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64))
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & (size - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot], self.products[slot] = key, rank, products[rank]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 32) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or of an empty place where there is no such pair."""
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        slots = self._slot(keys)
        held = self.keys[slots]
        lost = np.flatnonzero((held != keys) & (held != -1))
        while len(lost):
            slots[lost] = (slots[lost] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[lost]]
            lost = lost[(held != keys[lost]) & (held != -1)]
        return slots


class ByteMerges:
    """The merges of a byte-level vocabulary file, ready for arrays of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.letters = np.array([ids[c] for c in byte_letters()], dtype=np.int32)
        self.pairs = PairTable(
            np.array([[ids[a], ids[b]] for a, b in merges], dtype=np.int64),
            np.array([ids[a + b] for a, b in merges], dtype=np.int64),
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.unknown = unknown_letters()

    def survivors(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each byte sequence has when no pair merges any more."""
        out = np.zeros(len(sequences), dtype=np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.letters[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        ranks = np.full(len(symbols), _NEVER, dtype=np.int32)
        made = np.zeros(len(symbols), dtype=np.int32)
        fresh = np.flatnonzero(owner[1:] == owner[:-1])
        while len(symbols):
            slots = self.pairs.find(symbols[fresh], symbols[fresh + 1])
            ranks[fresh], made[fresh] = self.pairs.ranks[slots], self.pairs.products[slots]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == _NEVER
            if over.any():
                out[owner[starts[over]]] = sizes[over]
                stays = np.repeat(~over, sizes)
                symbols, owner, ranks, made = symbols[stays], owner[stays], ranks[stays], made[stays]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # of hits that follow one another (a run of one letter) every second one merges
            begins = np.concatenate(([True], np.diff(hits) != 1))
            run = np.arange(len(hits)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hits = hits[run % 2 == 0]
            symbols[hits] = made[hits]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hits + 1] = False
            at = hits - np.arange(len(hits))          # where the products stand once their right halves are gone
            symbols, owner, ranks, made = symbols[stays], owner[stays], ranks[stays], made[stays]
            ranks[at] = _NEVER
            changed = np.unique(np.concatenate((at - 1, at)))
            changed = changed[(changed >= 0) & (changed < len(symbols) - 1)]
            joined = owner[changed] == owner[changed + 1]
            ranks[changed[~joined]] = _NEVER
            fresh = changed[joined]
        return out


class TokenCounter:
    """Counts tokens of texts; remembers the counts of pre-tokens it has met."""

    def __init__(self, merges: ByteMerges):
        self.merges = merges
        self.known: dict[str, int] = {}
        self.cut = self.cut_rare = regex.compile(PRE_TOKEN)
        self.rare = None
        if merges.unknown:
            self.rare = regex.compile(f"[{merges.unknown}]")
            rare = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{merges.unknown}])")
            for kind in ("L", "N"):
                rare = rare.replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?![{merges.unknown}])\p{{{kind}}})+")
            self.cut_rare = regex.compile(rare)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def __getstate__(self) -> dict:
        return {"merges": self.merges}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["merges"])

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens not met yet, some megabytes of them at a time."""
        batch, size = [], 0
        for token in tokens:
            batch.append(token)
            size += len(token)
            if size >= AT_ONCE:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)

    def _learn(self, tokens: list[str]) -> None:
        found = self.merges.survivors([t.encode("utf-8", "surrogatepass") for t in tokens])
        self.known.update(zip(tokens, found.tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts one, as by the library's default."""
        cut = [self._cut(text) for text in texts]
        fresh = set().union(*[tokens for tokens, _ in cut]).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set().union(*[tokens for tokens, _ in cut])
        self.learn(fresh)
        return [sum(map(self.known.__getitem__, tokens)) + extra for tokens, extra in cut]

    def _cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stand between them."""
        cut = self.cut if text.isascii() or self.rare is None or not self.rare.search(text) else self.cut_rare
        if self.special is None or not self.special.search(text):
            return cut.findall(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in cut.findall(p)], len(parts) - 1


_SIZES = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_sizes(text: Column, merges: ByteMerges) -> Column:
    """A struct (n_bytes, n_tokens) for a text; the memory of pre-tokens lives as long as the task."""
    counter = TokenCounter(merges)

    @F.arrow_udf(_SIZES)
    def sized(texts: pa.Array) -> pa.Array:
        n_bytes, n_tokens = [], []
        for part in text_slices(texts):
            n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in part]
            n_tokens += counter.counts(part)
        return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=_SIZES.names)

    return sized(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, in one narrow pass.

    ``path`` is the vocabulary file, read on the driver. ``row`` is the document's own row. A
    missing or empty text has no bytes and no tokens; repeated rows count alike. No rows: no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = small_batches(docs).select(row, F.col("doc_id"), token_sizes(whole_text(), ByteMerges(path)).alias("s"))
    return sized.select("row", "doc_id", "s.*", (F.col("s.n_tokens") > limit).alias("over_limit"))
