"""Byte-level BPE by a sentencepiece model that is written straight from a file of ranks.

Each byte has a printable letter of its own, so that every entry of the vocabulary is a piece of
letters. A sentencepiece BPE model merges the adjacent pair whose joined piece scores best, the
leftmost of equals; with a piece's score its negative rank, and a normaliser that changes
nothing, that is the order in which ranks merge bytes. The model is a few fields of a
protocol-buffer message, written here without training. A pre-token that is an entry itself is
that entry, as in the rank files' own library; all others go through the model. Decoding maps ids
back to their bytes.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import Remembered, TokenBytes, flat_lists, int_lists, offsets
from .rows import text_slices, whole_text
from .token_counts import byte_letters

#: Fixed values of the sentencepiece model format: field numbers, wire types, kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, VOCAB_SIZE = 3, 4
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
NORMAL, UNKNOWN, BPE = 1, 2, 2
UNKNOWN_PIECE = "⁇"                    # no letter of a byte, so no entry can be it


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def _whole(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _number(field << 3 | 5) + struct.pack("<f", value)


def model_proto(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model with entry k as piece k; the unknown piece comes last."""
    if len(entries) >= 1 << 24:
        raise ValueError("scores hold ranks below 2**24 only")
    letters = byte_letters()
    parts = [
        _bytes(PIECES, _bytes(PIECE, "".join([letters[b] for b in entry]).encode()) + _float(SCORE, -float(rank)) + _whole(KIND, NORMAL))
        for rank, entry in enumerate(entries)
    ]
    parts.append(_bytes(PIECES, _bytes(PIECE, UNKNOWN_PIECE.encode()) + _float(SCORE, 0.0) + _whole(KIND, UNKNOWN)))
    parts.append(_bytes(TRAINER, _whole(MODEL_TYPE, BPE) + _whole(VOCAB_SIZE, len(entries) + 1)))
    plain = _whole(DUMMY_PREFIX, 0) + _whole(EXTRA_SPACES, 0) + _whole(ESCAPE_SPACES, 0)
    parts.append(_bytes(NORMALIZER, _bytes(NAME, b"identity") + plain))
    return b"".join(parts)


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a file with a base64 entry and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=1)
def class_gaps() -> dict[str, str]:
    """Characters that ``regex`` puts in a class and the rank files' library does not, by class.

    As bodies of character classes. The two packages know different versions of Unicode; the
    library is asked by encoding every character with the class itself as its pattern.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    gaps = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        known = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        theirs, ours = set(bytes(known).decode()), set(regex.findall(name, every))
        if theirs - ours:
            raise ValueError(f"{name} of this regex package lacks characters that the library has")
        odd = np.array(sorted(map(ord, ours - theirs)), dtype=np.int64)
        if len(odd):
            firsts = np.flatnonzero(np.diff(odd, prepend=-2) != 1)
            lasts = np.append(firsts[1:], len(odd)) - 1
            gaps[name] = "".join(f"{chr(odd[a])}-{chr(odd[b])}" for a, b in zip(firsts, lasts))
    return gaps


def characters(body: str) -> frozenset[str]:
    """The characters of a class body that is made of ranges only."""
    return frozenset(chr(c) for a, b in zip(body[::3], body[2::3]) for c in range(ord(a), ord(b) + 1))


class ByteCodec(Remembered):
    """Encodes and decodes texts by a file of ranks and the pattern that cuts texts before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, proto: bytes | None = None, gaps: dict[str, str] | None = None):
        super().__init__()
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        if len(set(ranks.values())) != len(ranks) or min(ranks.values()) < 0:
            raise ValueError("two entries share a rank, or one is negative")
        self.ranks, self.pattern = ranks, pattern
        entries = sorted(ranks, key=ranks.get)
        self.id_of = np.array([ranks[e] for e in entries], dtype=np.int32)          # by piece
        self.dense = int(self.id_of[-1]) == len(entries) - 1
        by_id = [b""] * (int(self.id_of[-1]) + 1)
        for entry, rank in ranks.items():
            by_id[rank] = entry
        self.bytes = TokenBytes(by_id)
        self.proto = proto or model_proto(entries)
        self.gaps = class_gaps() if gaps is None else gaps
        self.simple = regex.compile(pattern)
        self.odd = frozenset().union(*map(characters, self.gaps.values()))
        exact = pattern
        for name, body in self.gaps.items():
            exact = exact.replace(name, f"[{name}--[{body}]]")
        self.exact = regex.compile(exact, regex.VERSION1) if self.gaps else self.simple
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.model = None

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern, self.proto, self.gaps

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, as the library's own Unicode cuts them."""
        plain = text.isascii() or self.odd.isdisjoint(text)
        return (self.simple if plain else self.exact).findall(text)

    def encode_parts(self, parts: list[str]) -> list:
        if self.model is None:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        raw = [part.encode("utf-8", "surrogatepass") for part in parts]
        out = [[self.ranks[r]] if r in self.ranks else None for r in raw]
        rest = [k for k, ids in enumerate(out) if ids is None]
        mapped = [raw[k].decode("latin-1").translate(self.letters) for k in rest]
        for k, pieces in zip(rest, self.model.encode(mapped, num_threads=1)):
            out[k] = pieces if self.dense else self.id_of[pieces].tolist()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids; an id that is no entry is an error."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes.width) or not self.bytes.width[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        return self.bytes.join(ids).tobytes()

    def decode_lists(self, ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
        """The bytes of each run of ids."""
        data = self.decode(ids)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets(self.bytes.sizes(ids, counts)).buffers()[1], pa.py_buffer(data)])


_CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def coded(text: Column, codec: ByteCodec) -> Column:
    """A struct (ids, decoded) for a text: its ids, and the bytes decoded from them."""

    @F.arrow_udf(_CODED)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_slices(texts):
            ids, counts = codec.ids(part)
            out.append(pa.StructArray.from_arrays([int_lists(ids, counts), codec.decode_lists(ids, counts)], names=_CODED.names))
        return pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())], names=_CODED.names)

    return run(text)


def decoded(ids: Column, codec: ByteCodec) -> Column:
    """The bytes that an array of ids stands for; a missing array is no bytes."""

    @F.arrow_udf(T.BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        return codec.decode_lists(*flat_lists(lists))

    return run(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(row, doc_id, ids, decoded) for every row of ``docs``, in one narrow pass.

    ``path`` is a file of ranks, read on the driver, ``pattern`` cuts texts into pre-tokens.
    ``row`` is the document's own row, with all its columns; ``decoded`` holds the bytes decoded
    from ``ids``. A missing or empty text has no ids and no bytes; a missing id stays missing;
    repeated rows are coded alike. No rows: no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    codec = ByteCodec(read_ranks(path), pattern)
    return docs.select(row, F.col("doc_id"), coded(whole_text(), codec).alias("c")).select("row", "doc_id", "c.*")
