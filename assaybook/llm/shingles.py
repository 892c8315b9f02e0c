"""Word shingles of many texts at once, straight from Arrow's buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WORD = np.ones(256, dtype=bool)
_WORD[list(b" \t\n\x0b\x0c\r")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit, another one for each salt."""
    x = (x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts and the offsets of each; a missing text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z lower-cased, and the offsets of each text's words."""
    data, offsets = text_buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    fresh[edges] = inside[edges]                      # words never cross texts
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = np.flatnonzero(inside)
    word = np.cumsum(fresh[letters]) - 1
    place = letters - starts[word]
    powers = np.cumprod(np.full(int(place.max()) + 2, _ODD, dtype=np.uint64))
    value = (_LOWER[data[letters]].astype(np.uint64) + np.uint64(1)) * powers[place]
    first = np.flatnonzero(fresh[letters])
    hashes = mix(np.add.reduceat(value, first))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes, bounds = word_hashes(texts)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        tail = hashes[k:] if k else hashes
        rolled[: len(tail)] = mix(rolled[: len(tail)] * _ODD + tail)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                h = mix(h * _ODD + hashes[k : k + 1])
            out.append(mix(h, 1 + b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
