"""Token ids of texts as ragged numpy arrays, and the bytes that ids stand for."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

#: Parts of texts a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Ids whose bytes are put together at once.
AT_ONCE = 1 << 18


class TokenBytes:
    """The bytes of every id, as one flat array."""

    def __init__(self, strings: Sequence[bytes]):
        self.width = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.width) - self.width
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids, one after another."""
        parts = [self._join(ids[k : k + AT_ONCE]) for k in range(0, len(ids), AT_ONCE)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])

    def _join(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        before = np.cumsum(width) - width
        return self.data[np.arange(int(width.sum())) + np.repeat(self.start[ids] - before, width)]

    def sizes(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bytes of each run, where run k holds ``counts[k]`` of the ids."""
        return run_sums(self.width[ids], counts)


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of values; an empty run has zero."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def int_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets(counts), pa.array(values, pa.int32()))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has; a missing list is empty."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts


def packed(values: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Runs of numbers as the bytes of each run."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets(counts * values.itemsize).buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from the bytes of each run, and how many each run has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind) if values.flags.aligned and ends[0] % np.dtype(kind).itemsize == 0 else np.frombuffer(values.tobytes(), kind), np.diff(ends) // np.dtype(kind).itemsize


class Remembered:
    """Encodes texts part by part; the ids of a part met before are looked up.

    A subclass says how a text falls into parts that never merge (``cut``) and what the ids of
    new parts are (``encode_parts``).
    """

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_parts(self, parts: list[str]) -> Iterable[Sequence[int]]:
        raise NotImplementedError

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        cuts = [self.cut(text) for text in texts]
        fresh = set().union(*cuts).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set().union(*cuts)
        parts = list(fresh)
        for part, ids in zip(parts, self.encode_parts(parts)):
            self.known[part] = array('i', ids).tobytes()
        runs = [b"".join([self.known[part] for part in cut]) for cut in cuts]
        counts = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        return np.frombuffer(b"".join(runs), np.int32), counts
