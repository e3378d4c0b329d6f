"""Texts cut into parts, of which every distinct one is encoded once per worker.

Parts are cut on the bytes of an Arrow column with numpy; Arrow's dictionary finds the
distinct ones of a slice of texts; their encodings come from a pool of bounded size, or are
made by the given function and added to it; the results of whole texts are assembled from
the pool by offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

POOL_PARTS = 500_000         # parts kept by a worker; all are dropped when they are more,
POOL_VALUES = 16 << 20       # or when their values in a column are
POOL_PART_BYTES = 64         # longer parts are kept for the current slice only


class _Column:
    """Values of all parts in one flat array, with the offsets of each part."""

    def __init__(self, dtype):
        self.flat, self.offsets, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, lengths: np.ndarray, values: np.ndarray) -> None:
        end, n = int(self.offsets[self.n]), self.n
        self.flat = _room(self.flat, end + values.size)
        self.offsets = _room(self.offsets, n + 1 + lengths.size)
        self.flat[end:end + values.size] = values
        self.offsets[n + 1:n + 1 + lengths.size] = end + np.cumsum(lengths)
        self.n = n + lengths.size

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the parts ``at``, one after the other, and the length of each."""
        start = self.offsets[at]
        lengths = self.offsets[at + 1] - start
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ends.size else 0
        return self.flat[np.repeat(start - ends + lengths, lengths) + np.arange(total)], lengths


def _room(a: np.ndarray, size: int) -> np.ndarray:
    if size <= a.size:
        return a
    out = np.zeros(max(size, 2 * a.size), a.dtype)
    out[:a.size] = a
    return out


class PartPool:
    """``encode``: parts to one list of value sequences (bytes for uint8) for each of ``dtypes``."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence]], dtypes: Sequence):
        self.encode, self.dtypes = encode, tuple(dtypes)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.columns = [_Column(d) for d in self.dtypes]

    def places(self, parts: pa.Array) -> np.ndarray:
        """The place of each part in the columns of the pool; valid until the next call."""
        if self.columns[0].n > POOL_PARTS or max(c.offsets[c.n] for c in self.columns) > POOL_VALUES:
            self._clear()
        coded = parts.dictionary_encode()
        distinct = _bytes(coded.dictionary)
        found = list(map(self.known.get, distinct))
        new = [p for p, at in zip(distinct, found) if at is None]
        if new:
            first = self.columns[0].n
            for column, dtype, values in zip(self.columns, self.dtypes, self.encode(new)):
                lengths = np.fromiter(map(len, values), np.int64, len(new))
                column.add(lengths, np.frombuffer(b"".join(values), np.uint8) if dtype == np.uint8
                           else np.fromiter(chain.from_iterable(values), dtype, int(lengths.sum())))
            self.known.update((p, first + i) for i, p in enumerate(new) if len(p) <= POOL_PART_BYTES)
            at = iter(range(first, first + len(new)))
            found = [next(at) if x is None else x for x in found]
        return np.array(found, np.int64)[coded.indices.to_numpy()] if found else np.zeros(0, np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    """Values of a large binary column without nulls; several times as fast as ``to_pylist``."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes() if column.buffers()[2] else b""
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def part_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow column; they ascend and do not overlap."""
    lengths = end - start
    step = np.zeros(data.size + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    kept = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = np.ascontiguousarray(data[kept])
    return pa.Array.from_buffers(pa.large_binary(), lengths.size, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def per_text(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the parts' ``lengths`` over each text (parts ``first[i]:first[i+1]``)."""
    total = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
