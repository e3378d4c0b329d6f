"""Words of Arrow text columns as flat numpy arrays: boundaries, 64-bit hashes, runs of k words.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; as those are
single UTF-8 bytes, the byte view and the code-point view agree. Texts are taken whole, in
slices of a few megabytes so that the temporary arrays stay small next to a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20          # text handled at a time; a longer single text is one slice
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=_U)          # random value of each byte
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 2**64))
_STEP = _U(0xD1342543DE82EF95)                           # odd multiplier between words


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_POW_INV = _powers(_BASE_INV, 1 << 16)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _POW_INV
    if n > _POW.size:
        size = 1 << (n - 1).bit_length()
        _POW, _POW_INV = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POW[:n], _POW_INV[:n]


@dataclass
class Words:
    """Words of ``n`` texts: ``first[i]:first[i+1]`` are the words of text i in ``start``/``end``
    (byte positions in ``data``); ``row`` is the number of the slice's first text. Text i is
    ``raw[bounds[i]:bounds[i+1]]``; ``data`` is ``raw`` through the table of ``words``."""
    row: int
    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return self.first.size - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = self.data.size
        up, down = _pow(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start]
                   + (self.end - self.start).astype(_U))

    def prefix_hashes(self, sizes: tuple[int, ...]) -> np.ndarray:
        """Hashes of each word's first bytes, one column for each size; 0 where the word is
        not longer than that."""
        n = self.data.size
        up, down = _pow(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        out = np.zeros((self.start.size, len(sizes)), _U)
        for c, size in enumerate(sizes):
            long = self.end - self.start > size
            at = self.start[long]
            out[long, c] = mix((total[at + size] - total[at]) * down[at] + _U(size + (1 << 32)))
        return out

    def text_of(self) -> np.ndarray:
        """Number (within the slice) of each word's text."""
        return np.repeat(np.arange(self.n), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; at least one row."""
    at, n = 0, offsets.size - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def letters_only() -> np.ndarray:
    """Byte table for ``words``: A-Z become a-z, a-z and all bytes of other scripts stay,
    everything else separates words."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


def words(column: pa.Array, limit: int = SLICE_BYTES, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column, slice by slice; each byte passes through ``table`` first."""
    data, offsets = text_buffers(column)
    for at, to in slices(offsets, limit):
        raw = own = data[offsets[at]:offsets[to]]
        if table is not None:
            own = table[raw]
        bounds = offsets[at:to + 1] - offsets[at]
        inside = np.ones(own.size + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = (own != 32) & ((own < 9) | (own > 13))
        cut = np.zeros(own.size + 1, bool)           # a text begins here
        cut[bounds] = True
        is_start = inside[1:-1] & (~inside[:-2] | cut[:-1])
        is_end = inside[1:-1] & (~inside[2:] | cut[1:])
        start, end = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
        yield Words(at, own, np.searchsorted(start, bounds), start, end, raw, bounds)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they all belong to one text."""
    n = hashes.size
    out = np.zeros(n, _U)
    for j in range(k):
        out *= _STEP
        if n - j > 0:
            out[:n - j] += hashes[j:]
    whole = np.zeros(n, bool)
    for_each = np.diff(first)
    last = np.repeat(first[1:], for_each)
    whole[:] = np.arange(n) + k <= last
    return mix(out + _U(k)), whole
