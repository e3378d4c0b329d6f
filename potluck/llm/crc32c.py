"""CRC-32C of many byte strings at once, each a whole number of 32-bit words, in numpy.

A string is padded in front with zeros (which a register of zero ignores) to segments of 64
bytes; the registers of all segments are computed together, eight bytes a step. A segment is
then shifted past what follows it in its string by powers of the operator that feeds in zero
bytes, and the segments of a string are added (xor), as is the shifted start value.
"""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78          # Castagnoli, reflected
MASK_DELTA = 0xA282EAD8          # of the masked form
WORDS = 16                       # words of a segment
_U = np.uint32


@cache
def _steps() -> np.ndarray:
    """Register after byte b and k zero bytes, for k = 0..7."""
    table = np.zeros((8, 256), _U)
    value = np.arange(256, dtype=_U)
    for _ in range(8):
        value = np.where(value & _U(1), (value >> _U(1)) ^ _U(POLYNOMIAL), value >> _U(1))
    table[0] = value
    for k in range(1, 8):
        table[k] = (table[k - 1] >> _U(8)) ^ table[0][table[k - 1] & _U(255)]
    return table


@cache
def _zeros(power: int) -> np.ndarray:
    """The operator that feeds in 2 ** power zero bytes, as four tables by byte of the register."""
    if power == 0:
        t, byte = _steps(), np.arange(256, dtype=_U)
        return np.stack([t[0], byte, byte << _U(8), byte << _U(16)])
    half = _zeros(power - 1)
    byte = np.arange(256, dtype=_U)
    return np.stack([_apply(half, _apply(half, byte << _U(8 * i))) for i in range(4)])


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    return (tables[0][register & _U(255)] ^ tables[1][(register >> _U(8)) & _U(255)]
            ^ tables[2][(register >> _U(16)) & _U(255)] ^ tables[3][register >> _U(24)])


def _shift(register: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each register after so many zero bytes."""
    register, power = register.copy(), 0
    while (rest := n_bytes >> power).any():
        on = (rest & 1).astype(bool)
        if on.any():
            register[on] = _apply(_zeros(power), register[on])
        power += 1
    return register


def crc32c(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32C of each ``words[start:start + length]`` (little-endian words)."""
    start, length = np.asarray(start, np.int64), np.asarray(length, np.int64)
    segments = -(-length // WORDS)
    first = np.cumsum(segments) - segments
    total = int(segments.sum())
    padded = np.zeros(total * WORDS, _U)
    ends = np.cumsum(length)
    inside = np.arange(int(ends[-1]) if ends.size else 0) - np.repeat(ends - length, length)
    padded[np.repeat((first + segments) * WORDS - length, length) + inside] = words[np.repeat(start, length) + inside]
    padded = padded.reshape(total, WORDS)
    table, byte, register = _steps(), _U(255), np.zeros(total, _U)
    for i in range(0, WORDS, 2):
        a, b = padded[:, i] ^ register, padded[:, i + 1]
        register = (table[7][a & byte] ^ table[6][(a >> _U(8)) & byte] ^ table[5][(a >> _U(16)) & byte] ^ table[4][a >> _U(24)]
                    ^ table[3][b & byte] ^ table[2][(b >> _U(8)) & byte] ^ table[1][(b >> _U(16)) & byte] ^ table[0][b >> _U(24)])
    behind = np.repeat(first + segments, segments) - np.arange(total) - 1
    register = _shift(register, behind * (WORDS * 4))
    out = _shift(np.full(length.size, 0xFFFFFFFF, _U), length * 4)
    some = segments > 0
    if total:
        out[some] ^= np.bitwise_xor.reduceat(register, first[some])
    return out ^ _U(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The form in which checksums are stored: rotated and offset, so that a checksum of data
    that hold checksums is sound."""
    return ((crc >> _U(15)) | (crc << _U(17))) + _U(MASK_DELTA)
