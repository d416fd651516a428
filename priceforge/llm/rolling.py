"""Hashes of all substrings of a buffer from prefix sums, with numpy.

``P[i] = sum of r[j] * M**j`` for j < i modulo 2**64, where ``r[j]`` is not the unit at j but a mixed hash of the
``GRAM`` units from there on. The hash of [a, b) is the sum over the grams that lie within it, times ``M**-a``, mixed
with the length: the same wherever the substring stands. M is odd, so its inverse exists.

A sum over the units themselves would not do: modulo a power of two, whatever M and the values are, it is the same
for a Thue-Morse word and its complement from 1,024 units on. Grams that cross the borders between the
blocks of such a word depend on both sides, which breaks the rule that makes the two sums equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
#: Units of a gram: bytes fill a 64-bit number, of units that are hashes themselves it takes two.
BYTE_GRAM, HASH_GRAM = 8, 2
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(BYTE_GRAM + 1)], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if len(table) <= 1 << 22:
            _powers[base] = table
    return table


class Prefixes:
    """Prefix hashes of one buffer of bytes, or of 64-bit values that are hashes themselves."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.bytes = buffer.dtype == np.uint8
        self.gram = BYTE_GRAM if self.bytes else HASH_GRAM
        if self.bytes:
            # Eight bytes from each place on, zeros behind the end; only grams within a substring count.
            units = np.zeros(n + BYTE_GRAM, dtype=np.uint64)
            units[:n] = buffer
            for size in (1, 2, 4):
                units[:-size] |= units[size:] << np.uint64(8 * size)
            units = units[:n]
            grams = mixed(units)
        else:
            units = mixed(buffer.astype(np.uint64))
            grams = units.copy()
            grams[:-1] = mixed(units[:-1] * np.uint64(3) + units[1:])
        self.units = units
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(grams * _power_table(_M, n + 1)[:n], dtype=np.uint64, out=self.sums[1:])
        self.back = _power_table(_M_INVERSE, n + 1)

    def masked(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first bytes of substrings, up to eight, as a number each."""
        return self.units[starts] & _MASKS[np.minimum(lengths, BYTE_GRAM)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        inside = np.maximum(ends - self.gram + 1, starts)
        found = (self.sums[inside] - self.sums[starts]) * self.back[starts]
        short = np.flatnonzero(length < self.gram)
        if len(short):
            own = length[short].astype(np.int64)
            at = np.minimum(starts[short], len(self.units) - 1) if len(self.units) else starts[short]
            units = self.units[at] if len(self.units) else np.zeros(len(short), dtype=np.uint64)
            found[short] = mixed(units & _MASKS[own]) if self.bytes else np.where(own > 0, units, np.uint64(0))
        return mixed(found + length * _LENGTH)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a hash over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def pieces(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of about ``most`` in total size, at least one item each."""
    start, total, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        if n - 1 > start and total + size > most:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n
