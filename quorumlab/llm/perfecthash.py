"""A minimal perfect hash over 128-bit keys, as flat arrays.

Keys are thrown at a bit array; those that fall alone own their bit, the rest go to the next,
smaller array with other hashes.  A key's index is the number of set bits before its own, so the
``n`` keys get the indices 0 to n - 1.  About three bits a key; construction and look-up are whole
array operations.  Keys outside the set get an index too or -1: the owner compares a fingerprint.
"""

from __future__ import annotations

import numpy as np

#: Bits of an array for each key that is still to be placed.
ROOM = 2
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)  # fixed odd multipliers


def _mixed(low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = low ^ seed
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ high ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """``sizes`` are the arrays' lengths in words of 64 bits, ``words`` all of them in a row."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        """For distinct keys, each given as two unsigned 64-bit halves."""
        sizes, arrays = [], []
        while len(low):
            bits = -(-ROOM * len(low) // 64) * 64
            spots = (_mixed(low, high, len(sizes)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(spots, minlength=bits) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits // 64)
            left = ~alone[spots]
            low, high = low[left], high[left]
        return cls(np.array(sizes, np.int64), np.concatenate(arrays) if arrays else np.zeros(0, np.uint64))

    def index(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some that are not in the set."""
        found = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            spots = _mixed(low[left], high[left], level) % np.uint64(size * 64)
            word = (spots >> np.uint64(6)).astype(np.int64) + self.starts[level]
            bit = spots & np.uint64(63)
            own = self.words[word] >> bit
            hit = (own & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below).astype(np.int64)
            found[left[hit]] = rank[hit]
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + self.sizes.tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return cls(np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint64, -1, 8 + 8 * n))
