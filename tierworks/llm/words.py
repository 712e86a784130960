"""Numbers for the distinct words of many texts, looked up in a hash table of flat numpy arrays.

Words are runs of an array of code points. A word's hash comes from prefix sums, so all words of a piece are
hashed and looked up at once; every hit is compared with the stored word, code point by code point.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def inverse(odd: int) -> int:
    """Of an odd number modulo 2 ** 64."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


class Powers:
    """Powers of BASE and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, BASE, np.uint64)))
            self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, np.uint64(inverse(int(BASE))), np.uint64)))
        return self.up, self.down


POWERS = Powers()


def hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An odd hash of each run of code points."""
    up, down = POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    h = (sums[starts + lengths] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h = h * MIX + lengths.astype(np.uint64)
    h ^= h >> np.uint64(29)
    return (h * MIX) | np.uint64(1)


class Growing:
    """An array that grows at its end; its room doubles, so adding costs what is added."""

    def __init__(self, values: np.ndarray):
        self.room, self.size = values, len(values)

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * self.size), self.room.dtype)
            room[: self.size] = self.all
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Words:
    """Numbers words from 0 as they are added; room for 2 ** (bits - 1) of them."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)
        self.hash = Growing(np.zeros(0, np.uint64))
        self.chars = Growing(np.zeros(0, np.uint32))
        self.offsets, self.lengths = Growing(np.zeros(0, np.int32)), Growing(np.zeros(0, np.int32))

    def __len__(self) -> int:
        return self.hash.size

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number under each hash, or -1."""
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slots[left]]
            hit = key == h[left]
            out[left[hit]] = self.numbers[slots[left[hit]]]
            left = left[~hit & (key != 0)]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Store words that are not there yet, one for each hash; returns their numbers."""
        made = len(self) + np.arange(len(h), dtype=np.int32)
        slots, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = h[free]
            stored = self.keys[slots[left]] == h[left]
            self.numbers[slots[left[stored]]] = made[left[stored]]
            left = left[~stored]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        ends = np.cumsum(lengths)
        self.hash.add(h)
        self.offsets.add(self.chars.size + ends - lengths)
        self.lengths.add(lengths)
        self.chars.add(codes[np.repeat(starts - (ends - lengths), lengths) + np.arange(lengths.sum())])
        return made

    def same(self, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> bool:
        """Whether the words that tile ``codes`` are those stored under the numbers."""
        lengths = np.diff(np.append(starts, len(codes)))
        if not np.array_equal(self.lengths.all[numbers], lengths):
            return False
        place = np.repeat(self.offsets.all[numbers] - starts.astype(np.int32), lengths)
        place += np.arange(len(codes), dtype=np.int32)
        return np.array_equal(self.chars.all[place], codes)

    def kept(self, numbers: np.ndarray) -> Words:
        """A table of only these words, numbered in this order."""
        out = Words(self.bits)
        out.add(self.hash.all[numbers], self.chars.all, self.offsets.all[numbers].astype(np.int64), self.lengths.all[numbers].astype(np.int64))
        return out
