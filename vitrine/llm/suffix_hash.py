"""Prefix polynomial hashes of byte strings, and suffix sorting by them.

The hash of the bytes [p, p + k) of a buffer is a difference of two prefix sums, so any two
substrings are compared in a constant number of steps, and the common extension of two
suffixes is found by binary search over its length. ``suffix_order`` sorts suffixes by a
mergesort whose comparisons are such searches; every merge looks up all elements at once.
Sums are modulo 2^64 over random numbers per byte value. Equal hashes are not proof:
``same_bytes`` compares the bytes themselves.
"""

from __future__ import annotations

import numpy as np

from vitrine.llm.common import ship_by_value

ship_by_value(__name__)

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = spread(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class PrefixHashes:
    """Hashes of all substrings of a buffer; one object serves buffers of any length, one after another."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def read(self, data: np.ndarray) -> PrefixHashes:
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = powers(BASE, n + 1), powers(INVERSE, n + 1)
        self.data = data
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * self.up[:n], out=self.sums[1:])
        return self

    def grams(self, k: int) -> np.ndarray:
        """The hash of every substring of ``k`` bytes, by start."""
        n = max(0, len(self.data) - k + 1)
        return spread((self.sums[k:k + n] - self.sums[:n]) * self.down[:n])

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the substrings of ``length`` bytes at x and at y hash alike."""
        return (self.sums[x + length] - self.sums[x]) * self.up[y] == (self.sums[y + length] - self.sums[y]) * self.up[x]

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common, at most ``most``: binary search over hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), most.astype(np.int64)
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            alike = self.equal(x, y, middle)
            low, high = np.where(alike, middle, low), np.where(alike, high, middle - 1)
        return low

    def same_bytes(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether the substrings are the same, byte by byte."""
        out = np.empty(len(x), dtype=bool)
        step = np.arange(length)
        for at in range(0, len(x), 20_000):
            cut = slice(at, at + 20_000)
            out[cut] = (self.data[x[cut, None] + step] == self.data[y[cut, None] + step]).all(axis=1)
        return out


def suffix_order(hashes: PrefixHashes, start: np.ndarray, end: np.ndarray, limit: int, group: np.ndarray) -> np.ndarray:
    """Indices that sort the suffixes [start, end) by group, then by their first ``limit`` bytes; ties keep their order.

    A mergesort inside all groups at once: the runs of every group double in each round until they fill it.
    """
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    first, size = np.repeat(first, size), np.repeat(size, size)
    length = np.minimum(end - start, limit)
    data, last = hashes.data, len(hashes.data) - 1

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Suffix x comes before suffix y (or is equal to it)."""
        common = hashes.extension(start[x], start[y], np.minimum(length[x], length[y]))
        ends_x, ends_y = common >= length[x], common >= length[y]
        at_x, at_y = data[np.minimum(start[x] + common, last)], data[np.minimum(start[y] + common, last)]
        return np.where(ends_x, ~ends_y | or_equal, ~ends_y & (at_x < at_y))

    width = 1
    while True:
        place = np.flatnonzero(size > width)  # in groups that are not one run yet
        if not len(place):
            return order
        base, stop = first[place], first[place] + size[place]
        run = (place - base) // width
        right = (run & 1) == 1
        other = np.minimum(base + (run ^ 1) * width, stop)  # where the run begins that this one is merged with
        low, high = other.copy(), np.minimum(other + width, stop)
        while True:
            still = np.flatnonzero(low < high)
            if not len(still):
                break
            middle = (low[still] + high[still]) >> 1
            # elements of the left run go before equal ones of the right run
            less = before(order[middle], order[place[still]], right[still])
            low[still], high[still] = np.where(less, middle + 1, low[still]), np.where(less, high[still], middle)
        goal = base + (run >> 1) * (2 * width) + (place - base - run * width) + (low - other)
        moved = order.copy()
        moved[goal] = order[place]
        order, width = moved, 2 * width
