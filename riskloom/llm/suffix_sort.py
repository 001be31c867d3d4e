"""Suffix sorting by mergesort with hashed comparisons.

Prefix polynomial hashes give the hash of any stretch of the data in constant
time, so the common extension of two suffixes is found by binary search over
its length, and a comparison takes logarithmic time.  All runs of one width are
merged at once: an element's place is its own index plus its rank in the other
run, found by binary search.  Equal hashes are verified on the bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


class PrefixHashes:
    """Polynomial hashes of all prefixes of ``data``, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        with np.errstate(over="ignore"):
            powers = np.full(len(data) + 1, BASE, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            inverse = np.full(len(data) + 1, pow(BASE, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.back = np.cumprod(inverse, dtype=np.uint64)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """The common extension of the suffixes at a and b, up to ``limit``; both must have that many bytes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        for _ in range(int(limit).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """-1, 0 or 1 for each pair of suffixes, by their first ``limit`` bytes."""
        shared = self.common(a, b, limit)
        at = np.minimum(shared, limit - 1)
        return np.where(shared >= limit, 0, np.sign(self.data[a + at].astype(np.int16) - self.data[b + at].astype(np.int16)))


def merge_sorted(hashes: PrefixHashes, starts: np.ndarray, segment: np.ndarray, limit: int) -> np.ndarray:
    """The order of suffixes inside each segment, by their first ``limit`` bytes; equal ones keep their order.

    ``segment`` must ascend; suffixes of different segments are not compared.
    """
    n = len(starts)
    order = np.arange(n)
    if n < 2:
        return order
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, n)))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    local = np.arange(n) - begin
    largest = int((end - begin).max())
    width = 1
    while width < largest:
        active = np.flatnonzero(end - begin > width)
        run = local[active] // width
        left = run % 2 == 0
        other = begin[active] + (run + np.where(left, 1, -1)) * width
        low = np.minimum(other, end[active])
        high = np.minimum(other + width, end[active])
        floor = low.copy()
        own = starts[order[active]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            sign = hashes.compare(starts[order[middle]], own[open_], limit)
            # Left elements stand before equal right ones.
            goes = np.where(left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(goes, middle + 1, low[open_])
            high[open_] = np.where(goes, high[open_], middle)
        run_start = begin[active] + (run - np.where(left, 0, 1)) * width
        place = run_start + (active - (begin[active] + run * width)) + (low - floor)
        merged = order.copy()
        merged[place] = order[active]
        order = merged
        width *= 2
    return order


def gather_equal(hashes: PrefixHashes, starts: np.ndarray, segment: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts a segment's suffixes with equal first ``limit`` bytes side by side, and a run number for each place.

    Equal ones keep their order.  One sort by the stretches' hashes gathers them, without comparisons;
    where hashes claim equality, the bytes are compared.
    """
    made = hashes.of(starts, limit)
    order = np.lexsort((made, segment))
    ordered, made, segment = starts[order], made[order], segment[order]
    joined = (made[1:] == made[:-1]) & (segment[1:] == segment[:-1])
    _verify(hashes, ordered, np.flatnonzero(joined), limit)
    return order, np.concatenate([[0], np.cumsum(~joined)]) if len(order) else np.zeros(0, np.int64)


def _verify(hashes: PrefixHashes, ordered: np.ndarray, claimed: np.ndarray, limit: int) -> None:
    reach = np.arange(limit)
    for at in range(0, len(claimed), 1 << 16):
        part = claimed[at : at + (1 << 16)]
        if (hashes.data[ordered[part][:, None] + reach] != hashes.data[ordered[part + 1][:, None] + reach]).any():
            raise ArithmeticError("two different stretches have the same polynomial hash")


def equal_runs(hashes: PrefixHashes, starts: np.ndarray, segment: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """A run number per sorted suffix: neighbours of a segment share it where their first ``limit`` bytes are equal.

    Where hashes claim equality, the bytes are compared.
    """
    ordered = starts[order]
    same = segment[order][1:] == segment[order][:-1]
    near = np.flatnonzero(same)
    claimed = near[hashes.common(ordered[near], ordered[near + 1], limit) >= limit]
    _verify(hashes, ordered, claimed, limit)
    joined = np.zeros(max(len(order) - 1, 0), bool)
    joined[claimed] = True
    return np.concatenate([[0], np.cumsum(~joined)]) if len(order) else np.zeros(0, np.int64)
