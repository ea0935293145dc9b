"""A run-length index of a set of strings: the runs of their Burrows-Wheeler transform, and matching statistics from samples at the runs' ends.

Strings belong to classes; matches are looked for within a class. All suffixes of a class are sorted, so each
suffix's longest match elsewhere is with the one before it or after it in that order. Where the transform's
symbol is that of the neighbour, both suffixes go on from a longer match: the length is that of the place before,
less one. So lengths are measured at run heads and run ends alone, of which repetitive strings have few,
and streamed from there over the places in between.
"""

from __future__ import annotations

import numpy as np


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; there are zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))


def suffix_order(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places of all suffixes of data[at[i]:at[i + 1]], by class, then by bytes; a suffix that ends comes first, of equal ones that of the earlier string."""
    n, string = len(data), np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][string] - np.arange(n)
    first = np.minimum(left, 8).astype(np.uint64)
    key = _eights(data)[:n] & np.where(first == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * first)) - np.uint64(1))
    key = key.byteswap()
    order = np.lexsort((first, key, classes[string]))
    k, f, c = key[order], first[order], classes[string][order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (c[1:] != c[:-1])])
    rank, depth = np.empty(n, np.int64), 8
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the slot of the first of those that are equal so far
    strings = len(at) - 1
    # ranks of a whole set: suffixes of one rank are told apart by what follows, twice as far each time
    while not new.all():
        again = np.concatenate([~new[1:], [False]]) | ~new
        some = order[again]
        ends = left[some] <= depth
        follow = np.where(ends, string[some], strings + rank[np.where(ends, 0, some + depth)])
        code = rank[some] * (n + strings + 1) + follow
        by = np.argsort(code, kind="stable")
        some, code = some[by], code[by]
        slots = np.flatnonzero(again)
        order[slots] = some
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        new[slots] = fresh
        rank[some] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        depth *= 2
    return order


class RunLengthIndex:
    """Runs of the transform of strings by class: their first and last places in suffix order, and the suffixes there."""

    def __init__(self, data: np.ndarray, at: np.ndarray, classes: np.ndarray):
        self.data, self.at = data, at
        self.ends = np.repeat(at[1:], np.diff(at))
        if not len(data):
            self.heads = self.tails = self.before = self.after = np.zeros(0, np.int64)
            return
        order = suffix_order(data, at, classes)
        kind = np.repeat(classes, np.diff(at))[order]
        symbol = np.where(np.isin(order, at[:-1]), 256, data[order - 1].astype(np.int64))
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)
        together = kind[1:] == kind[:-1]
        head = np.concatenate([[True], ~(same & together)])
        tail = np.concatenate([~(same & together), [True]])
        #: Sampled suffixes, and their neighbours in suffix order, -1 where the class has none.
        self.heads, self.tails = order[head], order[tail]
        above = np.concatenate([[-1], np.where(together, order[:-1], -1)])
        below = np.concatenate([np.where(together, order[1:], -1), [-1]])
        self.before, self.after = above[head], below[tail]

    @property
    def runs(self) -> int:
        return len(self.heads)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes a and b share; none where b is -1."""
        eights = _eights(self.data)
        most = np.where(b < 0, 0, np.minimum(self.ends[a] - a, self.ends[b] - b))
        length, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            differ = eights[a[live] + length[live]] ^ eights[b[live] + length[live]]
            low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
            equal = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            length[live] += equal
            live = live[(equal == 8) & (length[live] < most[live])]
        return np.minimum(length, most)

    def matching_statistics(self) -> np.ndarray:
        """For each place, the length of the longest string from there that also begins elsewhere in its class."""
        n = len(self.data)
        out = np.zeros(n, np.int64)
        for sampled, neighbour in ((self.heads, self.before), (self.tails, self.after)):
            if not n:
                break
            length, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            length[sampled] = self._common(sampled, neighbour)
            last[sampled] = sampled
            last = np.maximum.accumulate(last)
            out = np.maximum(out, length[last] - (np.arange(n) - last))
        return out
