"""FM-index of one shard: suffix order, wavelet-tree ranks over its transform and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` by doubling. Zeros end a run; every zero is smaller than all symbols and
    differs from the others (earlier is smaller), so that no comparison crosses it and log2(longest run) rounds do."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    h = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + after if h < n else rank
        order = np.argsort(key)
        there = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], there[1:] != there[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


class Ranks:
    """A bit row with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def bit(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """``text``: symbols from 1 to ``sigma``, zeros at the end of each run and at the very end. Every ``sample``-th
    position and every start of a run is sampled, so that a walk back never leaves its run."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        self.n = len(text)
        order = suffix_array(text)
        row = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        marked = (order % sample == 0) | (row == 0)
        self.mark = Ranks(marked)
        self.position = order[marked]
        self.levels: list[Ranks] = []
        self.shifts = list(range(max(1, int(sigma).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (row >> shift) & 1
            self.levels.append(Ranks(bits.astype(bool)))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        symbols = np.arange(sigma + 1)
        self.base = self._descend(symbols, np.zeros(sigma + 1, np.int64))

    def _descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.ones(i)
            i = np.where((symbols >> shift) & 1 == 1, level.zeros + ones, i - ones)
        return i

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (right-aligned rows) at once: (pattern, low, high) of those that occur."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        done = []
        for step in range(width + 1):
            ended = lengths[alive] == step
            done.append((alive[ended], low[ended], high[ended]))
            alive, low, high = alive[~ended], low[~ended], high[~ended]
            if step == width or not len(alive):
                break
            c = patterns[alive, width - 1 - step]
            low = self.first[c] + self._descend(c, low) - self.base[c]
            high = self.first[c] + self._descend(c, high) - self.base[c]
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled row and add the steps."""
        out = np.empty(len(rows), np.int64)
        at, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            found = self.mark.bit(at)
            out[open_[found]] = self.position[self.mark.ones(at[found])] + steps
            open_, at = open_[~found], at[~found]
            i, c = at, np.zeros(len(at), np.int64)
            for level in self.levels:
                bit, ones = level.bit(i), level.ones(i)
                i = np.where(bit, level.zeros + ones, i - ones)
                c = c * 2 + bit
            at = self.first[c] + i - self.base[c]
            steps += 1
        return out
