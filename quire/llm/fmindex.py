"""A word-level FM-index of one shard: suffix order, wavelet tree, backward search, locate.

Symbols are small integers; 0 is a break that no phrase crosses. Every break sorts as a
symbol of its own, so suffixes are compared up to the next break at most.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of symbols (the last is a break) in lexicographic order, by prefix doubling.

    Only suffixes that still tie with another are sorted again.
    """
    n = len(symbols)
    breaks = symbols == 0
    key = symbols.astype(np.int64) + int(breaks.sum())
    key[breaks] = np.arange(int(breaks.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots, h = np.arange(n), 1
    sorted_key = key[order]
    while True:
        # order[slots] is sorted by sorted_key; a rank is the first slot of its group
        start = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        first = slots[np.maximum.accumulate(np.where(start, np.arange(len(slots)), 0))]
        rank[order[slots]] = first
        alone = start & np.concatenate((start[1:], [True]))
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * (n + 1) + rank[at + h]
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        sorted_key = key[by]
        h *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, with running counts, halves kept stable."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels, self.zeros, now = [], [], sequence
        self.height = max(1, int(top).bit_length())
        for level in range(self.height - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(now) - int(self.levels[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.base = self.descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - k)) & 1
            up = ones[at]
            at = np.where(one == 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self.descend(symbol, at) - self.base[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            up = ones[at].astype(np.int64)
            one = ones[at + 1] - up
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + up, at - up)
        return symbol, at - self.base[symbol]


class FMIndex:
    """Index of symbols (0: break, last symbol included; words 1..top)."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64), top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        # Sampled suffixes: every sample-th of a run between breaks, its first included, so no walk crosses a break.
        since = np.arange(self.n) - np.maximum.accumulate(np.where(symbols == 0, np.arange(self.n), -1)) - 1
        marked = ((since % sample == 0) | (symbols == 0))[order]
        self.marked = marked
        self.sample_at = np.cumsum(marked) - 1
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long phrases (rows), by backward search."""
        count, length = phrases.shape
        lo, hi = np.zeros(count, np.int64), np.zeros(count, np.int64)
        live = np.arange(count)
        last = phrases[:, length - 1]
        a, b = self.before[last], self.before[last + 1]
        for k in range(length - 2, -1, -1):
            some = b > a
            live, a, b = live[some], a[some], b[some]
            if not len(live):
                return lo, hi
            word = phrases[live, k]
            a = self.before[word] + self.tree.rank(word, a)
            b = self.before[word] + self.tree.rank(word, b)
        lo[live], hi[live] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step backwards until one whose position was sampled."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            known = self.marked[here]
            out[open_[known]] = self.samples[self.sample_at[here[known]]] + steps
            open_, here = open_[~known], here[~known]
            if len(open_):
                symbol, rank = self.tree.access_rank(here)
                at[open_] = self.before[symbol] + rank
            steps += 1
        return out
