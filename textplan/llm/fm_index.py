"""An FM-index over a sequence of small integers, with whole-array operations."""

from __future__ import annotations

import numpy as np

#: Every so many text positions, the suffix array is kept.
SAMPLE = 16


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: max(n - k, 0)] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class WaveletTree:
    """Counts of a symbol in any prefix, by one bit vector with running ranks for each bit of a symbol.

    Each level orders the sequence stably by the bits above it, so a symbol's
    occurrences are followed down from level to level.
    """

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.zeros, self.ones, self.bits = levels, [], [], []
        v = values
        for level in range(levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.bits.append(bit.astype(bool))
            self.zeros.append(len(v) - int(self.ones[-1][-1]))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of each symbol are before each end."""
        lo, hi = np.zeros_like(end), end
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][lo], self.ones[i][hi]
            lo = np.where(one, self.zeros[i] + a, lo - a)
            hi = np.where(one, self.zeros[i] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i in range(self.levels):
            one = self.bits[i][at]
            out = out * 2 + one
            a = self.ones[i][at]
            at = np.where(one, self.zeros[i] + a, at - a)
        return out


class FMIndex:
    """Backward search and location of phrases in one shard; symbols are above zero, zero ends the text."""

    def __init__(self, values: np.ndarray):
        text = np.r_[values.astype(np.int64), 0]
        sa = suffix_array(text)
        bwt = text[sa - 1]
        top = int(text.max()) + 1
        self.n, self.top = len(text), top
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top))]
        self.tree = WaveletTree(bwt, max(1, int(top - 1).bit_length()))
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix array that begin with each phrase (all of one length)."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for i in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, i]
            known = (c > 0) & (c < self.top)
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: step back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            c = self.tree.access(at[live])
            at[live] = self.before[c] + self.tree.rank(c, at[live])
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return (self.samples[self.sample_rank[at]] + steps) % self.n
