"""An FM-index over a sequence of word numbers: backward search through a wavelet matrix.

Every step runs over arrays, so thousands of phrases are searched at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; seq must end in a symbol that is unique and smallest."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class _Bits:
    """A bit vector with rank, in 64-bit words."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[_Bits] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            b = ((cur >> level) & 1).astype(bool)
            self.bits.append(_Bits(b))
            self.zeros.append(int((~b).sum()))
            cur = np.concatenate((cur[~b], cur[b]))
        starts = np.searchsorted(cur_key := _reversed_bits(cur, self.levels), np.arange(1 << self.levels))
        self.start = starts[_reversed_bits(np.arange(symbols), self.levels)]
        assert np.all(np.diff(cur_key) >= 0)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        i = i.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank1(i)
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i - self.start[c]


def _reversed_bits(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(n):
        out |= ((x >> b) & 1) << (n - 1 - b)
    return out


class FMIndex:
    """seq holds numbers from 1 up to symbols - 1; 0 is kept for the end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(np.asarray(seq, np.int64), 0)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))[:symbols]
        self.wavelet = WaveletMatrix(self.bwt, symbols)
        kept = sa % SAMPLE == 0
        self.kept, self.sample = _Bits(kept), sa[kept]
        self._kept = kept

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges (low, high) of phrases, one phrase of equal length in each row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            low = self.first[c] + self.wavelet.rank(c, low)
            high = self.first[c] + self.wavelet.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by stepping back to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self._kept[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.first[c] + self.wavelet.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self._kept[rows[todo]]]
        return self.sample[self.kept.rank1(rows)] + steps
