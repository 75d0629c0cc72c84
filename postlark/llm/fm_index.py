"""A word-level FM-index over runs of numbered words, in numpy.

The text is a list of runs. Each run ends in a mark of its own, smaller than any word, so
suffixes are ordered within their run and comparing them ends there. The
Burrows-Wheeler transform is kept in a wavelet matrix: one bit vector per bit of a word's
number, with a count per 64 bits. ``search`` extends many phrases backwards at once by
rank; ``locate`` walks rows back to the nearest sampled suffix.
"""

import numpy as np

SAMPLE = 8


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            ones = (values >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(ones), int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before its place."""
        start = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (value >> shift & 1).astype(bool)
            r_at, r_start = bits.rank(at), bits.rank(start)
            at = np.where(one, zeros + r_at, at - r_at)
            start = np.where(one, zeros + r_start, start - r_start)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it occurs before it."""
        value, start = np.zeros_like(at), np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            r_at, r_start = bits.rank(at), bits.rank(start)
            at = np.where(one, zeros + r_at, at - r_at)
            start = np.where(one, zeros + r_start, start - r_start)
            value |= one.astype(value.dtype) << shift
        return value, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, in which every 0 is a mark of its own.

    Prefix doubling; from the second round on only suffixes that still share a rank are
    sorted. Rounds end with the logarithm of the longest repeated run.
    """
    n = len(text)
    marks = text == 0
    rank = np.where(marks, np.cumsum(marks) - 1, text.astype(np.int64) + int(marks.sum()))
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    while True:
        alone = first & np.append(first[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        members = order[places]
        following = np.minimum(members + width, n - 1)
        keys = rank[following]
        sort = np.lexsort((keys, rank[members]))
        members, keys = members[sort], keys[sort]
        order[places] = members
        group = rank[members]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])])
        first[places] = new
        rank[members] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, words: int):
        """``text`` holds numbers from 1 to ``words`` and ends, like every run, in 0."""
        n = len(text)
        order = suffix_array(text)
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int64), max(int(words).bit_length(), 1))
        counts = np.bincount(text, minlength=words + 1)
        self.smaller = np.cumsum(counts) - counts
        starts = np.concatenate([[True], text[:-1] == 0])  # no walk leaves its run
        sampled = (np.arange(n) % SAMPLE == 0) | starts
        self.sampled = _Bits(sampled[order])
        self.samples = order[sampled[order]]
        self.size = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase; phrases are rows of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[alive, column].astype(np.int64)
            low[alive] = self.smaller[word] + self.matrix.rank(word, low[alive])
            high[alive] = self.smaller[word] + self.matrix.rank(word, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at some rows."""
        out = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            done = self.sampled.get(at)
            ended = open_[done]
            out[ended] = self.samples[self.sampled.rank(rows[ended])] + steps
            open_ = open_[~done]
            word, before = self.matrix.access(rows[open_])
            rows[open_] = self.smaller[word] + before
            steps += 1
        return out
