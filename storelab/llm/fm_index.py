"""A compressed FM-index over word numbers, with vectorised backward search."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank queries on a sequence, one bit vector with block counts per level.

    The levels are stored without pointers: level by level, symbols with a 0 bit go left.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        start = np.zeros(n_symbols, np.int64)
        codes = np.arange(n_symbols)
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(np.r_[bit, np.zeros(64 - len(bit) % 64, bit.dtype)].astype(bool), bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(len(now) - bit.sum()))
            start = self._down(len(self.words) - 1, (codes >> level) & 1, start)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = start

    def _down(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & mask)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        out = at
        for k in range(self.depth):
            out = self._down(k, (symbol >> (self.depth - 1 - k)) & 1, out)
        return out - self.start[symbol]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by (rank, rank ``step`` places on)."""
    later = np.zeros_like(rank)
    later[: len(rank) - step] = rank[step:] + 1
    return _dense(rank * (len(rank) + 1) + later)


class FMIndex:
    """Index of a text of word numbers, whose suffixes are sorted by more than ``depth`` words.

    That order is enough to search patterns of up to ``depth`` + 1 words.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        rank, step = _dense(text), 1
        at_depth = None
        while step <= depth:
            if step <= depth < 2 * step:
                at_depth = _paired(rank, depth - step) if depth > step else rank
            if step < len(rank):
                rank = _paired(rank, step)
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        n_symbols = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.tree = WaveletTree(text[self.suffixes - 1], n_symbols)
        ordered = at_depth[self.suffixes]
        # rows whose suffixes agree in their first ``depth`` words
        self.group = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        self.group_start = np.r_[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), len(text)]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        n = len(symbol)
        both = self.tree.rank(np.r_[symbol, symbol], np.r_[low, high]) + np.r_[self.before[symbol], self.before[symbol]]
        return both[:n], both[n:]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` words of the patterns that begin at these rows."""
        g = self.group[low]
        return self.group_start[g], self.group_start[g + 1]


def earliest(text: np.ndarray, owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each window of ``depth`` words of the pieces: the smallest owner of an equal window.

    ``text`` holds all pieces with a 0 between them, ``owner`` the number of the document
    of each word. Pieces are streamed from their last word to their first: each step
    extends all open matches by one word and shortens them to ``depth``. The result lists
    the windows of the first piece, then those of the second, and so on.
    """
    index = FMIndex(text, depth)
    least = np.minimum.reduceat(owner[index.suffixes], index.group_start[:-1])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n_windows = np.maximum(lengths - depth + 1, 0)
    offset = np.empty(len(order), np.int64)
    sizes = np.empty(len(order), np.int64)
    sizes[order] = n_windows
    offset = (np.cumsum(sizes) - sizes)[order]
    out = np.zeros(int(n_windows.sum()), owner.dtype)
    low, high = np.zeros(len(order), np.int64), np.full(len(order), len(text), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, "left"))  # pieces longer than t
        low, high = index.extend(text[starts[:n] + lengths[:n] - 1 - t], low[:n], high[:n])
        if t + 1 > depth:
            low, high = index.shorten(low)
        if t + 1 >= depth:
            out[offset[:n] + lengths[:n] - 1 - t] = least[index.group[low]]
    return out
