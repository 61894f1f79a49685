"""Trees as balanced parentheses: two bits a node, with rank and findclose over arrays of nodes.

Bits are packed into 64-bit words. A rank directory counts the opening bits before each
word; a tree over the least excess of each word (range min-max blocks) leads findclose past
all words that cannot hold the answer.
"""

from __future__ import annotations

import numpy as np

_WORD = 64


class Parens:
    """Answers for a sequence of brackets, 1 for opening and 0 for closing."""

    def __init__(self, bits: np.ndarray):
        n_words = max(1, -(-len(bits) // _WORD))
        padded = np.zeros(n_words * _WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        excess = np.cumsum(2 * padded.astype(np.int32) - 1).reshape(n_words, _WORD)
        self.size = 1 << (n_words - 1).bit_length()
        self.least = np.full(2 * self.size, np.iinfo(np.int32).max, np.int32)
        self.least[self.size: self.size + n_words] = excess.min(axis=1)
        level = self.size
        while level > 1:
            half = level >> 1
            self.least[half: level] = np.minimum(self.least[level: 2 * level: 2], self.least[level + 1: 2 * level: 2])
            level = half

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening bits before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.where(bit > 0, np.bitwise_count(inside), 0)

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Position where each excess first falls to its target before the word ends, or -1."""
        found = np.full(len(at), -1, np.int64)
        open_ = np.flatnonzero(np.ones(len(at), bool))
        at, excess = at.copy(), excess.copy()
        while len(open_):
            p = at[open_]
            bit = (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
            excess[open_] += np.where(bit == 1, 1, -1)
            hit = excess[open_] == target[open_]
            found[open_[hit]] = p[hit]
            at[open_] += 1
            open_ = open_[~hit & ((p + 1) & 63 != 0)]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Closing position of each opening position."""
        opens = np.asarray(opens, np.int64)
        target = 2 * self.rank(opens) - opens
        found = np.full(len(opens), -1, np.int64)
        inside = np.flatnonzero((opens + 1) & 63)
        found[inside] = self._scan(opens[inside] + 1, target[inside] + 1, target[inside])
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            return found
        goal = target[rest]
        node = self.size + ((opens[rest] + 1 + 63) >> 6)
        while True:  # up and to the right, until a block can hold the answer
            go = self.least[node] > goal
            if not go.any():
                break
            node = np.where(go, np.where(node & 1, (node + 1) >> 1, node + 1), node)
        while True:  # down to its first word
            go = node < self.size
            if not go.any():
                break
            left = np.where(go, 2 * node, node)
            node = np.where(go, np.where(self.least[left] <= goal, left, left + 1), node)
        start = (node - self.size) * _WORD
        found[rest] = self._scan(start, 2 * self.before[start >> 6] - start, goal)
        return found
