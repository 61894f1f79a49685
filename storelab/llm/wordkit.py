"""Arrow and numpy helpers that run inside Spark tasks: words, hashes and ragged arrays.

A word is a run of bytes other than the space and the bytes 0x09 to 0x0D; as these are
ASCII, runs of bytes and runs of code points are the same. Null texts count as empty.
Arrays are made per slice of about ``SLICE_BYTES`` of text, so the memory of a task is
bounded by its slice or by its longest document, not by its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# Multipliers of the hash functions (odd 64-bit numbers).
_BASE = 0x9E3779B97F4A7C15
_MIX_A = 0xFF51AFD7ED558CCD
_MIX_B = 0xC4CEB9FE1A85EC53
_SHINGLE = 0xD6E8FEB86659FD93


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX_A)
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX_B)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit hashes of byte ranges of a buffer by running sums modulo 2**64."""

    def __init__(self):
        self.codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.lower = self.codes.copy()
        self.lower[65:91] = self.codes[97:123]
        self.up = self.down = np.ones(1, np.uint64)

    def _reserve(self, n: int) -> None:
        if len(self.up) < n + 1:
            n = max(n + 1, SLICE_BYTES + 1)
            self.up = powers(_BASE, n)
            self.down = powers(pow(_BASE, -1, 1 << 64), n)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        self._reserve(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.lower if lower else self.codes)[data] * self.up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Slice:
    """The texts of some documents as one buffer, with their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n_docs = len(offsets) - 1
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(_SPACE[data], out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        stops = inside[:-1] & ~inside[1:]
        cuts = offsets[1:-1]
        touching = cuts[(cuts > 0) & (cuts < len(data))]
        touching = touching[inside[touching] & inside[touching + 1]]
        begins[touching] = True  # two documents meet without a space between them
        stops[touching] = True
        self.starts = np.flatnonzero(begins[:-1])
        self.ends = np.flatnonzero(stops)
        # number of words before each document
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cut a string column into ``Slice`` objects of at most ``limit`` bytes or one document."""
    data, offsets = texts_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], i)
        i = j


def parts(batches, rows: int):
    """The batches, cut to at most so many rows: what is made per batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that lie inside one document.

    Returns the hash and the position (index of the first word) of each run.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_SHINGLE) + words[k: k + n]
    at = np.arange(n)
    crossing = np.zeros(n + 1, bool)
    for b in bounds[1:-1]:  # runs that begin in a document and end in a later one
        crossing[max(0, b - size + 1): min(b, n)] = True
    keep = ~crossing[:n]
    return mix64(out[keep]), at[keep]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive pieces of ``values``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive pieces of a byte array."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
