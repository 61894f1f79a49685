"""Best-fit packing of token pieces, improved by swaps.

A document's ids and one end id are cut into pieces of at most ``SEQUENCE`` ids; only
longer documents are cut. Pieces are dealt by hash into groups of about ``GROUP_PIECES``.
Each group is packed best fit, longest first, then improved: bins that are not full
exchange up to two pieces for up to two (or none) of any other such bin, whenever that
raises the sum of squared fills, until no exchange helps or no packing has fewer bins.
The poorly filled bins of all groups are packed again together, so many groups waste no
more than few.

A task holds the lengths of one group, never texts; ids are made again where they are
needed. Defined results: a null text is empty and has the end id only; a repeated row is a
document of its own; rows without ``doc_id`` are packed like any other; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.tokens import WORD_TOKENIZER, WordEncoder
from storelab.llm.wordkit import binaries, ragged, slices
from storelab.session import cut

SEQUENCE = 4096
GROUP_PIECES = 60_000
POOR = 0.97  # bins filled less are packed again with those of other groups


def pieces(docs: DataFrame, tokenizer: str = WORD_TOKENIZER, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids (4 bytes each)."""
    def cut_up(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for s in slices(batch.column("text")):
                ids, begins = encoder.ids(s)
                length = np.diff(begins)
                n = -(-length // size)
                doc = np.repeat(np.arange(s.n_docs), n)
                piece = ragged(np.zeros(s.n_docs, np.int64), n)
                start = piece * size
                take = np.minimum(length[doc] - start, size)
                at = begins[doc] + start
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a: 4 * (a + k)]) for a, k in zip(at.tolist(), take.tolist())]
                columns = [batch.column("doc_id").take(pa.array(doc + s.first)), pa.array(piece.astype(np.int32)),
                           pa.array(start), pa.array(take), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(binaries(np.frombuffer(raw, np.uint8), np.r_[4 * at, len(raw)]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin with room r is listed
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= n
        else:
            b, room = len(bins), size - n
            bins.append([i])
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing gets below: the best of the total length and of the
    dual feasible functions u(x) = floor((k + 1) x) / k, where (k + 1) x is no whole number."""
    distinct, n = np.unique(lengths, return_counts=True)
    best = -(-int(lengths.sum()) // size)
    for k in range(1, 101):
        up = (k + 1) * distinct
        whole = up % size == 0
        exact, steps = int((distinct * n)[whole].sum()), int((up // size * n)[~whole].sum())
        best = max(best, -(-(exact * k + steps * size) // (size * k)))
    return best


class _Open:
    """The open bins by room and by the sums of one or two of their pieces.

    Pieces of one length are interchangeable, so a bin is the sorted tuple of its lengths
    and equal bins are one entry. ``below[r, i]`` is the number of sums less than i that the
    bins with room r offer (0 stands for no piece), so any window of sums is two lookups.
    """

    def __init__(self, size: int):
        self.size = size
        self.sums: dict[tuple, dict[int, tuple]] = {}
        self.by_room: dict[int, dict[tuple, None]] = {}
        self.offers = np.zeros((size + 1, size + 1), np.int32)
        self.below = np.zeros((size + 1, size + 2), np.int16)
        self.n_entries = np.zeros(size + 1, np.int64)

    def room(self, entry: tuple) -> int:
        return self.size - sum(entry)

    def _change(self, entry: tuple, by: int) -> None:
        r = self.room(entry)
        self.offers[r, np.fromiter(self.sums[entry], np.int64)] += by
        self.n_entries[r] += by
        np.cumsum(self.offers[r] > 0, out=self.below[r, 1:])

    def add(self, entry: tuple) -> None:
        distinct = sorted(set(entry))
        sums = {0: ()}
        for i, x in enumerate(distinct):
            for y in distinct[i:]:
                if x < y or entry.count(x) > 1:
                    sums[x + y] = (x, y)
        self.sums[entry] = sums | {x: (x,) for x in distinct}
        self.by_room.setdefault(self.room(entry), {})[entry] = None
        self._change(entry, 1)

    def drop(self, entry: tuple) -> None:
        self._change(entry, -1)
        del self.by_room[self.room(entry)][entry], self.sums[entry]

    def exchange(self, entry: tuple, sums: dict[int, tuple]):
        """The other bin, what ``entry`` passes to it and what it gets, or None.

        A net length g that passes from fill p to fill q raises the squares if q + g > p.
        """
        rooms = np.flatnonzero(self.n_entries)
        own = np.fromiter(sums, np.int64)
        fill, room = self.size - self.room(entry), self.room(entry)
        for gives in (True, False):
            if gives:
                mine = own[own > 0][:, None]
                least, most = np.maximum(1, fill - self.size + rooms + 1), rooms
                low, high = mine - most, mine - least
                most = np.minimum(mine, most)
                rise = most * (self.size - rooms - fill + most)
            else:
                mine = own[:, None]
                least = np.maximum(1, self.size - rooms - fill + 1)
                low, high = mine + least, np.broadcast_to(mine + room, (len(own), len(rooms)))
                rise = np.broadcast_to(room * rooms, low.shape)
            low, end = np.clip(low, 0, self.size + 1), np.clip(high + 1, 0, self.size + 1)
            hits = (end > low) & (self.below[rooms, end] > self.below[rooms, low])
            if hits.any():
                at, k = np.unravel_index(np.argmax(np.where(hits, rise, -1)), hits.shape)
                row, a, b = self.below[rooms[k]], low[at, k], end[at, k]
                # the most net length: the least sum in the window to get, the largest one to pass
                other = int(np.searchsorted(row, row[a], "right") if gives else np.searchsorted(row, row[b], "left")) - 1
                partner = next(e for e in self.by_room[int(rooms[k])] if other in self.sums[e])
                return partner, sums[int(mine[at, 0])], self.sums[partner][other]
        return None


def _swapped(entry: tuple, out: tuple, into: tuple) -> tuple:
    left = list(entry)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into]))


def improved(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Raise the sum of squared fills by exchanges of up to two pieces for up to two until none helps.

    Each open bin is compared with all others, both ways; after an exchange only the two new
    bins are. Ends early at a number of bins that no packing gets below. Every exchange
    raises a bounded sum of whole numbers, so the search ends.
    """
    least = least_bins(lengths, size)
    n_bins = len(bins)
    number: dict[tuple, int] = {}
    for own in bins:
        entry = tuple(sorted(lengths[own].tolist()))
        number[entry] = number.get(entry, 0) + 1
    open_bins, waiting = _Open(size), []
    if n_bins > least:
        for entry in number:
            if sum(entry) < size:
                open_bins.add(entry)
                waiting.append((sum(entry), entry))
    heapq.heapify(waiting)

    def count(entry: tuple, by: int) -> None:
        n = number.get(entry, 0) + by
        number[entry] = n
        if sum(entry) < size:
            if by > 0 and n == by:
                open_bins.add(entry)
            if by < 0 and n == 0:
                open_bins.drop(entry)
            if by > 0 and n - by < 2:  # a new bin, or two equal bins, which may help each other
                heapq.heappush(waiting, (sum(entry), entry))
        if not n:
            del number[entry]

    while n_bins > least and waiting:
        _, entry = heapq.heappop(waiting)
        if entry not in number:
            continue
        sums, alone = open_bins.sums[entry], number[entry] == 1
        if alone:
            open_bins.drop(entry)  # a bin is no partner of itself
        found = open_bins.exchange(entry, sums)
        if alone:
            open_bins.add(entry)
        if found is None:
            continue
        partner, out, into = found
        # equal pairs of bins make the same exchange
        times = number[entry] // 2 if partner == entry else min(number[entry], number[partner])
        for old, new in ((entry, _swapped(entry, out, into)), (partner, _swapped(partner, into, out))):
            count(old, -times)
            if new:
                count(new, times)
            else:
                n_bins -= times
        if entry in number:
            heapq.heappush(waiting, (sum(entry), entry))

    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(size + 2)).tolist()
    items = order.tolist()
    result = []
    for entry, n in number.items():
        for _ in range(n):
            result.append([])
            for x in entry:
                result[-1].append(items[first[x]])
                first[x] += 1
    return result


def pack_group(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and fill of the bin for each item."""
    bins = improved(lengths, best_fit(lengths, size), size)
    bin_of, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for b, own in enumerate(bins):
        n = lengths[own]
        bin_of[own] = b
        offset[own] = np.cumsum(n) - n
        fill[own] = n.sum()
    return bin_of, offset, fill


def _packed(items: DataFrame, n: int, first: int, size: int) -> DataFrame:
    groups = max(1, -(-n // GROUP_PIECES))

    def pack(key, table):
        bin_of, offset, fill = pack_group(table.column("length").to_numpy(), size)
        return (table.drop_columns(["group"])
                .append_column("sequence_id", pa.array(first + key[0].as_py() * (1 << 32) + bin_of))
                .append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill)))

    group = F.pmod(F.xxhash64("row", F.lit(first)), F.lit(groups)).cast("long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return (items.withColumn("group", group).groupBy("group")
            .applyInArrow(pack, schema + ", sequence_id long, offset long, fill long"))


def packed(docs: DataFrame, tokenizer: str = WORD_TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(cut(pieces(docs, tokenizer, size)), size)


def pack_pieces(made: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    # a number of its own for every written piece, so that equal ones are spread over groups
    items = made.withColumn("row", F.monotonically_increasing_id())
    once = cut(_packed(items, made.count(), 0, size))
    poor = once.where(F.col("fill") < POOR * size)
    n_poor = poor.count()
    names = [*made.columns, "sequence_id", "offset"]
    again = _packed(poor.drop("sequence_id", "offset", "fill"), n_poor, 1 << 62, size)
    return once.where(F.col("fill") >= POOR * size).select(*names).unionAll(again.select(*names))
