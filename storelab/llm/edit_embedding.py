"""Document fingerprints by a randomised edit embedding.

Every text is walked by the same random walk: at step t the walk looks at one character and
a shared random bit of (t, character) says whether it moves on. Texts that differ by few
edits meet again soon after each edit, so the edit distance of the texts becomes a Hamming
distance of the walks. A fingerprint samples the walk at ``SAMPLES`` steps: those with the
least hash among the first D steps, where D is the least number of a fixed ladder that
spans the text. Samples of a longer ladder that lie in a shorter one belong to it too, so
texts of any length can be compared. A sample is one byte of the four characters at the
walk's place; 0 means past the end.

``near_pairs`` bands sampled bytes, links each bucket to its smallest document and confirms
the links by likeness.

The walk runs through all texts of a block in step, so numpy works on columns of texts.
Defined results: a null text is empty; two empty texts have likeness 1, an empty and another
0; rows are ordered by (doc_id, text) with null first, and the next of a single row is the
row itself; equal texts have equal fingerprints; an empty table gives an empty result;
extra columns are not read. ``doc_id`` is an integer.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.wordkit import mix64
from storelab.session import cut

SAMPLES = 128
FIRST_SPAN = 96
BLOCK_BYTES = 6 << 20
BANDS, BAND_SAMPLES = 24, 3
_FEW = 6
# Odd multipliers of the walk's hash.
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1


def span(grid: int) -> int:
    """Number of steps of the ladder at a grid number; each is half as long again."""
    d = FIRST_SPAN
    for _ in range(grid):
        d += d // 2
    return d


def grid_of(n_chars: int) -> int:
    """The least grid whose span holds a walk: 2 n steps on average, and six deviations more."""
    grid, steps = 0, 2 * n_chars + 6 * math.sqrt(2 * n_chars)
    while span(grid) < steps:
        grid += 1
    return grid


class Ladder:
    """The sampled steps of each grid, ascending."""

    def __init__(self):
        self.steps: list[np.ndarray] = []

    def __getitem__(self, grid: int) -> np.ndarray:
        while len(self.steps) <= grid:
            low = span(len(self.steps) - 1) if self.steps else 0
            best = self.steps[-1] if self.steps else np.zeros(0, np.int64)
            for a in range(low, span(len(self.steps)), 1 << 20):
                best = np.r_[best, np.arange(a, min(a + (1 << 20), span(len(self.steps))))]
                if len(best) > SAMPLES:
                    best = best[np.argpartition(_order(best), SAMPLES - 1)[:SAMPLES]]
            self.steps.append(np.sort(best))
        return self.steps[grid]

    def widened(self, samples: np.ndarray, grid: int, to: int) -> np.ndarray:
        """Samples of a grid seen as samples of a longer one (0 where they do not reach)."""
        if grid == to:
            return samples
        out = np.zeros(SAMPLES, np.uint8)
        steps = self[to]
        inside = steps < span(grid)
        out[inside] = samples[np.searchsorted(self[grid], steps[inside])]
        return out


def _order(steps: np.ndarray) -> np.ndarray:
    return mix64(steps.astype(np.uint64) * np.uint64(_B) + np.uint64(1))


def _walk_keys(n: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def walked(texts: list[str], ladder: Ladder) -> list[bytes]:
    """The sampled bytes of each text, with its grid in front."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(("\0\0\0\0".join([texts[i] for i in order]) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    length = sizes[order]
    base = np.cumsum(length + 4) - (length + 4)
    grids = np.array([grid_of(int(n)) for n in length], np.int64)
    out = {int(g): np.zeros((int((grids == g).sum()), SAMPLES), np.uint8) for g in np.unique(grids)}
    row_in_grid = np.zeros(len(texts), np.int64)
    for g in out:
        row_in_grid[grids == g] = np.arange(int((grids == g).sum()))
    wanted: dict[int, list[tuple[int, int]]] = {}
    for g in out:
        for k, t in enumerate(ladder[g].tolist()):
            wanted.setdefault(t, []).append((g, k))
    last = max(wanted, default=-1) + 1
    keys = _walk_keys(max(last, 1))
    active = np.flatnonzero(length > 0)
    at = base[active].copy()
    end = base[active] + length[active]
    a, b, top = np.uint64(_A), np.uint64(_B), np.uint64(63)

    def record(t: int, rows: np.ndarray, where: np.ndarray) -> None:
        four = (flat[where].astype(np.uint64) * a + flat[where + 1]) * a + flat[where + 2]
        byte = (mix64((four * a + flat[where + 3]) ^ keys[t]) >> np.uint64(56)).astype(np.uint8)
        byte[byte == 0] = 1
        for g, k in wanted[t]:
            own = grids[rows] == g
            out[g][row_in_grid[rows[own]], k] = byte[own]

    for t in range(last):
        if t in wanted:
            live = at < end
            record(t, active[live], at[live])
        at = at + (((flat[np.minimum(at, end)].astype(np.uint64) * a ^ keys[t]) * b) >> top).astype(np.int64)
        if not t & 63 or t in wanted:
            live = at < end
            if not live.all():
                active, at, end = active[live], at[live], end[live]
            if len(active) <= _FEW:
                _finish(flat, t + 1, last, active, at, end, keys, wanted, record)
                break
    result: list[bytes] = [b""] * len(texts)
    for i, place in enumerate(order.tolist()):
        result[place] = bytes([int(grids[i])]) + out[int(grids[i])][row_in_grid[i]].tobytes()
    return result


def _finish(flat, first: int, last: int, active, at, end, keys, wanted, record) -> None:
    """Walk the few longest texts alone."""
    key = keys.tolist()
    for row, place, stop in zip(active.tolist(), at.tolist(), end.tolist()):
        chars = flat[place: stop].tolist()
        p, n = 0, len(chars)
        for t in range(first, last):
            if p >= n:
                break
            if t in wanted:
                record(t, np.array([row]), np.array([place + p]))
            p += (((chars[p] * _A & _ALL) ^ key[t]) * _B & _ALL) >> 63


def likeness(x: bytes, y: bytes, ladder: Ladder) -> float:
    """Share of equal samples among the steps that either walk reaches."""
    to = max(x[0], y[0])
    a, b = (ladder.widened(np.frombuffer(v[1:], np.uint8), v[0], to) for v in (x, y))
    either = (a > 0) | (b > 0)
    return float((a == b)[either].mean()) if either.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows by block of neighbouring ids; each block also gets the row that follows it.

    Block limits and the first id of each block, two numbers per block, reach the driver.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("at"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    probs = [i / n for i in range(1, n)]
    limits = []
    if probs:
        limits = rows.agg(F.percentile_approx("at", F.array(*map(F.lit, probs)), F.lit(max(10_000, 10 * n)))).first()[0]
    limits = np.unique(np.array(limits, np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches):
        for batch in batches:
            block = np.searchsorted(limits, batch.column("at").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(block)], ["at", "block"])

    firsts = rows.select("at").mapInArrow(number, "at long, block long").groupBy("block").agg(F.min("at").alias("at")).orderBy("block").collect()
    heads = np.array([r["at"] for r in firsts], np.int64)
    before = np.roll(np.array([r["block"] for r in firsts], np.int64), 1)  # the block in front of each head; the last for the first

    def deal(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            block = np.searchsorted(limits, at, "right")
            yield batch.append_column("block", pa.array(block)).append_column("follows", pa.array(np.zeros(len(at), bool)))
            place = np.minimum(np.searchsorted(heads, at), len(heads) - 1)
            again = np.flatnonzero(heads[place] == at)
            if len(again):
                yield (batch.take(pa.array(again)).append_column("block", pa.array(before[place[again]]))
                       .append_column("follows", pa.array(np.ones(len(again), bool))))

    return rows.mapInArrow(deal, f"doc_id {kind}, text string, at long, block long, follows boolean")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, the two fingerprints and their likenesses."""
    def block(table):
        ladder = Ladder()
        rows = sorted(zip(table.column("follows").to_pylist(), table.column("at").to_pylist(),
                          table.column("text").to_pylist(), table.column("doc_id").to_pylist()), key=lambda r: r[:3])
        own = [r for r in rows if not r[0]]
        texts = [r[2] for r in own]
        after = texts[1:] + [next(r[2] for r in rows if r[0])]
        other = [edited(x, y) for x, y in zip(texts, after)]
        prints = walked([*texts, after[-1], *other], ladder)
        mine, theirs = prints[: len(texts) + 1], prints[len(texts) + 1:]
        return pa.table({
            "doc_id": pa.array([r[3] for r in own], table.schema.field("doc_id").type),
            "n_chars": pa.array([len(x) for x in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in other],
            "fingerprint": [x.hex() for x in mine[:-1]],
            "edited_fingerprint": [x.hex() for x in theirs],
            "near_edited": pa.array([likeness(x, y, ladder) for x, y in zip(mine, theirs)], pa.float64()),
            "near_next": pa.array([likeness(x, y, ladder) for x, y in zip(mine, mine[1:])], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _blocks(docs).groupBy("block").applyInArrow(
        block, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, keys): the fingerprint and the band keys of every row."""
    def sign(batches):
        ladder = Ladder()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                prints = walked([x or "" for x in part.column("text").to_pylist()], ladder)
                keys = []
                for x in prints:
                    own = np.frombuffer(x[1:], np.uint8)
                    keys.append([hashlib.blake2b(bytes([g, b]) + w.tobytes(), digest_size=8).hexdigest()
                                 for g in (x[0], x[0] + 1) for wide in [ladder.widened(own, x[0], g)]
                                 for b in range(BANDS) for w in [wide[mix64(np.arange(b * BAND_SAMPLES, (b + 1) * BAND_SAMPLES)
                                                                           + 99) % np.uint64(SAMPLES)]] if (w > 0).any()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.hex() for x in prints]),
                                                  pa.array(keys, pa.list_(pa.string()))], ["doc_id", "fingerprint", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, fingerprint string, keys array<string>")


def near_pairs(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, likeness): links of each bucket's smallest fingerprint class to the others, confirmed.

    Rows with equal fingerprints are one class, named by its smallest ``doc_id``.
    """
    classes = cut(fingerprints(docs).where("doc_id is not null").groupBy("fingerprint")
                  .agg(F.min(F.struct("doc_id", "keys")).alias("r")).select("fingerprint", "r.doc_id", "r.keys"))
    members = classes.select("doc_id", "fingerprint", F.explode("keys").alias("key"))
    hubs = (members.groupBy("key").agg(F.min(F.struct("doc_id", "fingerprint")).alias("h"), F.count("*").alias("n"))
            .where("n > 1").select("key", F.col("h.doc_id").alias("a"), F.col("h.fingerprint").alias("fa")))
    pairs = (members.join(hubs, "key").where("a <> doc_id")
             .select("a", F.col("doc_id").alias("b"), "fa", F.col("fingerprint").alias("fb")).distinct())

    def check(batches):
        ladder = Ladder()
        for batch in batches:
            near = [likeness(bytes.fromhex(x), bytes.fromhex(y), ladder)
                    for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], ["a", "b", "likeness"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(check, f"a {kind}, b {kind}, likeness double").where(F.col("likeness") >= least)
