"""Exact repeated passages by FM-index shards.

A window is ``WINDOW`` consecutive words of one document. A word is removed if a window
that covers it also starts in a document with a smaller ``doc_id``. Windows are judged on
the input.

1. Every window is routed by its anchor: the least hash among its runs of ``ANCHOR`` words,
   runs that are frequent in the corpus last. Equal windows have equal anchors. Neighbouring
   windows with one anchor form a piece.
2. Anchors of a single document cannot match and go. Equal texts and equal pieces are
   collapsed to the smallest document before any text moves, so copies, however many, cost
   one piece; as frequent runs come last, a common line is no anchor of the many different
   windows around it.
3. Each shard of anchors builds an FM-index of its pieces and streams the same pieces
   through it by backward search. A piece's matching statistics reach ``WINDOW`` at a place
   where the interval holds an earlier document.

Defined results: a null text has no words; a row without ``doc_id`` is neither removed from
nor a source; rows that share a ``doc_id`` do not remove each other; repeated rows get equal
results; an empty table gives an empty result; extra columns pass through ``deduplicated``
and are not read by the digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.fm_index import earliest
from storelab.llm.wordkit import Hasher, binaries, lists, mix64, powers, ragged, slices, windows
from storelab.session import cut

WINDOW = 50
ANCHOR = 8
PIECE_WINDOWS = 64
SHARD_WORDS = 400_000
# A run of words is frequent if it occurs more often than this share of the documents.
FREQUENT = 1 / 1000
FREQUENT_LEAST = 48


def _frequent_runs(batches):
    hasher = Hasher()
    for batch in batches:
        codes = [windows(hasher.ranges(s.data, s.starts, s.ends), s.bounds, ANCHOR)[0] for s in slices(batch.column("text"))]
        values, counts = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint64), return_counts=True)
        often = counts >= max(8, int(FREQUENT * batch.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["run", "n"])


def frequent_runs(docs: DataFrame) -> np.ndarray:
    """Hashes of runs that occur more often than ``FREQUENT`` times the documents, sorted.

    A run that frequent is as frequent in some batch of rows, so only those of each batch
    are counted. The list orders the anchors and changes no result. Its length is at most
    the mean number of words of a document divided by ``FREQUENT``.
    """
    local = docs.select("text").mapInArrow(_frequent_runs, "run long, n long")
    limit = max(FREQUENT_LEAST, int(FREQUENT * docs.count()))
    found = local.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("run").collect()
    return np.sort(np.array([r.run for r in found], np.int64).view(np.uint64))


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours."""
    step, out = 1, values
    while 2 * step <= size:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = size - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pieces(words: np.ndarray, frequent: np.ndarray, up: np.ndarray, down: np.ndarray):
    """Key, content hash, first window and number of windows of the pieces of one document."""
    runs, _ = windows(words, np.array([0, len(words)]), ANCHOR)
    order = runs >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        order = order | ((frequent[at] == runs).astype(np.uint64) << np.uint64(63))
    anchor = _sliding_least(order, WINDOW - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    parts = -(-size // PIECE_WINDOWS)
    within = ragged(np.zeros(len(parts), np.int64), parts)
    start = np.repeat(first, parts) + within * PIECE_WINDOWS
    count = np.minimum(np.repeat(size, parts) - within * PIECE_WINDOWS, PIECE_WINDOWS)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)]
    content = mix64((sums[start + count + WINDOW - 1] - sums[start]) * down[start] + count.astype(np.uint64))
    return anchor[start], content, start, count


def pieces(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row per piece: code, doc_id, key, content, start (window) and count (windows)."""
    base = 0xD1342543DE82EF95

    def cut_up(batches):
        hasher = Hasher()
        up, down = powers(base, 1 << 16), powers(pow(base, -1, 1 << 64), 1 << 16)
        for batch in batches:
            row, found = [], []
            for s in slices(batch.column("text")):
                words = hasher.ranges(s.data, s.starts, s.ends)
                for d in np.flatnonzero(s.n_words >= WINDOW):
                    own = words[s.bounds[d]: s.bounds[d + 1]]
                    if len(own) >= len(up):
                        up, down = powers(base, 2 * len(own)), powers(pow(base, -1, 1 << 64), 2 * len(own))
                    found.append(_pieces(own, frequent, up, down))
                    row.append(np.full(len(found[-1][0]), s.first + d))
            if not found:
                continue
            key, content, start, count = (np.concatenate(x) for x in zip(*found))
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("code").take(take), batch.column("doc_id").take(take), pa.array(key.view(np.int64)),
                 pa.array(content.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["code", "doc_id", "key", "content", "start", "count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("code", "doc_id", "text").mapInArrow(
        cut_up, f"code long, doc_id {kind}, key long, content long, start int, count int")


def _with_text(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the words of each piece; a document moves once, with the list of its pieces."""
    per_doc = wanted.groupBy("code", "doc_id").agg(F.collect_list(F.struct("key", "content", "start", "count")).alias("p"))

    def take(batches):
        for batch in batches:
            owners = batch.column("p")
            per = np.diff(owners.offsets.to_numpy())
            flat = owners.flatten()
            start, count = flat.field("start").to_numpy(), flat.field("count").to_numpy()
            before = np.r_[0, np.cumsum(per)]
            parts, sizes = [], []
            for s in slices(batch.column("text")):
                i, j = before[s.first], before[s.first + s.n_docs]
                first = np.repeat(s.bounds[:-1], per[s.first: s.first + s.n_docs]) + start[i:j]
                a, b = s.starts[first], s.ends[first + count[i:j] + WINDOW - 2]
                parts.append(s.data[ragged(a, b - a)])
                sizes.append(b - a)
            if not sizes:
                continue
            offsets = np.r_[0, np.cumsum(np.concatenate(sizes))]
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), per)))
            yield pa.RecordBatch.from_arrays(
                [flat.field("key"), flat.field("content"), doc, binaries(np.concatenate(parts), offsets)],
                ["key", "content", "doc_id", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("code", "doc_id", "text").join(per_doc, ["code", "doc_id"]).select("doc_id", "text", "p")
            .mapInArrow(take, f"key long, content long, doc_id {kind}, words binary"))


def _search_shard(table: pa.Table) -> pa.Table:
    """Build the FM-index of a shard and stream its pieces through it."""
    hasher = Hasher()
    table = table.combine_chunks()
    words, per = [], []
    for s in slices(table.column("words")):
        words.append(hasher.ranges(s.data, s.starts, s.ends))
        per.append(s.n_words)
    per = np.concatenate(per)
    number = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
    doc_ids = table.column("doc_id").to_numpy()
    starts = np.cumsum(per + 1) - (per + 1)
    text = np.zeros(int((per + 1).sum()), np.int64)
    text[ragged(starts, per)] = number
    owner = np.repeat(doc_ids, per + 1)
    least = earliest(text, owner, starts, per, WINDOW)
    ends = np.r_[0, np.cumsum(per - WINDOW + 1)]
    return pa.table({"key": table.column("key"), "content": table.column("content"),
                     "least": lists(least, ends, table.schema.field("doc_id").type)})


def _spans(batches):
    """Word ranges of the windows of a piece that an earlier document holds."""
    for batch in batches:
        column = batch.column("least")
        per = np.diff(column.offsets.to_numpy())
        least = column.flatten().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), per)
        doc = batch.column("doc_id").to_numpy()
        hit = np.r_[False, least < doc[owner], False]
        edge = np.r_[True, owner[1:] != owner[:-1], True] if len(owner) else np.ones(1, bool)
        begin = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
        end = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:]))
        row = owner[begin]
        base = np.cumsum(per) - per
        first = batch.column("start").to_numpy()[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("code").take(take), batch.column("doc_id").take(take),
             pa.array((first + begin - base[row]).astype(np.int64)),
             pa.array((first + end - base[row] + WINDOW).astype(np.int64))], ["code", "doc_id", "from", "to"])


def coded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("code", F.xxhash64(F.coalesce("text", F.lit(""))))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(code, doc_id, spans): word ranges [from, to) of each document that an earlier one holds.

    ``docs`` has doc_id, text and ``code``, the hash of the text. Documents that equal an
    earlier one are left out: see ``marked``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = frequent_runs(docs)
    known = docs.where("doc_id is not null and text is not null")
    alone = known.select("doc_id", "code", F.md5("text").alias("digest"))
    first = alone.groupBy("digest", "code").agg(F.min("doc_id").alias("doc_id")).select("code", "doc_id").distinct()
    rows = cut(pieces(known, frequent).join(first, ["code", "doc_id"], "left_semi"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    live = cut(rows.join(shared, "key", "left_semi"))
    wanted = cut(live.groupBy("key", "content").agg(F.min(F.struct("doc_id", "code", "start", "count")).alias("o"))
                 .select("key", "content", "o.*"))
    total = wanted.agg(F.sum(F.col("count") + WINDOW - 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    moved = (_with_text(wanted, known).dropDuplicates(["key", "content"])
             .withColumn("shard", F.pmod("key", F.lit(shards))))
    found = moved.groupBy("shard").applyInArrow(
        lambda _, t: _search_shard(t.select(["key", "content", "doc_id", "words"])),
        f"key long, content long, least array<{kind}>")
    hits = live.join(found, ["key", "content"]).select("code", "doc_id", "start", "least")
    spans = hits.mapInArrow(_spans, f"code long, doc_id {kind}, from long, to long")
    return spans.groupBy("code", "doc_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans`` (null: none) and ``whole``: an equal text has a smaller id."""
    docs = coded(docs)
    spans = cut(repeated_spans(docs))
    classes = (docs.where("doc_id is not null and text is not null")
               .groupBy("code", F.md5("text").alias("digest"))
               .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    keyed = docs.withColumn("digest", F.md5("text"))
    return (keyed.join(spans, ["code", "doc_id"], "left").join(classes, ["code", "digest"], "left")
            .withColumn("whole", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)))
            .drop("code", "digest", "first_id", "n"))


def _kept_mask(s, spans: list, whole: list) -> np.ndarray:
    """Which words of a slice stay."""
    removed = np.zeros(len(s.starts) + 1, np.int64)
    for d in range(s.n_docs):
        a, b = s.bounds[d], s.bounds[d + 1]
        if whole[s.first + d] and b - a >= WINDOW:
            removed[a] += 1
            removed[b] -= 1
        else:
            for span in spans[s.first + d] or ():
                removed[a + span["from"]] += 1
                removed[a + span["to"]] -= 1
    return np.cumsum(removed)[:-1] == 0


def _kept_words(batch):
    """Per document: number of words, number removed, kept words joined by one space."""
    spans, whole = batch.column("spans").to_pylist(), batch.column("whole").to_pylist()
    for s in slices(batch.column("text")):
        keep = _kept_mask(s, spans, whole)
        a, b = s.starts[keep], s.ends[keep]
        length = b - a + 1
        data = np.full(int(length.sum()), 32, np.uint8)
        at = np.cumsum(length) - length
        data[ragged(at, length - 1)] = s.data[ragged(a, b - a)]
        first = np.r_[0, np.cumsum(keep)][s.bounds]
        stop = np.r_[at, len(data)][first]
        raw = data.tobytes()
        for d in range(s.n_docs):
            n = int(s.bounds[d + 1] - s.bounds[d])
            yield n, n - int(first[d + 1] - first[d]), raw[stop[d]: max(stop[d], stop[d + 1] - 1)]


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    def count(batches):
        for batch in batches:
            rows = [(n, r, hashlib.sha256(kept).hexdigest()) for n, r, kept in _kept_words(batch)]
            n, removed, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (marked(docs.select("doc_id", "text")).select("doc_id", "text", "spans", "whole")
            .mapInArrow(count, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words: a changed text is its kept words joined by one
    space, a document that loses all its words goes, all others stay as they are."""
    names = docs.columns

    def rewrite(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, keep = [], []
            for i, (n, removed, kept) in enumerate(_kept_words(batch)):
                out.append(kept.decode("utf-8", "replace") if removed else texts[i])
                keep.append(not (removed and removed == n))
            mask = pa.array(keep, pa.bool_())
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], names)

    clash = [c for c in names if c.lower() in ("code", "digest", "spans", "whole", "first_id", "n")]
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    names = safe.columns
    out = marked(safe).select(*names, "spans", "whole").mapInArrow(rewrite, safe.schema)
    return out.withColumnsRenamed({f"_own_{c}": c for c in clash})
