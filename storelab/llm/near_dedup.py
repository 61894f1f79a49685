"""Near duplicates by one-permutation hashing with optimal densification.

A document's set holds the distinct runs of five words (lower-cased A-Z); a shorter
document has its whole word sequence as the one element. One hash function fills
``BINS`` bins; an empty bin borrows from the bin that a universal hash names, so that
every bin agrees with the similarity of the sets. ``BANDS`` bands of ``ROWS`` bins give
bucket keys.

1. Texts with equal lower-cased bytes are one class, named by its smallest id.
2. In each bucket the smallest class is the hub; star edges hub - member are confirmed on
   the full sets, so a bucket of n classes costs n - 1 pairs.
3. A bucket that still holds several components may hide a link that its star has not
   tested. The members of such buckets are compared too, family by family (a family is what
   stars join, confirmed or not): blocks of sets against blocks of sets, by the exact sizes
   of all intersections, which are sums of matrix products inside a task. A task returns at
   most one link for each two components. This work grows with the square of the open rows
   of a family, which are few: variants of one text that the stars did not join.

A pair at similarity 0.75 shares a bucket with probability 1 - (1 - 0.75**4)**32, over
0.99999. Sizes must allow the similarity, which drops pairs without reading their texts.

Defined results: a null or empty text has no shingles and is linked with nothing; rows
that share a ``doc_id`` are one node; a row without ``doc_id`` keeps a null component and
is kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.graph import components
from storelab.llm.wordkit import Hasher, Slice, binaries, group_starts, lists, mix64, parts, slices, windows
from storelab.operators.lookup import in_few_tasks, join_groups
from storelab.session import cut

SHINGLE = 5
PERCENT = 75
BINS, BANDS, ROWS = 128, 32, 4
FAMILY_BLOCK = 512
# Pairs of one hub that one task confirms.
HUB_PAIRS = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(s: Slice, hasher: Hasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    words = hasher.ranges(s.data, s.starts, s.ends, lower=True)
    codes, at = windows(words, s.bounds, SHINGLE)
    cuts = np.searchsorted(at, s.bounds)
    out = []
    for d in range(s.n_docs):
        i, j = s.bounds[d], s.bounds[d + 1]
        if j - i >= SHINGLE:
            out.append(np.unique(codes[cuts[d]: cuts[d + 1]]))
        elif j > i:
            out.append(mix64(np.array([windows(words[i:j], np.array([0, j - i]), j - i)[0][0]]) + np.uint64(j - i)))
        else:
            out.append(codes[:0])
    return out


def densified(first: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins (rows: documents) from donors named by a hash of (bin, attempt)."""
    out = first.copy()
    empty = ~filled
    open_rows = np.flatnonzero(empty.any(axis=1) & filled.any(axis=1))
    bins = np.arange(filled.shape[1], dtype=np.uint64)
    attempt = 0
    while len(open_rows):
        attempt += 1
        donor = (mix64(bins * _GOLD + np.uint64(attempt)) % np.uint64(len(bins))).astype(np.int64)
        hit = empty[open_rows] & filled[np.ix_(open_rows, donor)]
        r, b = np.nonzero(hit)
        rows = open_rows[r]
        out[rows, b] = first[rows, donor[b]]
        empty[rows, b] = False
        open_rows = open_rows[empty[open_rows].any(axis=1)]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` values per set."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    place = owner * BINS + (codes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    lead = group_starts(place)  # codes ascend within a set, so the first of a bin is its least
    first = np.zeros(len(sets) * BINS, np.uint64)
    filled = np.zeros(len(sets) * BINS, bool)
    first[place[lead]] = codes[lead]
    filled[place[lead]] = True
    return densified(first.reshape(-1, BINS), filled.reshape(-1, BINS))


def _digest(text: bytes) -> str:
    """Names the text with A-Z lower-cased; texts with the same words but other blanks meet later."""
    return hashlib.md5(text.lower()).hexdigest()


def _sign(batches):
    hasher = Hasher()
    for batch in parts(batches, 512):
        sizes, rows = [], []
        for s in slices(batch.column("text")):
            sets = shingle_sets(s, hasher)
            sizes.append([len(x) for x in sets])
            rows.append(signatures(sets))
        n = batch.num_rows
        size = np.concatenate(sizes).astype(np.int64) if n else np.zeros(0, np.int64)
        sig = np.concatenate(rows) if n else np.zeros((0, BINS), np.uint64)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (n, 1))
        for r in range(ROWS):
            keys = mix64(keys + sig[:, r::ROWS])
        digests = pa.array([_digest(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), digests, pa.array(size),
             lists(keys.ravel().view(np.int64), np.arange(n + 1) * BANDS, pa.int64())],
            ["doc_id", "digest", "n", "bands"])


def signed(docs: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(_sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                    "digest string, n long, bands array<long>")


def _sizes_allow() -> F.Column:
    return 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Only texts that occur in a pair are written and moved again. The pairs of one ``a`` are
    dealt to as many tasks as they need, ``HUB_PAIRS`` to each, and its text is copied to
    each of these, not to each pair, before the shuffle.
    """
    n = pairs.count()
    ids = cut(in_few_tasks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n))
    texts = cut(docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id", "left_semi"))
    shares = cut(in_few_tasks(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("shares")), n))
    dealt = join_groups(pairs, shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    hubs = (texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(shares, "a")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"))
    both = (dealt.select("a", "b", "share").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(hubs, ["a", "share"]))

    def check(batches):
        hasher = Hasher()
        for batch in parts(batches, 256):
            left, right = ([x for s in slices(batch.column(c)) for x in shingle_sets(s, hasher)] for c in ("ta", "tb"))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common and 100 * common >= PERCENT * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(check, f"a {kind}, b {kind}")


def _sets(texts: DataFrame, kind: str) -> DataFrame:
    """(rep, codes): the sorted shingle hashes of each text."""
    def run(batches):
        hasher = Hasher()
        for batch in parts(batches, 512):
            sets = [x for s in slices(batch.column("text")) for x in shingle_sets(s, hasher)]
            ends = np.r_[0, np.cumsum([8 * len(x) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), binaries(np.concatenate(sets).view(np.uint8), ends)], ["rep", "codes"])

    return texts.select("rep", "text").mapInArrow(run, f"rep {kind}, codes binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of two blocks of sets, by matrix products."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = often[place] > 1
    owner, place = owner[useful], np.unique(place[useful], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        i, j = np.searchsorted(place, [c, c + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[i:j], place[i:j] - c] = 1
        out += block[: len(left)] @ block[len(left):].T
    return out


def _links_of_blocks(key, table):
    """Each two components that have a link between two blocks of a family, once."""
    rows = table.to_pylist()
    first, second = key[1].as_py(), key[2].as_py()
    left = [r for r in rows if r["own"] == first]
    right = [r for r in rows if r["own"] == second]
    found: set = set()
    if left and right:
        sets = [[np.frombuffer(r["codes"], np.uint64) for r in side] for side in (left, right)]
        sizes = [np.array([len(x) for x in side], float) for side in sets]
        common = shared_counts(*sets)
        near = 100 * common >= PERCENT * (sizes[0][:, None] + sizes[1][None] - common)
        parts_of = [np.array([r["component"] for r in side]) for side in (left, right)]
        near &= parts_of[0][:, None] != parts_of[1][None]
        found = {(left[i]["component"], right[j]["component"]) for i, j in zip(*np.nonzero(near))}
    kind = table.schema.field("rep").type
    return pa.table({"a": pa.array([x for x, _ in found], kind), "b": pa.array([x for _, x in found], kind)})


def _open_links(open_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The components (a, b) that links between rows (family, rep, component) of one family join.

    The rows of a family are dealt into blocks of about ``FAMILY_BLOCK``; a task compares
    two blocks by the exact sizes of all their intersections and returns each two linked
    components once, so no pair of rows is ever a row of a table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = open_rows.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("n"))
    texts = docs.where("text is not null").select(F.col("doc_id").alias("rep"), "text")
    sets = _sets(texts.join(open_rows.select("rep"), "rep", "left_semi"), kind)
    dealt = (cut(sets).join(open_rows, "rep").join(sizes, "family")
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("family", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
                     "own", "rep", "component", "codes"))
    return dealt.groupBy("family", "first", "second").applyInArrow(_links_of_blocks, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    rows = cut(signed(docs))
    reps = cut(rows.where("n > 0 and doc_id is not null").groupBy("digest")
               .agg(F.min(F.struct("doc_id", "n", "bands")).alias("r"))
               .select("digest", F.col("r.doc_id").alias("rep"), "r.n", "r.bands"))
    members = reps.select(F.explode("bands").alias("key"), "rep", "n")
    hubs = (members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("h"), F.max("rep").alias("last"))
            .where("h.rep <> last").select("key", F.col("h.rep").alias("a"), F.col("h.n").alias("na")))
    # written, as the stars and what they leave open both read the buckets of several classes
    shared = cut(members.join(hubs, "key"))
    n = shared.count()
    starred = cut(in_few_tasks(shared.where("a <> rep").select("a", F.col("rep").alias("b"), "na", F.col("n").alias("nb")).distinct(), n))
    links = cut(confirmed(starred.where(_sizes_allow()).select("a", "b"), docs))
    found = components(links, rows=links.count())

    # what the stars have left open: members of one bucket in different components
    labelled = (shared.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left")
                .select("key", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("key"))
    still = cut(in_few_tasks(labelled.join(mixed, "key", "left_semi").select("rep", "component").distinct(), n))
    named = (reps.join(found, reps.rep == found.node, "left")
             .select("digest", F.coalesce("component", "rep").alias("component")))
    if still.count():
        # components take the place of their rows: only stars that were not confirmed join them to families
        crossing = starred.select("a", "b").join(links, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            own = found.select(F.col("node").alias(end), F.col("component").alias("c"))
            crossing = join_groups(crossing, own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        families = components(crossing, rows=n).select(F.col("node").alias("component"), F.col("component").alias("family"))
        open_rows = cut(join_groups(still, families, "component", "left")
                        .select(F.coalesce("family", "component").alias("family"), "rep", "component"))
        merged = components(_open_links(open_rows, docs), rows=n).select(F.col("node").alias("component"), F.col("component").alias("c"))
        named = join_groups(named, merged, "component", "left").select("digest", F.coalesce("c", "component").alias("component"))
    named = named.withColumnRenamed("component", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    linked = out.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                         F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest ``doc_id``.

    Rows without ``doc_id`` stay. Of rows that share a kept ``doc_id`` and have equal texts one stays.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    # a column of this name in the input would be hidden, so the name is one that no input has
    named = named.withColumn("_text_of_repeats", F.md5("text")).dropDuplicates(["doc_id", "_text_of_repeats"])
    return named.select(*docs.columns).unionAll(docs.where("doc_id is null"))
