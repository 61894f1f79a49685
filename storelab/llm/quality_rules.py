"""Quality rules: repeated words, shortness, and divergence from language references.

Each document gets a histogram of its characters by class and one of its common words.
The references are the median histograms of all documents of a language. A document is
rejected if it breaks a base rule, or if it is long enough for a stable histogram and its
Jensen-Shannon distance to every language reference is above a threshold.

Rows are measured in one pass without a shuffle; only the small histograms are written
and read again. Defined results: a null text has no words and fails the base rule; a null
or unknown ``lang`` adds to no reference and is compared with all; an empty table gives an
empty result; repeated rows are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.wordkit import Hasher, group_starts, mix64, parts, slices, windows
from storelab.session import cut

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it was on are as with be by this at from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au plus".split(),
}
WORD_LIST = sorted({w for ws in COMMON_WORDS.values() for w in ws})

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A short text has a noisy histogram: below this length there is no verdict on it, and the
# limit on a distance is FLOOR + SLACK / sqrt(n_words).
MIN_WORDS_FOR_DISTANCES = 40
CLASS_FLOOR, CLASS_SLACK = 0.15, 0.55
COMMON_FLOOR, COMMON_SLACK = 0.16, 1.2

CLASSES = ["lower", "upper", "digit", "blank", "line", "sentence", "symbol", "accented",
           "two_bytes", "three_bytes", "four_bytes", "control"]


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("control"))
    for first, last, name in ((97, 122, "lower"), (65, 90, "upper"), (48, 57, "digit"), (33, 47, "symbol"),
                              (58, 64, "symbol"), (91, 96, "symbol"), (123, 126, "symbol"), (0xC2, 0xDF, "two_bytes"),
                              (0xC3, 0xC5, "accented"), (0xE0, 0xEF, "three_bytes"), (0xF0, 0xF4, "four_bytes")):
        table[first: last + 1] = CLASSES.index(name)
    for chars, name in ((" \t\v\f", "blank"), ("\n\r", "line"), (".,;:?!'\"()-", "sentence")):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_HISTOGRAMS = "classes array<long>, common array<long>"


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _measure(batches):
    hasher, class_of = Hasher(), _class_table()
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    listed = [w.encode() for w in WORD_LIST]
    data = np.frombuffer(b"".join(listed), np.uint8)
    ends = np.cumsum([len(w) for w in listed])
    codes = hasher.ranges(data, ends - [len(w) for w in listed], ends)
    order = np.argsort(codes)
    codes, n_common = codes[order], len(listed)
    rank = order
    for batch in batches:
        found = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")}
        for s in slices(batch.column("text")):
            doc = s.doc_of_word
            lead = (s.data & 0xC0) != 0x80
            chars = np.r_[0, np.cumsum(lead, dtype=np.int64)]
            per_word = chars[s.ends] - chars[s.starts]
            found["n_words"].append(s.n_words)
            found["word_chars"].append(np.bincount(doc, per_word, s.n_docs).astype(np.int64))
            found["n_symbols"].append(_per_doc(symbol[s.data], s.offsets))
            found["n_dup_lines"].append(_duplicate_lines(s, hasher))
            words = hasher.ranges(s.data, s.starts, s.ends)
            found["n_repeat_words"].append(_repeated_words(s, words))
            owner = np.repeat(np.arange(s.n_docs), np.diff(s.offsets))[lead]
            found["classes"].append(np.bincount(owner * len(CLASSES) + class_of[s.data[lead]],
                                                minlength=s.n_docs * len(CLASSES)).reshape(s.n_docs, -1))
            low = hasher.ranges(s.data, s.starts, s.ends, lower=True)
            at = np.minimum(np.searchsorted(codes, low), n_common - 1)
            slot = np.where(codes[at] == low, rank[at], n_common)
            found["common"].append(np.bincount(doc * (n_common + 1) + slot,
                                               minlength=s.n_docs * (n_common + 1)).reshape(s.n_docs, -1))
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        for name, parts in found.items():
            wide = name in ("classes", "common")
            if not parts:
                columns.append(pa.array([], pa.list_(pa.int64()) if wide else pa.int64()))
            elif wide:
                m = np.concatenate(parts)
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), pa.int64())))
            else:
                columns.append(pa.array(np.concatenate(parts), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "text"] + list(found))


def _duplicate_lines(s, hasher: Hasher) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    breaks = np.flatnonzero(s.data == 10)
    starts = np.concatenate([s.offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(s.n_docs), np.searchsorted(s.offsets, breaks, "right") - 1])
    inside = starts < s.offsets[doc + 1]
    starts, doc = starts[inside], doc[inside]
    order = np.argsort(starts, kind="stable")
    starts, doc = starts[order], doc[order]
    if not len(starts):
        return np.zeros(s.n_docs, np.int64)
    stop = np.searchsorted(breaks, starts)
    ends = np.minimum(np.r_[breaks, len(s.data)][stop], s.offsets[doc + 1])
    has_word = np.searchsorted(s.starts, starts) < np.searchsorted(s.starts, ends)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    code = hasher.ranges(s.data, starts, ends)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[again], minlength=s.n_docs)


def _repeated_words(s, words: np.ndarray, size: int = 5) -> np.ndarray:
    """Words inside windows of ``size`` words that occur more than once in the document."""
    codes, at = windows(words, s.bounds, size)
    doc = s.doc_of_word
    codes = mix64(codes + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else codes
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = group_starts(ordered)
    size_of = np.diff(np.r_[first, len(ordered)])
    hit = at[order[np.repeat(size_of > 1, size_of)]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(doc[covered], minlength=s.n_docs)


def measures(docs: DataFrame) -> DataFrame:
    """``text`` replaced by the base measures and the two histograms; other columns stay."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [MEASURES, _HISTOGRAMS])
    return docs.mapInArrow(_measure, schema)


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Median class and common-word shares per listed language, over all its documents.

    Medians, as junk must not shape a reference; they come from a sketch of bounded size.
    At most one row per language of ``COMMON_WORDS`` reaches the driver.
    """
    def shares(column: str, size: int):
        total = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return [F.coalesce(F.percentile_approx(F.when(total > 0, F.element_at(column, i + 1) / total), 0.5, 1000),
                           F.lit(0.0))
                for i in range(size)]

    listed = measured.where(F.col("lang").isin(*COMMON_WORDS)).where(f"n_words >= {MIN_WORDS}")
    rows = (listed.groupBy("lang").agg(F.array(*shares("classes", len(CLASSES))).alias("a"),
                                       F.array(*shares("common", len(WORD_LIST) + 1)).alias("b")).collect())
    return {r.lang: (list(r.a), list(r.b)) for r in rows}


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, square root) of each row of counts to a reference."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = reference / max(reference.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judged(measured: pa.RecordBatch, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class distance, common-word distance, base failure and verdict of each row."""
    n = measured.num_rows
    a = measured.column("classes").flatten().to_numpy().reshape(n, len(CLASSES))
    b = measured.column("common").flatten().to_numpy().reshape(n, len(WORD_LIST) + 1)
    words = measured.column("n_words").to_numpy()
    by_class = np.min([distances(a, x) for x, _ in tables], axis=0) if tables else np.zeros(n)
    by_common = np.min([distances(b, y) for _, y in tables], axis=0) if tables else np.zeros(n)
    by_class, by_common = (np.where(words >= MIN_WORDS_FOR_DISTANCES, x, 0.0) for x in (by_class, by_common))
    failed = (words < MIN_WORDS) | (100 * measured.column("n_repeat_words").to_numpy() > MAX_REPEAT_PERCENT * words)
    root = np.sqrt(np.maximum(words, 1))
    near = (by_class <= CLASS_FLOOR + CLASS_SLACK / root) & (by_common <= COMMON_FLOOR + COMMON_SLACK / root)
    return by_class, by_common, failed, ~failed & near


def _tables(refs: dict[str, tuple[list[float], list[float]]]) -> list:
    return [(np.array(a), np.array(b)) for a, b in refs.values() if sum(a) > 0 and sum(b) > 0]


def verdicts(measured: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Add ``class_distance``, ``common_distance``, ``base_failed`` and ``kept``."""
    fields = [f for f in measured.schema.fields if f.name not in ("classes", "common")]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["class_distance double, common_distance double, base_failed boolean, kept boolean"])
    tables = _tables(refs)

    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x) for x in judged(batch, tables)],
                                             names + ["class_distance", "common_distance", "base_failed", "kept"])

    return measured.mapInArrow(judge, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, unchanged; rows are measured twice and never moved."""
    tables = _tables(references(cut(measures(docs.select("doc_id", "lang", "text")))))

    def keep(batches):
        for batch in parts(batches, 2048):
            for measured in _measure([batch.select(["text"])]):
                yield batch.filter(pa.array(judged(measured, tables)[3], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document (columns ``doc_id``, ``lang``, ``text``)."""
    measured = cut(measures(docs.select("doc_id", "lang", "text")))
    return verdicts(measured, references(measured)).drop("lang")
