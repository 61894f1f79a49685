"""Language-model scores by Katz backoff over words.

Tokens are the lower-cased (A-Z) words of a text and one end. Unigrams and bigrams of the
training documents are counted over the whole corpus; counts up to ``MAX_DISCOUNTED`` are
discounted by Good-Turing, the freed mass goes to one unknown word (unigrams) or to the
words unseen after a context, in proportion to their unigram probability (bigrams). The
backoff weight of a context is computed from all its successors, so each distribution sums
to one. Every context seen in training (``MIN_CONTEXT`` = 1 time or more) stores its bigrams;
only one never seen there backs off with weight one. A token is evaluated by its bigram or
else recursively by its unigram.

How the counts move. Documents are encoded once into blocks: a sorted dictionary of word
hashes and local numbers of the tokens. A block asks each hash range of a table once for
its distinct words or bigrams, adding its own training counts; the task of a range sums
the counts of all blocks, which is the table of that range, and answers each block in the
order asked. So every distinct entry of a block moves once each way, in compressed columns,
and no task holds more than a range. A context whose words are more than a share of all
tokens is split over several ranges by the following word; at most ``MAX_SPLIT`` contexts
are, whose sums go to all tasks.

Defined results: a null or empty text has the end only; a row without ``doc_id`` is used
for training; repeated rows count repeatedly; without training tokens all scores are those
of an unknown word; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.wordkit import Hasher, group_starts, mix64, parts, slices
from storelab.session import cut

MAX_DISCOUNTED = 5
MIN_CONTEXT = 1  # a higher number would prune counts
BLOCK_BYTES = 6 << 20
RANGE_WORDS = 2_000_000
RANGE_PAIRS = 800_000
SPLIT_LEAST = 500_000
MAX_SPLIT = 20_000
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x27BB2EE687B0B0FD)
# bits of a hash that a bigram's word and a context need not carry inside one range
_DROP, _DROP_CONTEXT = np.uint64(24), np.uint64(16)


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as bytes, compressed by byte place."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(a) else b"")


def expand(raw: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(raw[:8], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def squeeze_rising(a: np.ndarray) -> bytes:
    """``squeeze`` of the steps between numbers, which are small if the numbers rise."""
    return squeeze(np.diff(a, prepend=np.zeros(1, a.dtype)))


def expand_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint64), dtype=np.uint64)


def _by_frequency(trained: np.ndarray) -> np.ndarray:
    """Local numbers, most frequent first; places in it are small numbers, which compress well."""
    return np.argsort(-trained.astype(np.int64), kind="stable")


def _narrow(n: int):
    """The smallest unsigned type for numbers below n."""
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a hash; ascending hashes have ascending ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: ids, held-out flags, sizes, dictionary, training counts and tokens."""
    kind = docs.schema["doc_id"].dataType

    def encode(batches):
        hasher, held, number = Hasher(), [], 0
        words, sizes, ids, flags, size = [], [], [], [], 0

        def block():
            n = np.concatenate(sizes)
            ends = np.cumsum(n)
            tokens = np.insert(np.concatenate(words), ends, END)
            n = n + 1
            flag = np.concatenate(flags)
            dictionary, local = np.unique(np.r_[tokens, START], return_inverse=True)
            local = local[:-1].astype(np.uint32)
            trained = np.bincount(local[np.repeat(~flag, n)], minlength=len(dictionary)).astype(np.uint32)
            rank = np.empty(len(dictionary), np.uint32)
            rank[_by_frequency(trained)] = np.arange(len(dictionary))
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 24) + number], pa.int64()),
                 pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([flag.tolist()], pa.list_(pa.bool_())),
                 *[pa.array([x], pa.binary()) for x in (squeeze(n.astype(np.uint32)), squeeze_rising(dictionary),
                                                        squeeze(trained), squeeze(rank[local]))],
                 pa.array([len(local)], pa.int64()), pa.array([len(dictionary)], pa.int64())],
                ["block", "doc_ids", "held", "sizes", "words", "trained", "tokens", "n_tokens", "n_words"])

        for batch in batches:
            for s in slices(batch.column("text")):
                words.append(hasher.ranges(s.data, s.starts, s.ends, lower=True))
                sizes.append(s.n_words)
                ids.append(batch.column("doc_id").slice(s.first, s.n_docs))
                flags.append(batch.column("held").slice(s.first, s.n_docs).to_numpy(zero_copy_only=False))
                size += len(s.data) + 64 * s.n_docs
                if size >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    words, sizes, ids, flags, size = [], [], [], [], 0
        if sizes:
            yield block()

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(
        encode, f"block long, doc_ids array<{kind.simpleString()}>, held array<boolean>, sizes binary, words binary, "
                "trained binary, tokens binary, n_tokens long, n_words long")


def count_words(made: DataFrame, ranges: int) -> DataFrame:
    """Answers (block, part, counts) of the word table; block -1 has the totals of a range.

    The totals are the number of tokens, of distinct words, and of words seen 1 to 6 times.
    """
    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, trained = expand_rising(batch.column("words")[i].as_py()), expand(batch.column("trained")[i].as_py(), np.uint32)
                part = _range_of(words, ranges)
                first = group_starts(part)
                for a, b in zip(first, np.r_[first[1:], len(part)]):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("block").slice(i, 1), pa.array([part[a]], pa.int64()),
                         pa.array([squeeze_rising(words[a:b])], pa.binary()), pa.array([squeeze(trained[a:b])], pa.binary())],
                        ["block", "part", "words", "trained"])

    def answer(key, table):
        words = [expand_rising(x) for x in table.column("words").to_pylist()]
        trained = [expand(x, np.uint32) for x in table.column("trained").to_pylist()]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate(trained), len(distinct)).astype(np.uint64)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        often = np.bincount(np.minimum(total, MAX_DISCOUNTED + 2).astype(np.int64), minlength=MAX_DISCOUNTED + 3)
        totals = np.r_[total.sum(), (total > 0).sum(), often[1: MAX_DISCOUNTED + 2]].astype(np.uint64)
        blobs = [squeeze(total[p].astype(np.uint64)) for p in np.split(place, cuts)] + [squeeze(totals)]
        return pa.table({"block": pa.array(table.column("block").to_pylist() + [-1], pa.int64()),
                         "part": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "counts": pa.array(blobs, pa.binary())})

    return (made.select("block", "words", "trained").mapInArrow(ask, "block long, part long, words binary, trained binary")
            .groupBy("part").applyInArrow(answer, "block long, part long, counts binary"))


def discounts(often: np.ndarray) -> np.ndarray:
    """Good-Turing factors d[1..k] from the numbers n[1..k+1] of items seen 1 to k + 1 times.

    Where the counts are too thin for a factor between 0 and 1, (r - 0.5) / r stands in.
    """
    k = MAX_DISCOUNTED
    n = np.r_[0.0, np.asarray(often, float)]
    out = np.ones(k + 1)
    high = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = -1.0
        if n[r] and high < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - high) / (1 - high)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    c = counts.astype(float)
    return c * np.where(counts <= MAX_DISCOUNTED, factors[np.minimum(counts, MAX_DISCOUNTED).astype(np.int64)], 1.0)


class Model:
    """The few numbers that all tasks share."""

    def __init__(self, totals: np.ndarray, n_docs: int):
        self.n, self.v, self.often = int(totals[0]), int(totals[1]), totals[2:]
        self.words = discounts(self.often)
        self.n_docs = n_docs
        freed = sum(r * n * (1 - self.words[r]) for r, n in enumerate(self.often[:MAX_DISCOUNTED].tolist(), 1))
        self.unknown = freed / self.n if self.n else 1.0
        self.split = max(SPLIT_LEAST, self.n // MAX_SPLIT)
        self.pairs = np.ones(MAX_DISCOUNTED + 1)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(word) by training count; the unknown word for 0."""
        return np.where(counts > 0, discounted(counts, self.words) / max(self.n, 1), self.unknown)


def _block(row, counts) -> dict:
    """Arrays of one block with the training count of each of its words."""
    words = expand_rising(row["words"])
    total = np.concatenate([expand(x["counts"], np.uint64) for x in sorted(counts, key=lambda x: x["part"])])
    tokens = _by_frequency(expand(row["trained"], np.uint32))[expand(row["tokens"], np.uint32)]
    sizes = expand(row["sizes"], np.uint32).astype(np.int64)
    context = np.r_[0, tokens[:-1]]
    context[np.cumsum(sizes) - sizes] = np.searchsorted(words, START)
    return {"words": words, "count": total, "tokens": tokens, "sizes": sizes, "context": context,
            "held": np.array(row["held"], bool)}


def _asked(b: dict, model: Model, ranges: int) -> tuple[np.ndarray, ...]:
    """The distinct bigrams of a block in the order in which they are asked for.

    Returns context, word (local numbers) and range of each, the place of each token's
    bigram (-1: its context was not seen), the training counts here, and which contexts are split.
    """
    start = int(np.searchsorted(b["words"], START))
    seen = b["count"].copy()
    seen[start] = model.n_docs
    stored = seen[b["context"]] >= MIN_CONTEXT
    code = b["context"] * len(b["words"]) + b["tokens"]
    distinct, place = np.unique(code[stored], return_inverse=True)
    context, word = distinct // len(b["words"]), distinct % len(b["words"])
    pieces = (seen[context] + np.uint64(model.split) - np.uint64(1)) // np.uint64(model.split)
    piece = np.where(pieces > 1, (b["words"][word] >> np.uint64(44)) % np.maximum(pieces, 1), 0)
    part = _range_of(mix64(b["words"][context] + piece * np.uint64(0x9E3779B97F4A7C15)), ranges)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of_token = np.full(len(code), -1, np.int64)
    of_token[stored] = rank[place]
    trained = np.repeat(~b["held"], b["sizes"])[stored]
    n = np.bincount(place[trained], minlength=len(distinct))
    return context[order], word[order], part[order], of_token, n[order], (pieces > 1)[order]


def _runs(part: np.ndarray, context: np.ndarray):
    """Slices of equal range, and the first bigram of each context in them."""
    first = group_starts(part)
    for a, b in zip(first.tolist(), np.r_[first[1:], len(part)].tolist()):
        yield a, b, group_starts(context[a:b])


def count_pairs(made: DataFrame, model: Model, ranges: int) -> DataFrame:
    """Answers of the bigram table: (block, part, counts, contexts, backing).

    ``contexts`` has six numbers per context, in the order asked: its tokens and its
    successors seen 1 to 5 times; ``backing`` the unigram mass of its successors. Block -1
    has the bigrams seen 1 to 6 times in a range, block -2 the contexts that are split.
    """
    def ask(batches):
        for batch in batches:
            for row in (r for b in parts([batch], 1) for r in b.to_pylist()):
                b = _block(row, row["answers"])
                context, word, part, _, n, split = _asked(b, model, ranges)
                for i, j, first in _runs(part, context):
                    own = context[i:j]
                    # each word of the range is sent once, its bigrams send its place
                    known, place = np.unique(word[i:j], return_inverse=True)
                    blobs = (squeeze_rising(b["words"][own[first]] >> _DROP_CONTEXT),
                             squeeze(np.diff(np.r_[first, j - i]).astype(np.uint32)),
                             squeeze_rising(b["words"][known] >> _DROP), squeeze(place.astype(_narrow(len(known)))),
                             squeeze(n[i:j].astype(np.uint32)), squeeze(b["count"][known]),
                             squeeze(split[i:j][first].astype(np.uint8)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]], pa.int64()), pa.array([part[i]], pa.int64())]
                        + [pa.array([x], pa.binary()) for x in blobs],
                        ["block", "part", "contexts", "sizes", "words", "places", "trained", "backing", "split"])

    def answer(key, table):
        get = lambda name, kind: [expand(x, kind) for x in table.column(name).to_pylist()]
        contexts, known = ([expand_rising(x) for x in table.column(name).to_pylist()] for name in ("contexts", "words"))
        sizes, counts = get("sizes", np.uint32), get("backing", np.uint64)
        places = [expand(x, _narrow(len(k))) for x, k in zip(table.column("places").to_pylist(), known)]
        words = [k[p] for k, p in zip(known, places)]
        names = np.concatenate(contexts)
        size = np.concatenate(sizes).astype(np.int64)
        named, of_context = np.unique(names, return_inverse=True)
        context = np.repeat(of_context, size)
        code = mix64(named[context] * np.uint64(0x9E3779B97F4A7C15) + np.concatenate(words))
        _, first, place = np.unique(code, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(get("trained", np.uint32)), len(first)).astype(np.int64)
        backing = model.unigram(np.concatenate([c[p] for c, p in zip(counts, places)])[first])
        own = context[first]
        tokens = np.bincount(own, total, len(named)).astype(np.int64)
        seen = [np.bincount(own[total == r], minlength=len(named)) for r in range(1, MAX_DISCOUNTED + 1)]
        stats = np.stack([tokens, *seen], 1).astype(np.uint32)
        mass = np.bincount(own, np.where(total > 0, backing, 0.0), len(named))
        pair_cuts = np.cumsum([len(w) for w in words])[:-1]
        context_cuts = np.cumsum([len(c) for c in contexts])[:-1]
        out = [(k, squeeze(total[p].astype(np.uint32)), squeeze(stats[c].ravel()), squeeze(mass[c])) for k, p, c in zip(
            table.column("block").to_pylist(), np.split(place, pair_cuts), np.split(of_context, context_cuts))]
        often = np.bincount(np.minimum(total, MAX_DISCOUNTED + 2), minlength=MAX_DISCOUNTED + 3)[1: MAX_DISCOUNTED + 2]
        out.append((-1, squeeze(often.astype(np.uint64)), None, None))
        large = np.unique(of_context[np.concatenate(get("split", np.uint8)) > 0])
        out.append((-2, squeeze(named[large]), squeeze(stats[large].ravel()), squeeze(mass[large])))
        block, counts, context_stats, masses = zip(*out)
        return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "counts": pa.array(counts, pa.binary()), "contexts": pa.array(context_stats, pa.binary()),
                         "backing": pa.array(masses, pa.binary())})

    return (made.mapInArrow(ask, "block long, part long, contexts binary, sizes binary, words binary, places binary, "
                           "trained binary, backing binary, split binary")
            .groupBy("part").applyInArrow(answer, "block long, part long, counts binary, contexts binary, backing binary"))


def backoff(stats: np.ndarray, mass: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the seen bigrams and weight of the unigrams for contexts (rows of ``stats``).

    A context all of whose successors are frequent frees no mass; it then keeps half a
    count of ``tokens`` + 1 free, and its seen bigrams are scaled down by as much.
    """
    tokens = stats[:, 0].astype(float)
    freed = sum(stats[:, r] * r * (1 - factors[r]) for r in range(1, MAX_DISCOUNTED + 1)) / np.maximum(tokens, 1)
    free = np.maximum(freed, 0.5 / (tokens + 1))
    scale = (1 - free) / np.maximum(1 - freed, 1e-300)
    weight = free / np.maximum(1 - mass, 1e-300)
    unused = tokens == 0
    return np.where(unused, 1.0, scale), np.where(unused, 1.0, weight)


def scored(made: DataFrame, model: Model, split: dict, ranges: int, kind: str) -> DataFrame:
    """Scores of the documents of blocks that hold the answers of both tables."""
    split_names = np.array(sorted(split), np.uint64)
    split_stats = np.array([split[int(x)][0] for x in split_names.tolist()], np.int64).reshape(-1, MAX_DISCOUNTED + 1)
    split_mass = np.array([split[int(x)][1] for x in split_names.tolist()], float)

    def run(batches):
        base_unit = model.n + 0.5 * (model.v + 1)
        for batch in batches:
            for row in (r for b in parts([batch], 1) for r in b.to_pylist()):
                b = _block(row, row["answers"])
                context, word, part, of_token, _, divided = _asked(b, model, ranges)
                answers = sorted(row["pairs"] or [], key=lambda x: x["part"])
                c = b["count"][b["tokens"]]
                p = model.unigram(c)
                if len(part):
                    total = np.concatenate([expand(x["counts"], np.uint32) for x in answers]).astype(np.int64)
                    stats = np.concatenate([expand(x["contexts"], np.uint32) for x in answers]).reshape(-1, MAX_DISCOUNTED + 1).astype(np.int64)
                    mass = np.concatenate([expand(x["backing"], np.float64) for x in answers])
                    lead = np.concatenate([a + first for a, _, first in _runs(part, context)])
                    name = b["words"][context[lead]] >> _DROP_CONTEXT
                    if len(split_names):
                        at = np.minimum(np.searchsorted(split_names, name), len(split_names) - 1)
                        hit = divided[lead] & (split_names[at] == name)
                        stats[hit], mass[hit] = split_stats[at[hit]], split_mass[at[hit]]
                    scale, weight = backoff(stats, mass, model.pairs)
                    owner = np.cumsum(np.bincount(lead, minlength=len(part))) - 1
                    use = of_token >= 0
                    pair = of_token[use]
                    o = owner[pair]
                    seen = discounted(total[pair], model.pairs) / np.maximum(stats[o, 0], 1) * scale[o]
                    p[use] = np.where(total[pair] > 0, seen, weight[o] * p[use])
                first = np.cumsum(b["sizes"]) - b["sizes"]
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(b["held"]), pa.array(b["sizes"]),
                     pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(first), model.n)),
                     pa.array(add(np.log10((c + 0.5) / base_unit))), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return made.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def _with(made: DataFrame, answers: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Add the answers to their blocks."""
    own = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", *columns)).alias(name))
    return made.join(own, "block", "left")


def _split_contexts(answers: DataFrame, model: Model) -> dict:
    """Sums of the contexts that are split, by hash: at most ``MAX_SPLIT``, each in a few parts."""
    found: dict = {}
    for r in answers.where("block = -2").collect():
        names, stats = expand(bytes(r["counts"]), np.uint64), expand(bytes(r["contexts"]), np.uint32).reshape(-1, MAX_DISCOUNTED + 1)
        for name, s, m in zip(names.tolist(), stats.astype(np.int64), expand(bytes(r["backing"]), np.float64)):
            old = found.get(name)
            found[name] = (s, m) if old is None else (old[0] + s, old[1] + m)
    return found


def language_scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = cut(blocks(docs))
    sizes = made.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w"),
                     F.sum(F.expr("size(filter(held, x -> not x))")).alias("d")).first()
    word_ranges, pair_ranges = (max(1, -(-(n or 0) // k)) for n, k in ((sizes.w, RANGE_WORDS), (sizes.t, RANGE_PAIRS)))
    words = cut(count_words(made, word_ranges))
    totals = [expand(bytes(r.counts), np.uint64) for r in words.where("block = -1").select("counts").collect()]
    model = Model(np.sum(totals, axis=0) if totals else np.zeros(MAX_DISCOUNTED + 3, np.uint64), sizes.d or 0)
    known = _with(made.drop("n_tokens", "n_words"), words, "answers", ["counts"])
    pairs = cut(count_pairs(known.drop("doc_ids"), model, pair_ranges))
    often = [expand(bytes(r.counts), np.uint64) for r in pairs.where("block = -1").select("counts").collect()]
    model.pairs = discounts(np.sum(often, axis=0)) if often else model.pairs
    split = _split_contexts(pairs, model)
    both = _with(known, pairs, "pairs", ["counts", "contexts", "backing"])
    return scored(both, model, split, pair_ranges, kind)
