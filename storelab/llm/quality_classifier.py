"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding and one flag: whether the six bytes from here occurred up
to ``MAX_LAG`` bytes before. Filters of ``WIDTH`` bytes slide over the whole document in
steps of ``STRIDE``; overlapping chunks of ``CHUNK`` filter places are max-pooled; the
largest and the mean of the chunk maxima go through one logistic unit.

The network is trained in one task on a bounded sample of labelled rows: the
``SAMPLE_ROWS`` rows with the least hash, as far as they hold ``SAMPLE_BYTES`` bytes. A text
of more than a ``SPREAD``-th of that counts with ``SPREAD`` chunks spread over its length.
Every document is scored whole, in slices of bounded size. Labels, language, source and
``doc_id`` are no inputs of a score.

Defined results: a null or empty text has no chunks and the score of the bias; without any
training row all scores are 0.5; labels other than 0 and 1, null labels and labels of
unknown documents are not used; a document labelled twice is trained on twice; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelab.llm.wordkit import ragged, texts_of, parts

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 24 << 20
SPREAD = 16
THRESHOLD = 0.3
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
CHUNK, CHUNK_STEP = 128, 112
MAX_LAG = 48
EPOCHS, LEAST_STEPS, BATCH, RATE = 5, 400, 64, 0.01
SLICE_BYTES = 1 << 19


def padded(data: np.ndarray, offsets: np.ndarray):
    """The documents with zeros between them, the filter places of each, and their chunks.

    Returns the buffer, the first filter place and number of places of each chunk, and the
    document of each chunk.
    """
    size = np.diff(offsets)
    places = -(-size // STRIDE)
    room = (places + WIDTH // STRIDE) * STRIDE
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()) + WIDTH, np.uint8)
    out[ragged(begin, size)] = data
    n_chunks = np.where(places > 0, 1 + np.maximum(0, -(-(places - CHUNK) // CHUNK_STEP)), 0)
    doc = np.repeat(np.arange(len(size)), n_chunks)
    start = ragged(np.zeros(len(size), np.int64), n_chunks) * CHUNK_STEP
    return out, begin[doc] // STRIDE + start, np.minimum(places[doc] - start, CHUNK), doc


def repeat_flags(data: np.ndarray) -> np.ndarray:
    """1 where six bytes equal those a short way before."""
    n = len(data) - 5
    if n <= 0:
        return np.zeros(len(data), np.float32)
    code = np.zeros(n, np.uint32)
    for k in range(6):
        code = code * np.uint32(0x01000193) + data[k: k + n]
    found = np.zeros(n, bool)
    for lag in range(2, MAX_LAG + 1):
        found[lag:] |= code[lag:] == code[:-lag]
    found &= data[:n] != 0
    return np.r_[found, np.zeros(5, bool)].astype(np.float32)


def channels(model: dict, data: np.ndarray) -> np.ndarray:
    x = np.empty((len(data), EMBED + 1), np.float32)
    x[:, :EMBED] = model["embed"][data]
    x[:, EMBED] = repeat_flags(data)
    return x


def _filtered(model: dict, x: np.ndarray) -> np.ndarray:
    """Output of the filters at every place."""
    flat, wide = x.ravel(), WIDTH * (EMBED + 1)
    n = (len(x) - WIDTH) // STRIDE + 1
    rows = np.lib.stride_tricks.as_strided(flat, (n, wide), (STRIDE * (EMBED + 1) * 4, 4), writeable=False)
    out = np.empty((n, FILTERS), np.float32)
    for i in range(0, n, 16384):
        out[i: i + 16384] = np.ascontiguousarray(rows[i: i + 16384]) @ model["filters"] + model["shift"]
    return out


def pooled(model: dict, data: np.ndarray, offsets: np.ndarray):
    """Features of each document (largest and mean chunk maximum) and what training needs."""
    buffer, first, size, doc = padded(data, offsets)
    n_docs = len(offsets) - 1
    features = np.zeros((n_docs, 2 * FILTERS), np.float32)
    if not len(doc):
        return features, None
    x = channels(model, buffer)
    values = _filtered(model, x)
    step = np.arange(CHUNK)
    best = np.empty((len(doc), FILTERS), np.int64)
    top = np.empty((len(doc), FILTERS), np.float32)
    for i in range(0, len(doc), 256):
        place = first[i: i + 256, None] + np.minimum(step, size[i: i + 256, None] - 1)
        block = values[place]
        at = block.argmax(axis=1)
        top[i: i + 256] = np.take_along_axis(block, at[:, None, :], 1)[:, 0]
        best[i: i + 256] = np.take_along_axis(place, at, 1)
    top = np.maximum(top, 0)
    lead = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    own = doc[lead]
    count = np.diff(np.r_[lead, len(doc)])
    features[own, :FILTERS] = np.maximum.reduceat(top, lead)
    features[own, FILTERS:] = np.add.reduceat(top, lead) / count[:, None]
    return features, (buffer, x, doc, top, best, np.bincount(doc, minlength=n_docs))


def scores(model: dict, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ model["weights"] + model["bias"], -30, 30)))


def _gradients(model: dict, data, offsets, labels) -> dict:
    features, state = pooled(model, data, offsets)
    error = ((scores(model, features) - labels) / len(labels)).astype(np.float32)
    grads = {"weights": features.T @ error, "bias": np.array(error.sum(), np.float32)}
    if state is None:
        return grads
    buffer, x, doc, top, best, count = state
    back = error[doc, None] * model["weights"][None]
    is_top = top == features[doc, :FILTERS]
    g = (back[:, :FILTERS] * is_top + back[:, FILTERS:] / np.maximum(count[doc], 1)[:, None]) * (top > 0)
    place = best[:, :, None] * STRIDE + np.arange(WIDTH)
    seen = x[place]
    grads["filters"] = np.einsum("ck,ckwd->wdk", g, seen).reshape(-1, FILTERS)
    grads["shift"] = g.sum(axis=0)
    kernel = model["filters"].reshape(WIDTH, EMBED + 1, FILTERS)
    into = np.einsum("ck,wdk->ckwd", g, kernel[:, :EMBED])
    bytes_seen = buffer[place].ravel()
    grads["embed"] = np.stack([np.bincount(bytes_seen, into[..., d].ravel(), 256) for d in range(EMBED)], 1).astype(np.float32)
    grads["embed"][0] = 0  # the byte between documents
    return grads


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> dict:
    """Train by Adam on log loss; deterministic for a given order of rows."""
    rng = np.random.default_rng(seed)
    wide = WIDTH * (EMBED + 1)
    model = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
             "filters": rng.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)).astype(np.float32),
             "shift": np.zeros(FILTERS, np.float32), "weights": np.zeros(2 * FILTERS, np.float32),
             "bias": np.array(0, np.float32)}
    model["embed"][0] = 0
    if not len(texts):
        return model
    share = np.clip(labels.mean(), 0.01, 0.99)
    model["bias"] = np.array(np.log(share / (1 - share)), np.float32)
    model["weights"] = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    t = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(texts), BATCH)))  # few rows are seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i: i + BATCH]
            data = np.frombuffer(b"".join(texts[j] for j in own), np.uint8)
            offsets = np.r_[0, np.cumsum([len(texts[j]) for j in own])]
            t += 1
            rate = RATE * (0.3 if epoch >= 0.6 * epochs else 1.0)
            for k, g in _gradients(model, data, offsets, labels[own]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of the labelled rows with the least hash, bounded in rows and bytes.

    A text too long for its share of the bytes is replaced by chunks from its start to its end,
    so that no text uses up the bound.
    """
    share = size // SPREAD
    chars = max(1, share // (4 * SPREAD))  # a character has at most four bytes
    chunks = F.concat(*[F.expr(f"substring(text, cast(1 + floor({k} * (char_length(text) - {chars}) / {SPREAD - 1}) as int), {chars})")
                        for k in range(SPREAD)])
    docs = docs.select("doc_id", F.when(F.octet_length("text") > share, chunks).otherwise(F.col("text")).alias("text"))
    usable = (labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
              .where(~held_out()))
    key = F.xxhash64("doc_id")
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    least = usable.join(sizes, "doc_id").orderBy(key, "doc_id", "label").limit(rows)
    so_far = F.sum("size").over(Window.orderBy(key, "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0))
    chosen = least.withColumn("so_far", so_far).where(F.col("so_far") <= size).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def trained(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, fitted in one task on the bounded sample."""
    def run(batches):
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist())]
        rows.sort(key=lambda r: (r[0], r[2], r[1] or ""))
        model = fit([(r[1] or "").encode() for r in rows], np.array([r[2] for r in rows], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = training_sample(docs, labels).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit([], np.zeros(0, np.float32))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    def run(batches):
        for batch in parts(batches, 512):
            data, offsets = texts_of(batch.column("text"))
            out, i = [], 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
                j = min(j, batch.num_rows)
                out.append(scores(model, pooled(model, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])[0]))
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array(np.concatenate(out).astype(np.float64))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return (rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels, score every document."""
    return scored(docs, trained(docs, labels))
