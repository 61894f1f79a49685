"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A change is an insert, a delete or a revised count of one document under one tokenizer
version. A batch of changes is summed to one signed delta per group before anything is
shuffled further. A commit writes the deltas to a folder that no other commit uses and then
appends one row to the manifest; that row is the commit. A job that died before it leaves
files that nothing reads, and can simply be run again; a batch id that is already in the
manifest is not committed again, and of two commits that raced only the first by name
counts. ``compacted`` writes some batches as one and says in its manifest row which ones it
replaces, so totals never count both. Nothing committed is ever overwritten.

Defined results: a null source, language or count is a group of its own or 0; a change
without a known kind adds nothing; a group whose documents are all deleted stays with zeros; repeated rows
are separate changes; an empty batch commits no groups; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelab.llm.tokens import WORD_TOKENIZER, WordEncoder
from storelab.llm.wordkit import slices
from storelab.sources.store import table_exists

GROUP = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str = WORD_TOKENIZER) -> DataFrame:
    """The columns of ``docs`` without text, and ``n_words`` and ``n_ids`` of the whole text,
    which replace columns of these names."""
    names = [c for c in docs.columns if c not in ("text", "n_words", "n_ids")]

    def count(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            words, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in slices(batch.column("text")):
                words.append(s.n_words)
                ids.append(encoder.counts(s))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [
                pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(ids), pa.int64())],
                names + ["n_words", "n_ids"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[f"`{c}`" for c in names], "text").mapInArrow(count, f"{kept}, n_words long, n_ids long")


def changes(rows: DataFrame, kind: str, tokenizer: str, n_tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Change rows (kind, source, lang, tokenizer, n_tokens, old_tokens) of documents."""
    return rows.select(F.lit(kind).alias("kind"), F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.lit(tokenizer).alias("tokenizer"), n_tokens.cast("bigint").alias("n_tokens"),
                       (F.lit(None) if old_tokens is None else old_tokens).cast("bigint").alias("old_tokens"))


def deltas(batch: DataFrame) -> DataFrame:
    """One signed row per group of a batch of changes."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    tokens = (F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -new)
              .when(F.col("kind") == "revise", new - old).otherwise(0))
    return batch.groupBy(*GROUP).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))


MANIFEST = "batch string, place string, replaces array<string>"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that count: batch, place, replaces."""
    manifest = f"{folder}/manifest"
    if not table_exists(spark, manifest):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(manifest)
    return rows.groupBy("batch").agg(F.min(F.struct("place", "replaces")).alias("first")).select("batch", "first.*")


def _commit(made: DataFrame, folder: str, batch_id: str, replaces: Sequence[str] = ()) -> None:
    spark = made.sparkSession
    if committed(spark, folder).where(F.col("batch") == batch_id).limit(1).count():
        return
    place = f"data/{uuid.uuid4().hex}"
    made.write.parquet(f"{folder}/{place}")
    row = spark.range(1).select(F.lit(batch_id).alias("batch"), F.lit(place).alias("place"),
                                F.array(*[F.lit(r) for r in replaces]).cast("array<string>").alias("replaces"))
    row.write.mode("append").parquet(f"{folder}/manifest")


def commit(batch: DataFrame, folder: str, batch_id: str) -> None:
    """Commit a batch of changes under its id; a second commit of the id changes nothing."""
    _commit(deltas(batch), folder, batch_id)


def totals(spark: SparkSession, folder: str, batch_ids: Sequence[str] | None = None) -> DataFrame:
    """Sums over the committed batches, or those named: source, lang, tokenizer, n_docs, n_tokens.

    A batch that a counted compaction replaces is not counted beside it.
    """
    # one row per batch; compaction keeps them few
    known = {r.batch: r for r in committed(spark, folder).collect()}
    wanted = list(known) if batch_ids is None else list(dict.fromkeys(batch_ids))
    lost = [b for b in wanted if b not in known]
    if lost:
        raise ValueError(f"not committed: {', '.join(lost)}")
    replaced = {b for w in wanted for b in known[w].replaces or []}
    places = [f"{folder}/{known[b].place}" for b in wanted if b not in replaced]
    rows = spark.read.schema(DELTA).parquet(*places) if places else spark.createDataFrame([], DELTA)
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def compacted(spark: SparkSession, folder: str, batch_ids: Sequence[str], into: str) -> None:
    """Commit the totals of some batches as one batch that replaces them."""
    known = {r.batch: r for r in committed(spark, folder).collect()}
    inner = {b for w in batch_ids if w in known for b in known[w].replaces or []}
    _commit(totals(spark, folder, batch_ids), folder, into, sorted({*batch_ids, *inner}))
