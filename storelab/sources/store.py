"""Readers and writers: listing files, cached tables, predictions, scoreboards, models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelab.session import cut


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_listings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Listing CSV with a header, all columns as text; a large file is read by many tasks.

    Rows with too many fields are skipped, short rows are padded with NULL. One extra
    column catches surplus fields, as dropping malformed rows would also drop short ones.
    """
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_overflow"])
    options = dict(escape='"', mode="PERMISSIVE")
    parsed = csv_records(spark, path).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select("r.*").where("_overflow is null").drop("_overflow")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with a header, one per row, with their line breaks inside quotes.

    A quote opens or closes a field and a doubled one does both, so a record ends at the
    first line break with an even number of quotes before it in the file. Each block of a file
    counts its quotes; adding up the counts of the blocks before says in which state a block
    starts. It then finds its records alone. Only the parts of records that cross the border of a
    block, at most two per block, are put together afterwards.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))  # one row per block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).cast("int").alias("inside")))
    if starts.count() <= BLOCKS_SENT:  # lines stay where they are, in their order
        marked = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        marked = lines.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "at")

    def run(batches):
        now, inside, kept, kind, header = None, 0, [], "whole", False
        for batch in batches:
            out = []
            for file, block, line, start in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "line", "inside")]):
                if (file, block) != now:
                    if kept:
                        out.append((*now, "middle" if kind == "head" else "tail", header, "\n".join(kept)))
                    now, inside, kept = (file, block), start, []
                    kind, header = "head" if start else "whole", block == 0
                kept.append(line)
                inside = (inside + line.count('"')) % 2
                if not inside:
                    out.append((file, block, kind, header, "\n".join(kept)))
                    kept, kind, header = [], "whole", False
            if out:
                yield rows(out)
        if kept:
            yield rows([(*now, "middle" if kind == "head" else "tail", header, "\n".join(kept))])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "block", "kind", "header", "record"])

    parts = cut(marked.mapInArrow(run, "file string, block long, kind string, header boolean, record string"), ["kind"])
    whole = parts.where("kind = 'whole' and not header").select("record")
    # a record that crosses borders is a tail, any whole blocks and a head, in this order
    upto = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    pieces = F.sort_array(F.collect_list(F.struct("block", "record")))
    crossing = (parts.where("kind <> 'whole'").withColumn("n", F.sum((F.col("kind") == "tail").cast("int")).over(upto))
                .groupBy("file", "n").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"),
                                          F.max("header").alias("header")).where("not header").select("record"))
    return (whole.unionAll(crossing).select(F.regexp_replace("record", "\\r$", "").alias("record"))
            .where("record <> ''"))


# Blocks whose states (a path and two numbers) are sent to every task.
BLOCKS_SENT = 100_000


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table lies at ``path``; works for any file system Spark knows."""
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


VERSIONS = "version long, place string"


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 force: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Read the newest version of the table at ``path``; build one first if there is none or ``force``.

    A version is written to a folder of its own and counts from the moment its row is
    appended to the list of versions. A writer that dies before leaves the version before
    as it was, and so does a reader of it; of two writers of one version the first by name counts.
    """
    versions = f"{path}/versions"

    def newest():
        if not table_exists(spark, versions):
            return None
        return spark.read.schema(VERSIONS).parquet(versions).orderBy(F.desc("version"), "place").first()

    found = newest()
    if force or found is None:
        place = f"{path}/data/{uuid.uuid4().hex}"
        build().write.partitionBy(*partition_by).parquet(place)
        row = spark.range(1).select(F.lit(found.version + 1 if found else 1).cast("long").alias("version"), F.lit(place).alias("place"))
        row.write.mode("append").parquet(versions)
        found = newest()
    return spark.read.parquet(found.place)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``y_eval``, ``y_pred`` and ``diff`` in one folder per model and category."""
    predictions.write.mode("overwrite").partitionBy("model", "Category").parquet(path)


def read_scoreboard(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    """Scoreboard CSV: ``Runs``, ``Category`` and six columns per model."""
    fields = [T.StructField("Runs", T.IntegerType()), T.StructField("Category", T.StringType())]
    for m in models:
        fields += [T.StructField(f"{m}___{p}", T.DoubleType()) for p in ("f1", "prec", "rec", "acc", "err")]
        fields.append(T.StructField(f"{m}___combined", T.StringType()))
    return spark.read.csv(path, header=True, schema=T.StructType(fields))


def write_report(df: DataFrame, path: str) -> None:
    """A report table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def sample_pairs(df: DataFrame, key: str, n: int = 200) -> DataFrame:
    """The first ``n`` (prediction, target) pairs of a regression report, in key order."""
    return df.select(key, "predicted", "target").orderBy(key).limit(n)


def model_path(folder: str, name: str, category: str | None = None, text_only: bool = False,
               with_text: bool = False) -> str:
    """Where a fitted model goes: one place per variant and category."""
    place = f"per_category/{category}" if category else "all"
    return f"{folder}/{place}/{name}_{variant(text_only, with_text)}"


def variant(text_only: bool = False, with_text: bool = False) -> str:
    return "textOnly" if text_only else "withText" if with_text else "noText"


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_columns(df: DataFrame) -> DataFrame:
    """The names of the columns, one per row."""
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)],
                                            "position int, column string")
    return names.orderBy("position")
