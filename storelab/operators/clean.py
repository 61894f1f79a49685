"""Row and column selection with checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators.lookup import join_groups


def select_by_pattern(df: DataFrame, pattern: str = r"category_\w+",
                      keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains ``pattern``, then the fixed ones."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)], *keep)


def split_target(df: DataFrame, target: str = "price") -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def drop_text(df: DataFrame) -> DataFrame:
    return df.drop("text")


def only_text(df: DataFrame) -> DataFrame:
    return df.select("text")


def drop_sentinel(df: DataFrame, column: str, sentinel) -> DataFrame:
    """Rows whose value is neither NULL nor the sentinel that stands for a missing one."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != F.lit(sentinel)))


def drop_sentinel_cast(df: DataFrame, column: str, sentinel: float) -> DataFrame:
    """As ``drop_sentinel`` after reading the column as a number; unreadable text is missing."""
    return drop_sentinel(df.withColumn(column, F.col(column).try_cast("double")), column, sentinel)


def sentinel_counts(df: DataFrame, column: str, sentinel) -> DataFrame:
    """How many rows a sentinel drop keeps and removes."""
    missing = F.col(column).isNull() | (F.col(column) == F.lit(sentinel))
    return df.agg(F.count_if(missing).alias("dropped"), F.count_if(~missing).alias("kept"))


def drop_by_id(df: DataFrame, ids: Sequence[str] = K.BROKEN_IDS, key: str = "appId") -> DataFrame:
    """Rows whose key is not listed. The list is written by hand, so it stays short."""
    return df.where(~F.coalesce(F.col(key).isin(*ids), F.lit(False)))


def drop_long_text(df: DataFrame, column: str, length: int | None = None) -> DataFrame:
    limit = K.MAX_LENGTH[column] if length is None else length
    return df.where(F.coalesce(F.length(column) <= limit, F.lit(True)))


def filter_isin_checked(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; fails if a listed value does not occur.

    The check reads one aggregate row; it runs once, when the frame is built.
    """
    kept = df.where(F.col(column).isin(*values))
    seen = kept.agg(F.countDistinct(column)).first()[0]
    if seen != len(set(values)):
        raise ValueError(f"{len(set(values)) - seen} of the listed values do not occur in {column}")
    return kept


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values of every column from one pass: columns ``feature``, ``missing``."""
    names = df.columns
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing"))
        for i, c in enumerate(names)])).alias("x")).select("x.*")


def assert_complete(df: DataFrame) -> DataFrame:
    """The frame itself, or an error that names the columns with missing values."""
    bad = null_counts(df).where("missing > 0").collect()
    if bad:
        raise ValueError("missing values in " + ", ".join(f"{r.feature} ({r.missing})" for r in bad))
    return df


def per_category(one_hot: DataFrame, prefix: str = "category_") -> DataFrame:
    """One-hot category columns folded back into a ``category`` key, one frame for all."""
    flags = [c for c in one_hot.columns if c.startswith(prefix)]
    key = F.coalesce(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in flags])
    return one_hot.withColumn("category", key).where("category is not null").drop(*flags)


def min_support(df: DataFrame, column: str = "category", rows: int = 100) -> DataFrame:
    """Rows of the groups that have at least ``rows`` rows."""
    large = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= rows).select(column)
    return join_groups(df, large, column, "left_semi")


def missing_examples(df: DataFrame, column: str, sentinel, key: str, n: int = 3) -> DataFrame:
    """The first ``n`` keys whose value is NULL or the sentinel."""
    return (df.where(F.col(column).isNull() | (F.col(column) == F.lit(sentinel)))
            .select(key, column).orderBy(key).limit(n))
