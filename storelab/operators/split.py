"""Folds and splits, decided per row by its key so that they can be computed again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab.operators.lookup import join_groups
from storelab.operators.ordered import row_numbers


def _runs(df: DataFrame, label: str, k: int, order: list, name: str) -> DataFrame:
    """Cut each class, in order, into k runs that differ by at most one row, larger first."""
    # a key without NULL, so that rows without a class are a class of their own
    df = df.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    label_sizes = df.groupBy("_label").agg(F.count("*").alias("_size"))
    numbered = row_numbers(df, order, [label], "_rn")
    i, base, extra = F.col("_rn") - 1, F.floor(F.col("_size") / k), F.col("_size") % k
    head = extra * (base + 1)
    fold = F.when(i < head, F.floor(F.try_divide(i, base + 1))).otherwise(
        extra + F.floor(F.try_divide(i - head, base)))
    return (join_groups(numbered, label_sizes, "_label")
            .withColumn(name, fold.cast("int") + 1).drop("_rn", "_size", "_label"))


def stratified_folds(df: DataFrame, label: str, key: str | Sequence[str], k: int = 10,
                     name: str = "fold") -> DataFrame:
    """Fold 1 to k: each class, in key order, is cut into k nearly equal runs.

    The same as ``ntile(k)`` per class, without putting a class into one task.
    """
    return _runs(df, label, k, [key] if isinstance(key, str) else list(key), name)


def shuffled_folds(df: DataFrame, label: str, key: str | Sequence[str], k: int = 5, seed: int = 23,
                   name: str = "fold") -> DataFrame:
    """As ``stratified_folds`` after shuffling the rows by a hash of the (first) key."""
    key, *ties = [key] if isinstance(key, str) else key
    mixed = df.withColumn("_mix", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    return _runs(mixed, label, k, ["_mix", key, *ties], name).drop("_mix")


def share_of(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def random_split(df: DataFrame, key: str, train: float = 0.75, seed: int = 0,
                 name: str = "split") -> DataFrame:
    """Mark every row ``train`` or ``test``."""
    return df.withColumn(name, F.when(share_of(key, seed) < train, "train").otherwise("test"))


def hashed_folds(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold 1 to k from a hash alone: no shuffle, class shares only nearly equal."""
    return df.withColumn(name, (F.floor(share_of(key, seed) * k) + 1).cast("int"))
