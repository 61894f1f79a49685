"""Filling missing values from statistics of the column.

Statistics are fitted first, all of one kind in one pass; they are a few values per
column, which then enter the plan as constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab.operators.ordered import column_means, column_modes, column_quantiles


def median(df: DataFrame, column: str) -> Column:
    return column_quantiles(df, {column: F.col(column)}, [0.5])[column][0]


def mean(df: DataFrame, column: str) -> Column:
    return column_means(df, [column])[column]


def fill_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(f"`{column}`")))


def zeros_to_median(df: DataFrame, column: str) -> DataFrame:
    """0.0 becomes the median of the column, in which the zeros count."""
    return fill_where(df, column, F.col(column) == 0, median(df, column))


def zeros_to_mean(df: DataFrame, column: str) -> DataFrame:
    """0 becomes the mean of the column, in which the zeros count."""
    return fill_where(df, column, F.col(column) == 0, mean(df, column))


def nulls_to_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs become the column median; one pass computes all medians."""
    q = column_quantiles(df, {c: F.col(f"`{c}`") for c in columns}, [0.5])
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), q[c][0]) for c in columns})


def nulls_to_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs become the column mean; one pass computes all means."""
    means = column_means(df, columns)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), means[c]) for c in columns})


def nulls_to_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs become the most frequent value, the smallest one on ties (as text); one pass."""
    modes = column_modes(df, {c: F.col(f"`{c}`") for c in columns})
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), modes[c].cast(df.schema[c].dataType))
                           for c in columns})


def flagged_to_null(df: DataFrame, columns: Sequence[str], flag: Column) -> DataFrame:
    """Flagged rows lose their values, so that the statistics skip them."""
    return df.withColumns({c: F.when(F.coalesce(~flag, F.lit(True)), F.col(f"`{c}`")) for c in columns})
