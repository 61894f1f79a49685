"""Running totals and exact quantiles that never put a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelab.session import cut

# Distinct values of a group up to which one percentile aggregate is used.
SMALL_COUNTS = 100_000


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column],
                   by: Sequence[str] = ()) -> DataFrame:
    """Add, per group ``by``, the sum of each expression over the rows up to this one.

    Rows are range partitioned on (by, order) into slices; each slice adds up its own
    rows and starts from the totals of the slices before it. The largest unit of work
    is a slice, however large a group is, provided the order is unique in a group.
    """
    by = list(by)
    sliced = cut(df.repartitionByRange(*[F.col(c) for c in by], *order)
                 .withColumn("_slice", F.spark_partition_id()))
    # at most one row per slice and group
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by],
                           F.col("_slice").alias("_start_slice"),
                           *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}")
                             for n in sums])
    match = F.col("_slice") == F.col("_start_slice")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = (Window.partitionBy("_slice", *by).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sliced.join(starts, match).select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.sum(e).over(inside)).alias(n) for n, e in sums.items()])


def row_numbers(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (),
                name: str = "row_number") -> DataFrame:
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by)


def value_weights(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value of a group, with its number of rows."""
    return (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value"))
            .agg(F.count("*").alias("n")))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              small: int = SMALL_COUNTS) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``by`` and ``q`` (array).

    Rows are first reduced to distinct values, so repeated values cost nothing later.
    """
    return quantiles_of(cut(value_weights(df, value, by)), probs, by, small)


def quantiles_of(weights: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                 small: int = SMALL_COUNTS) -> DataFrame:
    """Exact quantiles of rows (by, value, n), already computed by ``cut``.

    When no group has many distinct values (counted, not guessed) one aggregate
    finishes the work; otherwise running totals find the two neighbours of every rank.
    """
    by = list(by)
    sizes = weights.groupBy(*by).agg(F.count("*").alias("size")) if by else None
    largest = (sizes.agg(F.max("size")).first()[0] or 0) if by else weights.limit(small + 1).count()
    if largest <= small:
        return weights.groupBy(*by).agg(
            F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("n")).alias("q"))
    return _ranked_quantiles(weights, probs, by)


def _ranked_quantiles(weights: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    upto = running_totals(weights, ["value"], {"upto": F.col("n")}, by)
    sizes = weights.groupBy(*[F.col(c).alias(f"_size_{c}") for c in by]).agg(F.sum("n").alias("size"))
    if by:
        match = F.lit(True)
        for c in by:
            match &= F.col(c).eqNullSafe(F.col(f"_size_{c}"))
        upto = upto.join(sizes, match)
    else:
        upto = upto.withColumn("size", sizes.select("size").scalar())
    picks = []
    for i, p in enumerate(probs):
        rank = (F.col("size") - 1) * float(p)
        low = F.floor(rank) + 1
        high = F.ceil(rank) + 1

        def at(position: Column) -> Column:
            hit = (F.col("upto") >= position) & (F.col("upto") - F.col("n") < position)
            return F.max(F.when(hit, F.col("value").cast("double")))

        # as the aggregate works it out, to the last bit
        above, below = F.max(F.ceil(rank) - rank), F.max(rank - F.floor(rank))
        picks.append(F.when(at(low) == at(high), at(low)).otherwise(above * at(low) + below * at(high)))
    return upto.groupBy(*by).agg(F.array(*picks).alias("q"))


def long_form(df: DataFrame, columns: dict[str, Column], cast: str) -> DataFrame:
    """Rows (feature, value) of several columns, missing values left out."""
    items = [F.struct(F.lit(n).alias("feature"), c.cast(cast).alias("value"))
             for n, c in columns.items()]
    return df.select(F.explode(F.array(*items)).alias("x")).select("x.*").where("value is not null")


def column_quantiles(df: DataFrame, columns: dict[str, Column],
                     probs: Sequence[float]) -> dict[str, list[Column]]:
    """Quantiles of several columns from one pass, fitted: one row per column is read
    and its values enter later plans as constants."""
    rows = quantiles(long_form(df, columns, "double"), "value", probs, ["feature"]).collect()
    found = {r.feature: list(r.q) for r in rows}
    return {n: [F.lit(q).cast("double") for q in found.get(n, [None] * len(probs))] for n in columns}


def column_modes(df: DataFrame, columns: dict[str, Column]) -> dict[str, Column]:
    """Most frequent value, as text, of several columns from one pass, fitted likewise."""
    rows = mode_rows(long_form(df, columns, "string"), "value", ["feature"]).collect()
    found = {r.feature: r.top for r in rows}
    return {n: F.lit(found.get(n)).cast("string") for n in columns}


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Means of several columns from one pass, fitted likewise."""
    row = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: F.lit(row[i]).cast("double") for i, c in enumerate(columns)}


def mode_rows(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per group, the smallest one on ties: columns ``by``, top, freq."""
    counts = (df.select(*by, (F.col(value) if isinstance(value, str) else value).alias("value"))
              .where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("top")))
    return (counts.groupBy(*by).agg(best.alias("b"))
            .select(*by, F.col("b.top").alias("top"), (-F.col("b.k")).alias("freq")))
