"""Lookups between listings: related prices, frequent authors, listing details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions.parse import similar_ids
from storelab.operators.lookup import join_groups
from storelab.operators.ordered import quantiles_of
from storelab.operators.target import QUARTILES
from storelab.session import cut


def _listed(df: DataFrame, style: str) -> DataFrame:
    """Distinct id lists as (list, id, times): equal lists are worked out once."""
    lists = df.where(F.col("similarApps").isNotNull()).select("similarApps").distinct()
    return (lists.select(F.col("similarApps").alias("list"),
                         F.explode(similar_ids(F.col("similarApps"), style)).alias("id"))
            .groupBy("list", "id").agg(F.count("*").alias("times")))


def _attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Put statistics of a list back on the rows that hold it.

    Empty lists have no statistics. As one frequent value they would all go to the same
    task, so each such row joins on a key of its own that matches nothing.
    """
    empty = F.col("similarApps").isNull() | F.trim("similarApps").isin("", "[]")
    key = F.when(empty, F.concat(F.lit("\0"), F.xxhash64("appId").cast("string"))).otherwise(F.col("similarApps"))
    return (df.withColumn("_list", key)
            .join(stats.withColumnRenamed("list", "_list"), "_list", "left").drop("_list"))


def similar_price_stats(df: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max of the prices of the listed apps.

    Membership: an id named twice counts once, an id found twice in the catalogue
    counts each time. The count is 0 when nothing matches and NULL without a list.
    """
    catalogue = df if catalogue is None else catalogue
    # repeated catalogue ids collapse to (id, price, n) before the shuffle on id
    prices = (catalogue.groupBy(F.col("appId").alias("id"), F.col("price"))
              .agg(F.count("*").alias("n")))
    hits = cut(_listed(df, "json").join(prices, "id")
               .groupBy("list", F.col("price").alias("value")).agg(F.sum("n").alias("n")))
    priced = hits.where("value is not null")
    names = [f"similarApps_{s}" for s in K.SIMILAR_STATS]
    found = hits.groupBy("list").agg(F.sum("n").cast("double").alias(names[0]))
    sums = priced.groupBy("list").agg(
        F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias(names[1]),
        F.min("value").alias(names[3]), F.max("value").alias(names[7]))
    # squared distances need the mean, so they take a second pass over the written hits
    spread = (priced.join(sums.select("list", names[1], F.col("n").alias("rows")), "list")
              .groupBy("list", "rows")
              .agg(F.sum(F.pow(F.col("value") - F.col(names[1]), 2) * F.col("n")).alias("square"))
              .select("list", F.when(F.col("rows") > 1, F.sqrt(F.col("square") / (F.col("rows") - 1)))
                      .alias(names[2])))
    q = quantiles_of(priced, QUARTILES, ["list"]).select(
        "list", *[F.col("q")[i].alias(names[4 + i]) for i in range(3)])
    stats = (found.join(sums, "list", "left").join(spread, "list", "left").join(q, "list", "left")
             .select("list", *[F.col(f"`{n}`") for n in names]))
    count = F.coalesce(names[0], F.when(F.col("similarApps").isNotNull(), F.lit(0.0)))
    return _attach(df, stats).withColumn(names[0], count)


def similar_avg_price(df: DataFrame, catalogue: DataFrame | None = None,
                      name: str = "similarAppsAvgPrice") -> DataFrame:
    """Average price of the listed apps; an id named twice counts twice.

    Ids that are unknown, or that the catalogue holds more than once, are skipped;
    NULL when none is left. Averages keep 9 digits.
    """
    catalogue = df if catalogue is None else catalogue
    prices = (catalogue.groupBy(F.col("appId").alias("id"))
              .agg(F.count("*").alias("n"), F.max("price").alias("price"))
              .where("n = 1 and price is not null").select("id", "price"))
    stats = (_listed(df, "strip").join(prices, "id").groupBy("list")
             .agg(F.round(F.sum(F.col("price") * F.col("times")) / F.sum("times"), 9).alias(name)))
    return _attach(df, stats)


def author_counts(df: DataFrame, more_than: int) -> DataFrame:
    """Authors with more than ``more_than`` listings."""
    return (df.where("author is not null").groupBy("author").agg(F.count("*").alias("n"))
            .where(F.col("n") > more_than))


def frequent_author_flag(df: DataFrame, more_than: int, name: str,
                         value: Column | None = None) -> DataFrame:
    """1 where the author has more than ``more_than`` listings, else 0."""
    value = F.lit(1) if value is None else value
    frequent = author_counts(df, more_than).select("author", value.alias("_hit"))
    return (join_groups(df, frequent, "author", "left")
            .withColumn(name, F.coalesce("_hit", F.lit(0).cast(frequent.schema["_hit"].dataType)))
            .drop("_hit"))


def attach_app_info(df: DataFrame, info: DataFrame, key: str = "appId") -> DataFrame:
    """Listing details next to transformed rows."""
    return df.join(info, key)
