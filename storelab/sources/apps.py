"""The ``apps`` view: raw listing text, with the faults of a store export, over the
driver tables. One text per column serves Spark and the SQL checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Expressions that are spelled differently per engine.
_SPARK = {
    "S": "string",
    "LIST": "array_join(transform(sequence(cast(1 as bigint), total % 7), "
            "k -> concat('app.', abs(p_partkey + (k % 4) * 37 - 60))), '\",\"')",
    "LAST": "date_format(last_sd, 'MMMM d, yyyy')",
    "AGE": "date_format(first_sd, 'yyyy MMMM')",
}
_DUCK = {
    "S": "varchar",
    "LIST": "array_to_string(list_transform(range(1, total % 7 + 1), "
            "lambda k: concat('app.', abs(p_partkey + (k % 4) * 37 - 60))), '\",\"')",
    "LAST": "strftime(last_sd, '%B %-d, %Y')",
    "AGE": "strftime(first_sd, '%Y %B')",
}

LINES = """select l_partkey pk, count(*) total, cast(sum(star) as bigint) stars,
  count(case when star=1 then 1 end) n1, count(case when star=2 then 1 end) n2,
  count(case when star=3 then 1 end) n3, count(case when star=4 then 1 end) n4,
  count(case when star=5 then 1 end) n5, max(l_shipdate) last_sd, min(l_shipdate) first_sd
 from (select l_partkey, l_shipdate, 1 + cast(l_quantity as int) % 5 star from lineitem) group by l_partkey"""

COLUMNS = {
    "appId": "concat('app.', p_partkey)",
    "name": "p_name",
    "price": "case when p_partkey % 97 = 0 then null when p_partkey % 89 = 0 then 0.0 else p_retailprice end",
    "category": "case when p_partkey % 41 = 0 then null else case p_type when 'MEDIUM' then 'Tools' "
                "when 'STANDARD' then 'Puzzle' when 'LARGE' then 'Lifestyle' when 'PROMO' then 'Shopping' "
                "when 'SMALL' then 'Action' else 'Casino' end end",
    "author": "case when p_partkey % 53 = 0 then null else concat(p_brand, '-', p_size % 10) end",
    "totalNrOfReviews": "case when p_partkey % 43 = 0 then 'N/A' else cast(coalesce(total, 0) as {S}) end",
    "starRating": "case when p_partkey % 31 = 0 then 'N/A' when p_partkey % 37 = 0 or total is null then '0.0' "
                  "else concat(cast(floor(floor(10*stars/total)/10) as int), '.', "
                  "cast(floor(10*stars/total) as int) % 10) end",
    "reviewsPerStarRating": "case when p_partkey % 59 = 0 then null when p_partkey % 29 = 0 or total is null then "
                            "'[{{\"1\":0}},{{\"2\":0}},{{\"3\":0}},{{\"4\":0}},{{\"5\":0}}]' else "
                            "concat('[{{\"1\":', n1, '}},{{\"2\":', n2, '}},{{\"3\":', n3, '}},{{\"4\":', n4, "
                            "'}},{{\"5\":', n5, '}}]') end",
    "description": "d.text",
    "whatsNew": "case when p_partkey % 7 = 0 or d.source is null then null else concat('source ', d.source) end",
    "lastUpdated": "case when p_partkey % 61 = 0 then null else {LAST} end",
    "age": "case when p_partkey % 71 = 0 then null when p_partkey % 67 = 0 then 'unknown' else {AGE} end",
    "installs": "case when p_partkey % 19 = 0 then null when coalesce(total,0) < 20 then '10 - 50' "
                "when total < 30 then '100 - 500' when total < 40 then '500,000 - 1,000,000' "
                "else '1,000,000 - 5,000,000' end",
    "requiredAndroidVersion": "case when p_partkey % 79 = 0 then null when p_partkey % 13 = 0 then "
                              "'Varies with device' else concat(1 + p_size % 5, '.', p_size % 7, "
                              "case when p_size % 3 = 0 then '.3' else '' end, ' and up') end",
    "contentRating": "case when p_partkey % 17 = 0 then null else case p_size % 4 when 0 then 'Everyone' "
                     "when 1 then 'Teen' when 2 then 'Mature 17+' else 'Everyone 10+' end end",
    "inAppProducts": "case when p_partkey % 3 = 0 then null when p_partkey % 5 = 0 then '$1.99 per item' "
                     "else concat('$0.99 - $', p_size, '.99 per item') end",
    "offersInAppPurchases": "case when p_partkey % 3 = 0 then null else 'Offers in-app purchases' end",
    "ranking": "case when p_partkey % 23 = 0 then null when p_partkey % 47 = 0 then '  ' else case p_size % 3 "
               "when 0 then 'Top ranked' when 1 then 'Highly ranked' else 'Unranked' end end",
    "binarySize": "case when p_partkey % 11 = 0 then 'N/A' when p_partkey % 83 = 0 then '5MB' "
                  "else concat(p_size, '.', p_partkey % 10, case p_partkey % 3 when 0 then ' KB' "
                  "when 1 then ' MB' else ' GB' end) end",
    "libraries": "case when p_partkey % 9 = 0 then null else cast(p_size % 6 as {S}) end",
    # a store page lists a handful of related apps; some are unknown, some are named twice
    "similarApps": "case when coalesce(total, 0) % 7 = 0 then '[]' else concat('[\"', {LIST}, '\"]') end",
}
ALL = list(COLUMNS)
_LINE_COLUMNS = {"totalNrOfReviews", "starRating", "reviewsPerStarRating", "lastUpdated", "age",
                 "installs", "similarApps"}
_DOCUMENT_COLUMNS = {"description", "whatsNew"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out to all cores by a unique key when the scan has fewer splits than that.

    A large table has many splits and is left alone; a small file with one row group
    would otherwise keep one core busy with all text work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def apps(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ALL) -> DataFrame:
    """The view with only the joins its columns need, so scans stay narrow."""
    df = table(spark, sf_dir, "part")
    if _LINE_COLUMNS & set(columns):
        lines = spark.sql(LINES.replace("from lineitem", "from {lineitem}"),
                          lineitem=table(spark, sf_dir, "lineitem"))
        df = df.join(lines, F.col("p_partkey") == F.col("pk"), "left")
    if _DOCUMENT_COLUMNS & set(columns):
        df = df.join(table(spark, sf_dir, "documents").alias("d"),
                     F.col("p_partkey") == F.col("d.doc_id"), "left")
    return df.select(*[F.expr(COLUMNS[c].format(**_SPARK)).alias(c) for c in columns])


def apps_sql() -> str:
    """The same view as a list of CTEs for the SQL checks."""
    body = ",\n ".join(f"{e.format(**_DUCK)} {_name(c)}" for c, e in COLUMNS.items())
    return (f"agg as ({LINES}),\napps as (select {body}\n from part left join agg on agg.pk = p_partkey "
            "left join documents d on d.doc_id = p_partkey)")


def _name(c: str) -> str:
    return f'"{c}"'
