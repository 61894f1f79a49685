"""Queries that profile columns, and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelab.functions import parse
from storelab.operators import profile, split, target
from storelab.operators.ordered import mode_rows
from storelab.plans.queries_clean import cached_learn
from storelab.plans.queries_join import class_sql, cuts_sql
from storelab.plans.queries_parse import number
from storelab.plans.registry import on_apps, query, r6
from storelab.sources.apps import ALL, apps, table

TEXTS = ["category", "contentRating", "installs", "ranking"]
_LONG_TEXT = "long as (" + " union all ".join(
    f"select '{c}' feature, \"{c}\" as value from apps where \"{c}\" is not null" for c in TEXTS) + ")"


@query("value_counts", on_apps('select category as value, count(*) count from apps where category is not null group by 1'))
def value_counts(spark, sf_dir):
    return profile.value_counts(apps(spark, sf_dir, ["category"]), "category")


@query("value_counts_all", on_apps("select feature, value, count(*) count from long group by 1, 2", _LONG_TEXT))
def value_counts_all(spark, sf_dir):
    return profile.value_counts_all(apps(spark, sf_dir, TEXTS), TEXTS)


@query("class_balance", on_apps(
    f"select y label, count(*) count, round(count(*) / sum(count(*)) over (), 6) share from "
    f"(select {class_sql('price')} y from priced, {cuts_sql('priced')}) group by 1",
    "priced as (select * from apps where price is not null)"))
def class_balance(spark, sf_dir):
    df = apps(spark, sf_dir, ["price"]).dropna()
    classes = target.add_price_class(df, target.price_cuts(df))
    return profile.class_balance(classes, "price_range_index").withColumn("share", r6("share"))


@query("mode_value", on_apps(
    "select feature, value top, n freq from (select *, row_number() over (partition by feature order by n desc, value) rn "
    "from (select feature, value, count(*) n from long group by 1, 2)) where rn = 1", _LONG_TEXT))
def mode_value(spark, sf_dir):
    from storelab.operators.ordered import long_form
    df = apps(spark, sf_dir, TEXTS)
    return mode_rows(long_form(df, {c: F.col(c) for c in TEXTS}, "string"), "value", ["feature"])


@query("mode_of_match", on_apps(
    r"""select h top, count(*) freq from (select regexp_extract("requiredAndroidVersion", '^(\d.\d)', 1) h from apps
    where regexp_matches("requiredAndroidVersion", '^\d.\d')) group by 1 order by 2 desc, 1 limit 1"""))
def mode_of_match(spark, sf_dir):
    df = apps(spark, sf_dir, ["requiredAndroidVersion"])
    return mode_rows(df, parse.version_head(F.col("requiredAndroidVersion")))


NUMERIC = ["price", "reviews", "rating"]
_NUMBERS = (f"nums as (select \"appId\", price, {number('\"totalNrOfReviews\"')} reviews, "
            f"{number('\"starRating\"')} rating from apps)")
_LONG_NUMERIC = "long as (" + " union all ".join(
    f"select '{c}' feature, {c} as value from nums where {c} is not null" for c in NUMERIC) + ")"


def _numbers(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "price", "totalNrOfReviews", "starRating"]).select(
        "appId", "price", parse.to_float(F.col("totalNrOfReviews")).alias("reviews"),
        parse.to_float(F.col("starRating")).alias("rating"))


@query("mean_median", on_apps(
    "select feature, round(avg(value), 6) mean, round(median(value), 6) median from long group by 1",
    _NUMBERS, _LONG_NUMERIC))
def mean_median(spark, sf_dir):
    df = profile.mean_median(_numbers(spark, sf_dir), NUMERIC)
    return df.select("feature", r6("mean").alias("mean"), r6("median").alias("median"))


@query("price_percentiles", on_apps(
    "select " + ", ".join(f"round(quantile_cont(price, {p}), 6) p{int(p * 100)}" for p in (0.01, 0.25, 0.5, 0.75, 0.99))
    + " from apps"))
def price_percentiles(spark, sf_dir):
    from storelab.operators.ordered import quantiles
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = quantiles(apps(spark, sf_dir, ["price"]), "price", probs)
    return q.select(*[r6(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(probs)])


@query("describe_numeric", on_apps(
    "select feature, round(min(value), 6) min, round(max(value), 6) max, round(avg(value), 6) mean, "
    "round(stddev_samp(value), 6) std, round(quantile_cont(value, 0.25), 6) \"25%\", "
    "round(quantile_cont(value, 0.5), 6) \"50%\", round(quantile_cont(value, 0.75), 6) \"75%\" from long group by 1",
    _NUMBERS, _LONG_NUMERIC))
def describe_numeric(spark, sf_dir):
    df = profile.describe_numeric(_numbers(spark, sf_dir), NUMERIC)
    return df.select("feature", *[r6(F.col(f"`{c}`")).alias(c) for c in df.columns if c != "feature"])


@query("describe_text", on_apps(
    "select feature, cast(sum(n) as bigint) count, count(*) as unique, arg_min(value, (-n, value)) top, max(n) freq "
    "from (select feature, value, count(*) n from long group by 1, 2) group by 1", _LONG_TEXT))
def describe_text(spark, sf_dir):
    return profile.describe_text(apps(spark, sf_dir, TEXTS), TEXTS)


@query("missing_summary", on_apps(" union all ".join(
    f"select '{c}' feature, count(*) - count(\"{c}\") missing from apps" for c in ALL)))
def missing_summary(spark, sf_dir):
    from storelab.operators.clean import null_counts
    return null_counts(apps(spark, sf_dir))


@query("distinct_values", on_apps("select distinct installs from apps"))
def distinct_values(spark, sf_dir):
    return apps(spark, sf_dir, ["installs"]).distinct()


@query("group_mean_sorted", on_apps(
    'select "contentRating", round(avg(price), 6) mean from apps where "contentRating" is not null group by 1'))
def group_mean_sorted(spark, sf_dir):
    df = apps(spark, sf_dir, ["contentRating", "price"])
    return profile.group_mean_sorted(df, "contentRating", "price").withColumn("mean", r6("mean"))


def histogram_sql(bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return (f"select {key}bin, round(lo + bin * w, 6) low, round(lo + (bin + 1) * w, 6) high, count(*) count from "
            f"(select *, cast(least(floor((v - lo) / w), {bins - 1}) as int) bin from vals, "
            f"(select min(v) lo, (max(v) - min(v)) / {bins} w from vals) where v is not null) group by all")


@query("histogram", on_apps(histogram_sql(10), f"vals as (select {number('\"totalNrOfReviews\"')} v from apps)"))
def histogram(spark, sf_dir):
    df = apps(spark, sf_dir, ["totalNrOfReviews"]).select(parse.to_float(F.col("totalNrOfReviews")).alias("v"))
    return profile.histogram(df, "v").withColumns({c: r6(c) for c in ("low", "high")})


@query("histogram_by_class", on_apps(
    histogram_sql(20, "price_class"),
    f"priced as (select price, {number('\"starRating\"')} v from apps where price is not null)",
    f"vals as (select {class_sql('price')} price_class, v from priced, {cuts_sql('priced')})"))
def histogram_by_class(spark, sf_dir):
    df = apps(spark, sf_dir, ["price", "starRating"]).dropna(subset=["price"])
    df = df.select("price", parse.to_float(F.col("starRating")).alias("v"))
    df = target.add_price_class(df, target.price_cuts(df), name="price_class")
    return profile.histogram(df, "v", 20, ["price_class"]).withColumns({c: r6(c) for c in ("low", "high")})


@query("table_profile", "select (select count(*) from part) as rows, 6::bigint as columns, unnest(['p_partkey', 'p_name', "
       "'p_brand', 'p_type', 'p_size', 'p_retailprice']) as column, unnest(['bigint', 'string', 'string', 'string', 'int', "
       "'double']) as type")
def table_profile(spark, sf_dir):
    return profile.table_profile(table(spark, sf_dir, "part"))


# --- folds and splits ---------------------------------------------------------------

_CLASSES = f"classes as (select \"appId\", {class_sql('price')} price_class from priced, {cuts_sql('priced')})"
_PRICED = "priced as (select * from apps where price is not null)"


def _classes(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price"]).dropna()
    return target.add_price_class(df, target.price_cuts(df), name="price_class").drop("price")


@query("stratified_folds", on_apps(
    'select "appId", price_class, cast(ntile(10) over (partition by price_class order by "appId") as int) fold from classes',
    _PRICED, _CLASSES))
def stratified_folds(spark, sf_dir):
    return split.stratified_folds(_classes(spark, sf_dir), "price_class", "appId", 10)


@query("stratified_split", on_apps(
    'select "appId", price_class, cast(ntile(5) over (partition by price_class order by md5(concat("appId", \'-23\')), "appId") '
    'as int) fold from classes', _PRICED, _CLASSES))
def stratified_split(spark, sf_dir):
    return split.shuffled_folds(_classes(spark, sf_dir), "price_class", "appId", 5, 23)


@query("random_split", on_apps(
    "select \"appId\", case when (('0x' || substr(md5(concat(\"appId\", '-7')), 1, 8))::bigint / 4294967296.0) < 0.75 "
    "then 'train' else 'test' end split from apps"))
def random_split(spark, sf_dir):
    return split.random_split(apps(spark, sf_dir, ["appId"]), "appId", seed=7)
