"""Queries on sources, row filters and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions import parse
from storelab.operators import clean, encode, impute
from storelab.operators.ordered import column_modes
from storelab.plans import tables
from storelab.plans.queries_parse import MERGED, SIZE_SQL, star_sql, version_digits_sql
from storelab.plans.registry import AS_OF, days, number, on_apps, query
from storelab.session import scratch_path
from storelab.sources import store
from storelab.sources.apps import apps, table

# --- sources and sinks --------------------------------------------------------------


@query("scan_csv", on_apps(
    "select \"appId\", name, case when k % 45 = 0 then null else price end price from "
    "(select *, cast(substr(\"appId\", 5) as bigint) k from apps) where k % 50 <> 0"))
def scan_csv(spark, sf_dir):
    """Listings written with surplus and missing fields, then read back."""
    path = scratch_path(spark, "listings")
    k = F.substring("appId", 5, 20).cast("bigint")
    df = apps(spark, sf_dir, ["appId", "name", "price"])
    short = F.concat_ws(",", "appId", "name")
    full = F.concat_ws(",", "appId", "name", F.coalesce(F.col("price").cast("string"), F.lit("")))
    line = F.when(k % 50 == 0, F.concat(full, F.lit(",surplus"))).when(k % 45 == 0, short).otherwise(full)
    # one text column whose name is the header line
    df.select(line.alias("appId,name,price")).write.csv(path, header=True, sep="\u0001", escapeQuotes=False)
    raw = store.read_listings(spark, path, ["appId", "name", "price"])
    return raw.withColumn("price", F.col("price").try_cast("double"))


LEARN_COLUMNS = ["appId", "price", "starRating", "totalNrOfReviews", "installs", "category",
                 "contentRating", "libraries", "bigCompany", "daysSinceLastUpdated", *tables.STARS,
                 "requiredAndroidVersion_major", "requiredAndroidVersion_minor", "similarAppsAvgPrice"]
LEARN_FROM = [
    f"""kept as (select *, try_cast("starRating" as double) rating, try_cast("totalNrOfReviews" as double) reviews
 from apps where price <> 0 and try_cast("starRating" as double) <> 0 and try_cast("totalNrOfReviews" as double) <> 0
 and "lastUpdated" is not null and "reviewsPerStarRating" is not null)""",
    """prices as (select "appId" id, max(price) price from kept group by 1 having count(*) = 1)""",
    r"""related as (select i."appId", round(avg(p.price), 9) average from
 (select "appId", unnest(regexp_extract_all("similarApps", '"([^"]*)"', 1)) id from kept) i
 join prices p using (id) group by 1)""",
    """stars as (select """ + ", ".join(
        f"""median(case when "reviewsPerStarRating" <> '{K.NO_REVIEWS}' then {star_sql(i)} end) m{i}""" for i in range(1, 6))
    + """, median(try_cast(libraries as double)) ml from kept)""",
    r"""modes as (select
 (select x from (select case when installs in ('500,000 - 1,000,000', '1,000,000 - 5,000,000', '10,000,000 - 50,000,000')
   then '500,000+' else installs end x from kept where installs is not null) group by x order by count(*) desc, x limit 1) mi,
 (select x from (select upper(category) x from kept where category is not null) group by x order by count(*) desc, x limit 1) mc,
 (select x from (select regexp_extract("requiredAndroidVersion", '^(\d.\d)', 1) x from kept
   where regexp_matches("requiredAndroidVersion", '^\d.\d')) group by x order by count(*) desc, x limit 1) mv)""",
    """learn as (select "appId", price, rating "starRating", reviews "totalNrOfReviews",
 coalesce(case when installs in ('500,000 - 1,000,000', '1,000,000 - 5,000,000', '10,000,000 - 50,000,000')
   then '500,000+' else installs end, mi) installs, coalesce(upper(category), mc) category,
 coalesce("contentRating", 'Unrated') "contentRating", coalesce(try_cast(libraries as double), ml) libraries,
 case when author in (select author from kept group by 1 having count(*) > 10) then 1.0 else 0.0 end::double "bigCompany",
 cast(""" + days('"lastUpdated"') + """ as double) "daysSinceLastUpdated",
 """ + ", ".join(f"""case when "reviewsPerStarRating" = '{K.NO_REVIEWS}' then m{i} else {star_sql(i)} end "{i}starReviews\""""
                 for i in range(1, 6)) + r""",
 cast(regexp_extract(v, '^(\d).(\d)', 1) as double) "requiredAndroidVersion_major",
 cast(regexp_extract(v, '^(\d).(\d)', 2) as double) "requiredAndroidVersion_minor",
 coalesce(description, 'nan') || ' ' || coalesce("whatsNew", 'nan') as text,
 average "similarAppsAvgPrice"
 from (select *, coalesce(nullif("requiredAndroidVersion", 'Varies with device'), mv) v from kept, modes) k
 left join related using ("appId"), stars)""",
]


def learn(spark, sf_dir, with_text=True):
    return tables.learn_table(apps(spark, sf_dir, tables.LEARN_SOURCE), AS_OF, with_text=with_text)


def _rounded(df, columns):
    return df.select(*[F.round(c, 6).alias(c) if df.schema[c].dataType.simpleString() == "double"
                       else F.col(c) for c in columns])


_LEARN_SELECT = "select " + ", ".join(
    f'round("{c}", 6) "{c}"' if c == "similarAppsAvgPrice" else f'"{c}"' for c in LEARN_COLUMNS)


@query("learn_table", on_apps(_LEARN_SELECT + ", md5(text) text_md5 from learn", *LEARN_FROM))
def learn_table(spark, sf_dir):
    df = learn(spark, sf_dir).withColumn("text_md5", F.md5("text"))
    return _rounded(df, [*LEARN_COLUMNS, "text_md5"])


_CACHE: dict[tuple[str, str], str] = {}


def cached_learn(spark, sf_dir):
    """The learning table, built once per session and read back after that."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _CACHE.setdefault(key, scratch_path(spark, "learn"))
    return store.cached_table(spark, path, lambda: learn(spark, sf_dir))


@query("cached_transform", on_apps(_LEARN_SELECT + " from learn", *LEARN_FROM))
def cached_transform(spark, sf_dir):
    return _rounded(cached_learn(spark, sf_dir), LEARN_COLUMNS)


@query("feature_columns")
def feature_columns(spark, sf_dir):
    df = tables.report_table(apps(spark, sf_dir, tables.REPORT_SOURCE), AS_OF)
    drop = ["appId", "similarApps", "name", "text", "price", "price_range_index",
            *[f"similarApps_{s}" for s in K.SIMILAR_STATS]]
    return store.feature_columns(df.drop(*drop))


# --- projections and filters --------------------------------------------------------

@query("drop_columns", on_apps('select "appId", price, category, installs from apps'))
def drop_columns(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "price", "category", "author", "installs", "ranking"]).drop(
        "author", "ranking")


CATEGORY_LEVELS = ["Action", "Lifestyle", "Puzzle", "Tools"]


def one_hot_sql(column: str, levels: list[str], expression: str | None = None) -> str:
    e = expression or f'"{column}"'
    return ", ".join(f"case when {e} = '{v}' then 1 else 0 end \"{column}_{v}\"" for v in levels)


def _one_hot_categories(spark, sf_dir, *more):
    df = apps(spark, sf_dir, ["appId", "price", "category", *more])
    return encode.one_hot(df.withColumn("category", parse.rename_category(F.col("category"))), ["category"])


@query("select_by_pattern", on_apps(
    f"select {one_hot_sql('category', CATEGORY_LEVELS, MERGED)}, price, \"appId\" from apps"))
def select_by_pattern(spark, sf_dir):
    return clean.select_by_pattern(_one_hot_categories(spark, sf_dir, "author"), r"category_\w+",
                                   ["price", "appId"])


@query("per_category_split", on_apps(
    f"select 'category_' || c category, count(*) n, round(avg(price), 6) mean_price from "
    f"(select {MERGED} c, price from apps) where c is not null group by 1"))
def per_category_split(spark, sf_dir):
    parts = clean.per_category(_one_hot_categories(spark, sf_dir))
    return parts.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price"))


@query("split_target", on_apps(
    "select (select count(*) from apps) rows_x, (select count(price) from apps) rows_y, 3::bigint columns_x, "
    "(select count(*) from apps where description is not null) texts"))
def split_target(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "category", "price", "description"]).withColumnRenamed("description", "text")
    x, y = clean.split_target(df)
    texts = clean.only_text(x).agg(F.count("text").alias("texts")).select("texts").scalar()
    rows_y = y.agg(F.count("price").alias("n")).select("n").scalar()
    numeric = clean.drop_text(x)
    return numeric.agg(F.count("*").alias("rows_x")).select(
        "rows_x", rows_y.alias("rows_y"), F.lit(len(x.columns)).cast("bigint").alias("columns_x"),
        texts.alias("texts"))


@query("dropna_any", on_apps(
    'select "appId", price, author, ranking from apps where price is not null and author is not null '
    'and ranking is not null'))
def dropna_any(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "price", "author", "ranking"]).dropna(
        "any", subset=["price", "author", "ranking"])


@query("drop_sentinel", on_apps(
    'select "appId", price, (select count(*) from apps where price is null or price = 0) dropped '
    'from apps where price <> 0'))
def drop_sentinel(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price"])
    dropped = clean.sentinel_counts(df, "price", 0.0).select("dropped").scalar()
    return clean.drop_sentinel(df, "price", 0.0).withColumn("dropped", dropped)


@query("drop_sentinel_cast", on_apps(
    'select "appId", try_cast("starRating" as double) "starRating" from apps '
    'where try_cast("starRating" as double) <> 0'))
def drop_sentinel_cast(spark, sf_dir):
    df = clean.drop_sentinel_cast(apps(spark, sf_dir, ["appId", "starRating"]), "starRating", 0.0)
    if df.where("starRating is null").count():
        raise AssertionError("missing ratings remain")
    return df


@query("drop_by_id", on_apps(
    "select \"appId\", price from apps where \"appId\" not in ('app.3', 'app.5', 'com.maiko.xscanpet')"))
def drop_by_id(spark, sf_dir):
    return clean.drop_by_id(apps(spark, sf_dir, ["appId", "price"]), ["app.3", "app.5", *K.BROKEN_IDS])


@query("drop_long_text", on_apps(
    'select "appId", cast(length("contentRating") as double) text_length from apps where coalesce(length("contentRating") <= 30, true) '
    'and coalesce(length("reviewsPerStarRating") <= 40, true) and coalesce(length(author) <= 9, true)'))
def drop_long_text(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "contentRating", "reviewsPerStarRating", "author"])
    df = clean.drop_long_text(df, "contentRating")
    df = clean.drop_long_text(df, "reviewsPerStarRating", 40)
    df = clean.drop_long_text(df, "author", 9)
    return df.select("appId", F.length("contentRating").cast("double").alias("text_length"))


@query("filter_isin_checked", on_apps(
    "select \"appId\", category from apps where category in ('Tools', 'Puzzle')"))
def filter_isin_checked(spark, sf_dir):
    return clean.filter_isin_checked(apps(spark, sf_dir, ["appId", "category"]), "category", ["Tools", "Puzzle"])


@query("assert_complete", on_apps(
    'select "appId", price, installs from apps where price is not null and installs is not null'))
def assert_complete(spark, sf_dir):
    return clean.assert_complete(apps(spark, sf_dir, ["appId", "price", "installs"]).dropna())


@query("min_support", on_apps(
    'select "appId", author from apps where author in (select author from apps group by 1 having count(*) >= 10)'))
def min_support(spark, sf_dir):
    return clean.min_support(apps(spark, sf_dir, ["appId", "author"]), "author", 10).select("appId", "author")


@query("missing_examples", on_apps(
    'select "appId", price from apps where price is null or price = 0 order by "appId" limit 3'))
def missing_examples(spark, sf_dir):
    return clean.missing_examples(apps(spark, sf_dir, ["appId", "price"]), "price", 0.0, "appId")


@query("feature_sets", on_apps(
    "select 'baseline' feature_set, count(*) filter (where \"similarAppsAvgPrice\" is not null) n, 19::bigint columns from learn "
    "union all select 'ml', count(*), 18 from learn union all select 'ml_per_category', count(*), 16 from learn",
    *LEARN_FROM))
def feature_sets(spark, sf_dir):
    table_ = cached_learn(spark, sf_dir)
    out = None
    for name in tables.FEATURE_SETS:
        df = tables.feature_set(table_, name)
        row = df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("feature_set"), "n", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


# --- imputation ---------------------------------------------------------------------

@query("rating_imputed", on_apps(
    'select "appId", round(case when r = 0 then (select median(r) from x) else r end, 6) rating from x',
    f"x as (select \"appId\", {number('\"starRating\"')} r from apps)"))
def rating_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "starRating"]).select("appId", parse.to_float(F.col("starRating")).alias("rating"))
    return impute.zeros_to_median(df, "rating").withColumn("rating", F.round("rating", 6))


@query("days_imputed", on_apps(
    'select "appId", round(case when d = 0 then (select avg(d) from x) else d end, 6) n_days from x',
    f"x as (select \"appId\", cast(case when \"lastUpdated\" is null then 0 else {days('\"lastUpdated\"')} end as double) d from apps)"))
def days_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "lastUpdated"]).select(
        "appId", parse.days_since(F.col("lastUpdated"), AS_OF, missing=0).cast("double").alias("n_days"))
    return impute.zeros_to_mean(df, "n_days").withColumn("n_days", F.round("n_days", 6))


def _mode(c: str) -> str:
    return f"(select {c} from x where {c} is not null group by 1 order by count(*) desc, cast({c} as int) limit 1)"


@query("version_imputed", on_apps(
    "select \"appId\", " + ", ".join(f"coalesce({d}, {_mode(d)}) {d}" for d in ("d1", "d2", "d3")) + " from x",
    f"x as (select \"appId\", {version_digits_sql(1)} d1, {version_digits_sql(2)} d2, {version_digits_sql(3)} d3 from "
    r"""(select *, regexp_extract_all(coalesce("requiredAndroidVersion", ''), '\d+') runs from apps))"""))
def version_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "requiredAndroidVersion"])
    d = parse.version_digits(F.col("requiredAndroidVersion"))
    names = ["d1", "d2", "d3"]
    df = impute.nulls_to_modes(df.select("appId", *[d[n].alias(n) for n in names]), names)
    return df.select("appId", *[F.col(n).cast("double").alias(n) for n in names])


@query("release_imputed", on_apps(
    'select "appId", round(coalesce(d, (select avg(d) from x)), 6) n_days from x',
    f"x as (select \"appId\", cast({days('age', '%Y %B')} as double) d from apps)"))
def release_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "age"]).select(
        "appId", parse.days_since_release(F.col("age"), AS_OF).cast("double").alias("n_days"))
    return impute.nulls_to_means(df, ["n_days"]).withColumn("n_days", F.round("n_days", 6))


@query("installs_default", on_apps("select \"appId\", coalesce(installs, '1 - 5') installs from apps"))
def installs_default(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "installs"]).withColumn(
        "installs", F.coalesce("installs", F.lit(K.DEFAULT_INSTALLS)))


@query("installs_imputed", on_apps(
    'select "appId", coalesce(i, (select i from x where i is not null group by 1 order by count(*) desc, i limit 1)) installs from x',
    "x as (select \"appId\", case when installs in ('500,000 - 1,000,000', '1,000,000 - 5,000,000', "
    "'10,000,000 - 50,000,000') then '500,000+' else installs end i from apps)"))
def installs_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "installs"]).withColumn("installs", parse.merge_installs(F.col("installs")))
    return impute.nulls_to_modes(df, ["installs"])


@query("category_imputed", on_apps(
    'select "appId", coalesce(c, (select c from x where c is not null group by 1 order by count(*) desc, c limit 1)) category from x',
    'x as (select "appId", upper(category) c from apps)'))
def category_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "category"]).withColumn("category", F.upper("category"))
    return impute.nulls_to_modes(df, ["category"])


@query("content_rating_default", on_apps(
    "select \"appId\", coalesce(\"contentRating\", 'Unrated') \"contentRating\" from apps"))
def content_rating_default(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "contentRating"]).withColumn(
        "contentRating", F.coalesce("contentRating", F.lit(K.UNRATED)))


@query("libraries_imputed", on_apps(
    'select "appId", coalesce(l, (select median(l) from x)) libraries, coalesce(l, 0.0::double) libraries_or_zero from x',
    'x as (select "appId", try_cast(libraries as double) l from apps)'))
def libraries_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "libraries"]).withColumn("libraries", F.col("libraries").try_cast("double"))
    df = df.withColumn("libraries_or_zero", F.coalesce("libraries", F.lit(0.0)))
    return impute.nulls_to_medians(df, ["libraries"])


@query("review_counts_imputed", on_apps(
    "select \"appId\", " + ", ".join(
        f"case when z then (select median({star_sql(i)}) from x where not z) else {star_sql(i)} end \"{i}starReviews\""
        for i in range(1, 6)) + " from x",
    f"x as (select \"appId\", \"reviewsPerStarRating\", \"reviewsPerStarRating\" = '{K.NO_REVIEWS}' z from apps "
    "where \"reviewsPerStarRating\" is not null)"))
def review_counts_imputed(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "reviewsPerStarRating"]).dropna()
    df = tables.hide_empty_reviews(tables.add_review_counts(df))
    return impute.nulls_to_medians(df, tables.STARS).drop("reviewsPerStarRating")


# --- the report table ---------------------------------------------------------------

@query("report_columns", on_apps(
    'select "appId", price_class, round("starRating", 6) "starRating", "bigProvider", "totalNrOfReviews", category, '
    'installs, round(n_days, 6) n_days, "binarySize", libraries, ranking, "offersInAppPurchases", '
    'round(share1, 6) share1, round(share5, 6) share5, text_md5 from rep',
    f"""priced as (select *, {number('"starRating"')} r, {number('"totalNrOfReviews"')} t,
 cast(case when "lastUpdated" is null then 0 else {days('"lastUpdated"')} end as double) d
 from apps where price is not null)""",
    """short as (select *, avg(d) over () mean_days from priced where coalesce(length(author) <= 80, true)
 and coalesce(length("reviewsPerStarRating") <= 80, true))""",
    f"""rep as (select "appId",
 case when price <= (select quantile_cont(price, 0.25) from priced) then 1
      when price <= (select quantile_cont(price, 0.5) from priced) then 2
      when price <= (select quantile_cont(price, 0.75) from priced) then 3 else 4 end price_class,
 case when r = 0 then (select median(r) from priced) else r end "starRating",
 case when author in (select author from priced group by 1 having count(*) > 1) then 1 else 0 end "bigProvider",
 case when t < 100 then 1 when t < 500 then 2 else 3 end "totalNrOfReviews",
 {MERGED} category, coalesce(installs, '1 - 5') installs,
 case when d = 0 then mean_days else d end as n_days,
 case when {SIZE_SQL} < 3000 then 1 when {SIZE_SQL} <= 10000 then 2 when {SIZE_SQL} <= 35000 then 3 else 4 end "binarySize",
 case when coalesce({number('libraries')}, 0) > 0 then 1.0 else 0.0 end::double libraries,
 case when ranking is null then 'no_info' when trim(ranking) = '' then 'other' else replace(trim(ranking), ' ', '_') end ranking,
 case when "offersInAppPurchases" = 'Offers in-app purchases' then 1 else 0 end "offersInAppPurchases",
 case when t = 0 then 0 else {star_sql(1)} / t end share1, case when t = 0 then 0 else {star_sql(5)} / t end share5,
 md5(coalesce("whatsNew", 'nan') || coalesce(description, 'nan') || coalesce(author, 'nan') || name) text_md5
 from short where coalesce(length("contentRating") <= 30, true))"""))
def report_columns(spark, sf_dir):
    df = tables.report_columns(apps(spark, sf_dir, tables.REPORT_SOURCE), AS_OF)
    return df.select("appId", F.col("price_range_index").alias("price_class"), F.round("starRating", 6).alias("starRating"),
                     "bigProvider", "totalNrOfReviews", "category", "installs",
                     F.round("days_since_lastUpdated", 6).alias("n_days"), "binarySize", "libraries", "ranking",
                     "offersInAppPurchases", F.round("1_star_reviews", 6).alias("share1"),
                     F.round("5_star_reviews", 6).alias("share5"), F.md5("text").alias("text_md5"))


@query("report_table")
def report_table(spark, sf_dir):
    return tables.report_table(apps(spark, sf_dir, tables.REPORT_SOURCE), AS_OF).drop("text", "similarApps")
