"""Queries on single listings: parsing of text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions import parse
from storelab.plans.registry import AS_OF, days, number, on_apps, query
from storelab.sources.apps import apps


def _cases(column: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"when '{a}' then '{b}'" for a, b in pairs.items())
    return f"case {column} {whens} else {column} end"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("to_float", on_apps(
    f"select \"appId\", {number('\"starRating\"')} rating, {number('\"totalNrOfReviews\"')} reviews, "
    f"{number('libraries')} libraries from apps"))
def to_float(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "starRating", "totalNrOfReviews", "libraries"])
    return df.select("appId", parse.to_float(F.col("starRating")).alias("rating"),
                     parse.to_float(F.col("totalNrOfReviews")).alias("reviews"),
                     parse.to_float(F.col("libraries")).alias("libraries"))


@query("days_since_updated", on_apps(
    f"select \"appId\", cast({days('\"lastUpdated\"')} as double) strict_days, "
    f"cast(case when \"lastUpdated\" is null then 0 else {days('\"lastUpdated\"')} end as double) n_days from apps"))
def days_since_updated(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "lastUpdated"])
    c = F.col("lastUpdated")
    return df.select("appId", parse.days_since(c, AS_OF).cast("double").alias("strict_days"),
                     parse.days_since(c, AS_OF, missing=0).cast("double").alias("n_days"))


@query("days_since_release", on_apps(
    f"select \"appId\", cast({days('age', '%Y %B')} as double) n_days from apps"))
def days_since_release(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "age"])
    return df.select("appId", parse.days_since_release(F.col("age"), AS_OF).cast("double").alias("n_days"))


@query("review_range", on_apps(
    "select \"appId\", case when n is null or n < 100 then 1 when n < 500 then 2 else 3 end review_range, "
    "case when n100 is null or n100 < 100 then 1 when n100 < 500 then 2 else 3 end scaled_range "
    "from (select \"appId\", try_cast(\"totalNrOfReviews\" as double) n, "
    "try_cast(concat(\"totalNrOfReviews\", '0') as double) n100 from apps)"))
def review_range(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "totalNrOfReviews"])
    c = F.col("totalNrOfReviews")
    return df.select("appId", parse.review_range(c).alias("review_range"),
                     parse.review_range(F.concat(c, F.lit("0"))).alias("scaled_range"))


@query("installs_min_max", on_apps(
    "select \"appId\", coalesce(try_cast(replace(trim(split_part(installs, '-', 1)), ',', '') as double), 0) installs_min, "
    "coalesce(try_cast(replace(trim(split_part(installs, '-', 2)), ',', '') as double), 0) installs_max from apps"))
def installs_min_max(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "installs"])
    both = parse.installs_min_max(F.col("installs"))
    return df.select("appId", both["min"].cast("double").alias("installs_min"),
                     both["max"].cast("double").alias("installs_max"))


def version_digits_sql(i: int) -> str:
    return (f"case when len(runs) >= {i} then cast(runs[{i}] as double) "
            f"when len(runs) > 0 then 0 end")


@query("version_digits", on_apps(
    f"select \"appId\", {version_digits_sql(1)} d1, {version_digits_sql(2)} d2, {version_digits_sql(3)} d3 from "
    r"(select *, regexp_extract_all(coalesce(\"requiredAndroidVersion\", ''), '\d+') runs from apps)".replace('\\"', '"')))
def version_digits(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "requiredAndroidVersion"])
    d = parse.version_digits(F.col("requiredAndroidVersion"))
    return df.select("appId", *[d[n].cast("double").alias(n) for n in ("d1", "d2", "d3")])


@query("in_app_price_range", on_apps(
    "select \"appId\", case when len(p) = 0 then 0.0::double else cast(p[1] as double) end price_min, "
    "case when len(p) = 0 then 0.0::double else cast(p[least(len(p), 2)] as double) end price_max from "
    r"""(select "appId", regexp_extract_all(coalesce("inAppProducts", ''), '\d+.\d+') p from apps)"""))
def in_app_price_range(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "inAppProducts"])
    p = parse.in_app_price_range(F.col("inAppProducts"))
    return df.select("appId", p["min"].alias("price_min"), p["max"].alias("price_max"))


@query("in_app_flag", on_apps(
    "select \"appId\", case when \"offersInAppPurchases\" = 'Offers in-app purchases' then 1 else 0 end in_app from apps"))
def in_app_flag(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "offersInAppPurchases"])
    return df.select("appId", parse.in_app_flag(F.col("offersInAppPurchases")).alias("in_app"))


SIZE_SQL = (r"""coalesce(try_cast(regexp_extract("binarySize", '\d+.\d+') as double) * """
            r"""case upper(regexp_extract("binarySize", '[a-zA-Z]+')) when 'KB' then 1 when 'MB' then 1024 """
            r"""when 'GB' then 1048576 end, 0)""")


@query("binary_size_kb", on_apps(f"select \"appId\", round({SIZE_SQL}, 6) kb from apps"))
def binary_size_kb(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "binarySize"])
    return df.select("appId", F.round(parse.binary_size_kb(F.col("binarySize")), 6).alias("kb"))


@query("binary_size_range", on_apps(
    "select \"appId\", case when kb < 3000 then 1 when kb <= 10000 then 2 when kb <= 35000 then 3 else 4 end size_range "
    f"from (select \"appId\", {SIZE_SQL} kb from apps)"))
def binary_size_range(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "binarySize"])
    kb = parse.binary_size_kb(F.col("binarySize"))
    return df.select("appId", parse.binary_size_range(kb).alias("size_range"))


@query("ranking_label", on_apps(
    "select \"appId\", case when ranking is null then 'no_info' when trim(ranking) = '' then 'other' "
    "else replace(trim(ranking), ' ', '_') end ranking from apps"))
def ranking_label(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "ranking"])
    return df.select("appId", parse.ranking_label(F.col("ranking")).alias("ranking"))


def star_sql(i: int) -> str:
    return rf"""try_cast(regexp_extract("reviewsPerStarRating", '"{i}":(\d+)', 1) as double)"""


@query("reviews_per_star", on_apps(
    "select \"appId\", " + ", ".join(f"{star_sql(i)} star{i}" for i in range(1, 6)) + " from apps"))
def reviews_per_star(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "reviewsPerStarRating"])
    df = df.select("appId", parse.reviews_per_star(F.col("reviewsPerStarRating")).alias("n"))
    return df.select("appId", *[F.col("n")[i].cast("double").alias(f"star{i + 1}") for i in range(5)])


@query("star_shares", on_apps(
    "select \"appId\", " + ", ".join(
        f"round(case when t = 0 then 0 else {star_sql(i)} / t end, 6) share{i}" for i in range(1, 6))
    + f" from (select *, {number('\"totalNrOfReviews\"')} t from apps)"))
def star_shares(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "reviewsPerStarRating", "totalNrOfReviews"])
    df = df.select("appId", parse.reviews_per_star(F.col("reviewsPerStarRating")).alias("n"),
                   parse.to_float(F.col("totalNrOfReviews")).alias("total"))
    return df.select("appId", *[F.round(parse.star_share(F.col("n")[i], F.col("total")), 6).alias(f"share{i + 1}")
                                for i in range(5)])


@query("review_counts", on_apps(
    "select \"appId\", " + ", ".join(f"try_cast(h[{i}] as double) star{i}" for i in range(1, 6))
    + r""" from (select "appId", regexp_extract_all("reviewsPerStarRating", ':(\d*)\}', 1) h from apps)"""))
def review_counts(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "reviewsPerStarRating"])
    df = df.select("appId", parse.review_counts(F.col("reviewsPerStarRating")).alias("n"))
    return df.select("appId", *[F.col("n")[i].alias(f"star{i + 1}") for i in range(5)])


@query("similar_ids", on_apps(
    "select \"appId\", len(ids) n_ids, array_to_string(ids, '|') ids, array_to_string(ids, '|') stripped from "
    r"""(select "appId", regexp_extract_all("similarApps", '"([^"]*)"', 1) ids from apps)"""))
def similar_ids(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "similarApps"])
    c = F.col("similarApps")
    return df.select("appId", F.size(parse.similar_ids(c)).cast("bigint").alias("n_ids"),
                     F.array_join(parse.similar_ids(c), "|").alias("ids"),
                     F.array_join(parse.similar_ids(c, "strip"), "|").alias("stripped"))


@query("concat_text_a", on_apps(
    "select \"appId\", length(t) text_length, md5(t) text_md5 from (select \"appId\", "
    "coalesce(\"whatsNew\", 'nan') || coalesce(description, 'nan') || coalesce(author, 'nan') || name t from apps)"))
def concat_text_a(spark, sf_dir):
    cols = ["name", "author", "description", "whatsNew"]
    df = apps(spark, sf_dir, ["appId", *cols])
    text = parse.concat_text_reverse([F.col(c) for c in cols])
    return df.select("appId", F.length(text).cast("bigint").alias("text_length"), F.md5(text).alias("text_md5"))


@query("concat_text_b", on_apps(
    "select \"appId\", length(t) text_length, md5(t) text_md5 from (select \"appId\", "
    "coalesce(description, 'nan') || ' ' || coalesce(\"whatsNew\", 'nan') t from apps)"))
def concat_text_b(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", *K.LEARN_TEXT])
    text = parse.concat_text_blank([F.col(c) for c in K.LEARN_TEXT])
    return df.select("appId", F.length(text).cast("bigint").alias("text_length"), F.md5(text).alias("text_md5"))


@query("category_upper", on_apps("select \"appId\", upper(category) category from apps"))
def category_upper(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "category"]).withColumn("category", F.upper("category"))


MERGED = _cases("category", K.CATEGORY_RENAMES)


@query("category_merge", on_apps(f"select \"appId\", {MERGED} category from apps"))
def category_merge(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "category"]).withColumn(
        "category", parse.rename_category(F.col("category")))


GROUPS = [["Tools", "Action"], ["Puzzle", "Tools_Action"], ["Shopping", "Lifestyle"]]


@query("category_groups", on_apps(
    "select \"appId\", case when c2 in ('Shopping', 'Lifestyle') then 'Shopping_Lifestyle' else c2 end category from "
    "(select *, case when c1 in ('Puzzle', 'Tools_Action') then 'Puzzle_Tools_Action' else c1 end c2 from "
    "(select *, case when category in ('Tools', 'Action') then 'Tools_Action' else category end c1 from apps))"))
def category_groups(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "category"]).withColumn(
        "category", parse.group_categories(F.col("category"), GROUPS))


@query("game_as_one", on_apps(
    f"select \"appId\", case when c in ({_in(K.GAME_CATEGORIES)}) then 'game' else c end category "
    f"from (select \"appId\", {MERGED} c from apps)"))
def game_as_one(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "category"]).withColumn(
        "category", parse.game_as_one(parse.rename_category(F.col("category"))))


@query("game_prefix", on_apps(
    f"select \"appId\", case when c in ({_in([g.upper() for g in K.GAME_CATEGORIES])}) "
    "then 'GAME-' || c else c end category from (select \"appId\", upper(category) c from apps)"))
def game_prefix(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "category"]).withColumn(
        "category", parse.game_prefix(F.upper("category")))


@query("installs_merge", on_apps(
    f"select \"appId\", case when installs in ({_in(K.LARGE_INSTALLS)}) then '500,000+' else installs end installs "
    "from apps"))
def installs_merge(spark, sf_dir):
    return apps(spark, sf_dir, ["appId", "installs"]).withColumn(
        "installs", parse.merge_installs(F.col("installs")))


@query("libraries_flag", on_apps(
    f"select \"appId\", case when l > 0 then 1.0::double else l end libraries from "
    f"(select \"appId\", coalesce({number('libraries')}, 0.0) l from apps)"))
def libraries_flag(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "libraries"])
    return df.withColumn("libraries", parse.positive_flag(
        F.coalesce(parse.to_float(F.col("libraries")), F.lit(0.0))))


@query("category_index", on_apps(
    "select \"appId\", coalesce(n, 0) category_number, case when price <= 0.99 then 1 when price <= 1.99 then 2 "
    "when price <= 3.99 then 3 when price is not null then 4 end::double price_step from apps "
    "left join (values " + ", ".join(f"('{c}', {n})" for c, n in K.CATEGORY_NUMBERS.items())
    + ") t(c, n) on t.c = case when category in ("
    + _in(K.GAME_SUBCATEGORIES) + ") then 'Game_' || category else category end"))
def category_index(spark, sf_dir):
    from storelab.operators.target import fixed_price_class
    df = apps(spark, sf_dir, ["appId", "category", "price"])
    # the lookup table is written by hand: 51 rows
    lookup = F.broadcast(spark.createDataFrame(list(K.CATEGORY_NUMBERS.items()), "c string, n int"))
    name = F.when(F.col("category").isin(*K.GAME_SUBCATEGORIES),
                  F.concat(F.lit("Game_"), "category")).otherwise(F.col("category"))
    return (df.join(lookup, name == F.col("c"), "left")
            .select("appId", F.coalesce("n", F.lit(0)).alias("category_number"),
                    fixed_price_class(F.col("price")).cast("double").alias("price_step")))


@query("version_major_minor", on_apps(
    r"""select "appId", cast(regexp_extract(v, '^(\d).(\d)', 1) as double) major,
    cast(regexp_extract(v, '^(\d).(\d)', 2) as double) minor from
    (select "appId", case when "requiredAndroidVersion" is null or "requiredAndroidVersion" = 'Varies with device'
     then (select h from heads group by h order by count(*) desc, h limit 1) else "requiredAndroidVersion" end v from apps)""",
    r"""heads as (select regexp_extract("requiredAndroidVersion", '^(\d.\d)', 1) h from apps
     where regexp_matches("requiredAndroidVersion", '^\d.\d'))"""))
def version_major_minor(spark, sf_dir):
    from storelab.operators.ordered import column_modes
    from storelab.plans.tables import add_version_numbers
    c = "requiredAndroidVersion"
    df = apps(spark, sf_dir, ["appId", c])
    top = column_modes(df, {"v": parse.version_head(F.col(c))})["v"]
    return add_version_numbers(df, top).select("appId", F.col(f"{c}_major").alias("major"),
                                               F.col(f"{c}_minor").alias("minor"))
