"""Queries on lookups between listings, price classes, encoding and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions import parse
from storelab.operators import clean, encode, impute, related, select_features, split, target
from storelab.plans.queries_clean import CATEGORY_LEVELS, LEARN_FROM, cached_learn, one_hot_sql
from storelab.plans.queries_parse import MERGED, number
from storelab.plans.registry import on_apps, query, r6
from storelab.sources.apps import apps, table
from storelab.sources import store

IDS = r"""ids as (select "appId", unnest(regexp_extract_all("similarApps", '"([^"]*)"', 1)) id from apps)"""
STATS = [IDS, """found as (select d."appId", count(*) n, avg(p.price) mean, stddev_samp(p.price) std, min(p.price) lo,
 quantile_cont(p.price, 0.25) q25, quantile_cont(p.price, 0.5) q50, quantile_cont(p.price, 0.75) q75, max(p.price) hi
 from (select distinct "appId", id from ids) d join apps p on p."appId" = d.id group by 1)""",
         """stats as (select a."appId", coalesce(n, 0)::double "similarApps_count", mean "similarApps_mean", std "similarApps_std",
 lo "similarApps_min", q25 "similarApps_25%", q50 "similarApps_50%", q75 "similarApps_75%", hi "similarApps_max"
 from apps a left join found using ("appId"))"""]
STAT_NAMES = [f"similarApps_{s}" for s in K.SIMILAR_STATS]


@query("similar_price_stats", on_apps(
    'select "appId", ' + ", ".join(f'round("{c}", 6) "{c}"' for c in STAT_NAMES) + " from stats", *STATS))
def similar_price_stats(spark, sf_dir):
    df = related.similar_price_stats(apps(spark, sf_dir, ["appId", "price", "similarApps"]))
    return df.select("appId", *[r6(F.col(f"`{c}`")).alias(c) for c in STAT_NAMES])


@query("similar_price_stats_imputed", on_apps(
    'select "appId", ' + ", ".join(f'round(coalesce("{c}", avg("{c}") over ()), 6) "{c}"' for c in STAT_NAMES)
    + " from stats", *STATS))
def similar_price_stats_imputed(spark, sf_dir):
    df = related.similar_price_stats(apps(spark, sf_dir, ["appId", "price", "similarApps"]))
    return impute.nulls_to_means(df, STAT_NAMES).select(
        "appId", *[r6(F.col(f"`{c}`")).alias(c) for c in STAT_NAMES])


@query("similar_avg_price", on_apps(
    'select a."appId", round(average, 6) average from apps a left join (select i."appId", avg(p.price) average '
    'from ids i join (select "appId" id, max(price) price from apps group by 1 having count(*) = 1) p using (id) '
    'where p.price is not null group by 1) using ("appId")', IDS))
def similar_avg_price(spark, sf_dir):
    df = related.similar_avg_price(apps(spark, sf_dir, ["appId", "price", "similarApps"]), name="average")
    return df.select("appId", r6("average").alias("average"))


@query("frequent_author_flag", on_apps(
    'select "appId", case when author in (select author from priced group by 1 having count(*) > 1) then 1 else 0 end '
    '"bigProvider", case when author in (select author from priced group by 1 having count(*) > 10) then 1.0 else 0.0 end::double '
    '"bigCompany" from priced', "priced as (select * from apps where price is not null)"))
def frequent_author_flag(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price", "author"]).dropna(subset=["price"])
    df = related.frequent_author_flag(df, 1, "bigProvider")
    df = related.frequent_author_flag(df, 10, "bigCompany", F.lit(1.0))
    return df.select("appId", "bigProvider", "bigCompany")


@query("frequent_authors", on_apps("select author, count(*) n from apps where author is not null group by 1 having count(*) > 10"))
def frequent_authors(spark, sf_dir):
    return related.author_counts(apps(spark, sf_dir, ["author"]), 10)


@query("attach_app_info", on_apps(
    'select "appId", name, price_class from (select *, case when price <= quantile_cont(price, 0.25) over () then 1 '
    'when price <= quantile_cont(price, 0.5) over () then 2 when price <= quantile_cont(price, 0.75) over () then 3 else 4 end '
    'price_class from apps where price is not null)'))
def attach_app_info(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price"]).dropna()
    classes = target.add_price_class(df, target.price_cuts(df), name="price_class").drop("price")
    return related.attach_app_info(classes, apps(spark, sf_dir, ["appId", "name"]))


# --- price classes ------------------------------------------------------------------

def class_sql(value: str, cuts: str = "") -> str:
    return (f"case when {value} <= {cuts}q25 then 1 when {value} <= {cuts}q50 then 2 "
            f"when {value} <= {cuts}q75 then 3 when {value} is not null then 4 end")


def cuts_sql(source: str, by: str = "") -> str:
    group, key = (f" group by {by}", f"{by}, ") if by else ("", "")
    q = ", ".join(f"round(quantile_cont(price, {p}), 9) q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"(select {key}{q} from {source}{group})"


@query("price_class", on_apps(
    f"select \"appId\", {class_sql('price')} price_range_index from priced, {cuts_sql('priced')}",
    "priced as (select * from apps where price is not null)"))
def price_class(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price"]).dropna()
    return target.add_price_class(df, target.price_cuts(df)).select("appId", "price_range_index")


SPLIT_SQL = ("case when (('0x' || substr(md5(concat(\"appId\", '-0')), 1, 8))::bigint / 4294967296.0) < 0.75 "
             "then 'train' else 'test' end")


TRAIN = "(select * from parts where split = 'train')"


@query("price_class_fit_apply", on_apps(
    f"select \"appId\", split, {class_sql('price')} price_class from parts, {cuts_sql('(select * from parts where split = chr(116) || $$rain$$)')}".replace("$$", "'"),
    f"parts as (select *, {SPLIT_SQL} split from apps where price is not null)"))
def price_class_fit_apply(spark, sf_dir):
    parts = split.random_split(apps(spark, sf_dir, ["appId", "price"]).dropna(), "appId")
    cuts = target.price_cuts(parts.where("split = 'train'"))
    return target.add_price_class(parts, cuts, name="price_class").select("appId", "split", "price_class")


@query("price_class_by_category", on_apps(
    f"select \"appId\", p.category, {class_sql('price')} price_class from priced p join {cuts_sql('priced', 'category')} c "
    "on c.category = p.category", "priced as (select * from apps where price is not null and category is not null)"))
def price_class_by_category(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price", "category"]).dropna()
    cuts = target.price_cuts(df, by=["category"])
    return target.add_price_class_by(df, cuts, "category", {"price": "price_class"}).drop("price")


@query("price_class_fraction", on_apps(
    "select \"appId\", split, case when price <= q25 then 0.25 when price <= q50 then 0.5 when price <= q75 then 0.75 "
    "when price <= q100 then 1.0 else price end::double price_class from parts, (select quantile_cont(price, 0.25) q25, "
    "quantile_cont(price, 0.5) q50, quantile_cont(price, 0.75) q75, max(price) q100 from parts where split = 'train')",
    f"parts as (select *, {SPLIT_SQL} split from apps)"))
def price_class_fraction(spark, sf_dir):
    parts = split.random_split(apps(spark, sf_dir, ["appId", "price"]), "appId")
    return target.price_class_fraction(parts, parts.where("split = 'train'")).drop("price")


# --- encoding and scaling -----------------------------------------------------------

RATINGS = ["Everyone", "Everyone 10+", "Mature 17+", "Teen"]


@query("one_hot", on_apps(
    f"select \"appId\", {one_hot_sql('category', CATEGORY_LEVELS, MERGED)}, {one_hot_sql('contentRating', RATINGS)} from apps"))
def one_hot(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "category", "contentRating"])
    return encode.one_hot(df.withColumn("category", parse.rename_category(F.col("category"))),
                          ["category", "contentRating"])


@query("label_encode", on_apps(
    "select \"appId\", cast(dense_rank() over (order by c) - 1 as double) category_code, cast(r as double) rating_code from "
    "(select \"appId\", upper(category) c, case \"contentRating\" when 'Everyone' then 0 when 'Everyone 10+' then 1 "
    "when 'Mature 17+' then 2 when 'Teen' then 3 end r from apps where category is not null)"))
def label_encode(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "category", "contentRating"]).where("category is not null")
    df = df.withColumn("category", F.upper("category"))
    for column, name in (("category", "category_code"), ("contentRating", "rating_code")):
        df = encode.label_encode(df, encode.label_codes(df, column), column, name)
    return df.select("appId", *[F.col(c).cast("double").alias(c) for c in ("category_code", "rating_code")])


SCALED = ["starRating", "totalNrOfReviews", "libraries"]


@query("robust_minmax", on_apps(
    "select \"appId\", " + ", ".join(
        f"round((\"{c}\" - lo{i}) / case when hi{i} = lo{i} then 1 else hi{i} - lo{i} end, 6) \"{c}\"" for i, c in enumerate([*SCALED, 'one']))
    + " from parts, (select " + ", ".join(f"min(\"{c}\") lo{i}, max(\"{c}\") hi{i}" for i, c in enumerate([*SCALED, 'one']))
    + " from parts where split = 'train')",
    "parts as (select \"appId\", " + ", ".join(f"{number(chr(34) + c + chr(34))} \"{c}\"" for c in SCALED)
    + f", 1.0::double as one, {SPLIT_SQL} split from apps)"))
def robust_minmax(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", *SCALED])
    df = df.select("appId", *[parse.to_float(F.col(c)).alias(c) for c in SCALED], F.lit(1.0).alias("one"))
    parts = split.random_split(df, "appId")
    columns = [*SCALED, "one"]
    out = encode.min_max_scale(parts, parts.where("split = 'train'"), columns)
    return out.select("appId", *[r6(c).alias(c) for c in columns])


OUTLIERS = {"reviews": (1.5, 1.5), "price": (0.0, 0.2)}


@query("drop_outliers", on_apps(
    'select "appId", price, reviews from s1, (select quantile_cont(price, 0.25) q1, quantile_cont(price, 0.75) q3 from s1) '
    'where not coalesce(price > q3 + 0.2 * (q3 - q1), false)',
    f"s0 as (select \"appId\", price, {number('\"totalNrOfReviews\"')} reviews from apps)",
    "s1 as (select s0.* from s0, (select quantile_cont(reviews, 0.25) q1, quantile_cont(reviews, 0.75) q3 from s0) "
    "where not coalesce(reviews < q1 - 1.5 * (q3 - q1) or reviews > q3 + 1.5 * (q3 - q1), false))"))
def drop_outliers(spark, sf_dir):
    df = apps(spark, sf_dir, ["appId", "price", "totalNrOfReviews"])
    df = df.select("appId", "price", parse.to_float(F.col("totalNrOfReviews")).alias("reviews"))
    return encode.drop_outliers(df, OUTLIERS)


# --- feature selection --------------------------------------------------------------

FEATURES = ["starRating", "totalNrOfReviews", "libraries", "bigCompany", "daysSinceLastUpdated",
            "1starReviews", "2starReviews", "3starReviews", "4starReviews", "5starReviews",
            "requiredAndroidVersion_major", "requiredAndroidVersion_minor"]
_LONG = ("long as (select y, x.feature, x.v from (select y, unnest([" + ", ".join(
    f"{{'feature': '{c}', 'v': \"{c}\"::double}}" for c in FEATURES) + "]) x from labelled))")
_LABELLED = ("labelled as (select *, " + class_sql("price") + " y from learn, " + cuts_sql("learn") + ")")


def labelled(spark, sf_dir):
    df = cached_learn(spark, sf_dir)
    return target.add_price_class(df, target.price_cuts(df), name="price_class")


@query("select_k_best_chi2", on_apps(
    "select feature, round(sum((o - e) * (o - e) / nullif(e, 0)), 6) score from (select feature, y, sum(v) o, "
    "sum(sum(v)) over (partition by feature) * count(*) / sum(count(*)) over (partition by feature) e from long group by 1, 2) "
    "group by 1 order by score desc nulls last, feature limit 5", *LEARN_FROM, _LABELLED, _LONG))
def select_k_best_chi2(spark, sf_dir):
    scores = select_features.chi2_scores(labelled(spark, sf_dir), FEATURES, "price_class")
    return select_features.best_k(scores, 5).withColumn("score", r6("score"))


@query("select_k_best_f", on_apps(
    "select feature, round((ssb / (k - 1)) / nullif(ssw / (n - k), 0), 6) score from (select feature, sum(n) n, count(*) k, "
    "sum(n * (m - gm) * (m - gm)) ssb, sum(w) ssw from (select feature, y, count(*) n, avg(v) m, var_pop(v) * count(*) w, "
    "sum(sum(v)) over (partition by feature) / sum(count(*)) over (partition by feature) gm from long group by 1, 2) group by 1) "
    "order by score desc nulls last, feature limit 5", *LEARN_FROM, _LABELLED, _LONG))
def select_k_best_f(spark, sf_dir):
    scores = select_features.f_scores(labelled(spark, sf_dir), FEATURES, "price_class")
    return select_features.best_k(scores, 5).withColumn("score", r6("score"))


@query("select_k_best_freg", on_apps(
    "select feature, round(r * r / (1 - r * r) * (n - 2), 6) score from (select x.feature, "
    "case when min(x.v) < max(x.v) then corr(x.v, price) end r, count(*) n from "
    "(select price, unnest([" + ", ".join(f"{{'feature': '{c}', 'v': \"{c}\"::double}}" for c in FEATURES)
    + "]) x from learn) group by 1) order by score desc nulls last, feature limit 5", *LEARN_FROM))
def select_k_best_freg(spark, sf_dir):
    scores = select_features.f_regression_scores(cached_learn(spark, sf_dir), FEATURES, "price")
    return select_features.best_k(scores, 5).withColumn("score", r6("score"))
