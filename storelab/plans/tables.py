"""The two clean tables. Both read raw listings; they treat the same columns differently.

``learn_table`` drops rows without rating or reviews and keeps few, typed columns;
``report_table`` imputes more and ends in one-hot columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions import parse
from storelab.operators import clean, encode, impute, related, target
from storelab.operators.ordered import column_means, column_modes, column_quantiles
from storelab.session import cut

LEARN_SOURCE = ["appId", "price", "starRating", "totalNrOfReviews", "author", "lastUpdated",
                "description", "whatsNew", "installs", "category", "contentRating", "libraries",
                "reviewsPerStarRating", "requiredAndroidVersion", "similarApps"]
REPORT_SOURCE = [*LEARN_SOURCE, "name", "age", "offersInAppPurchases", "inAppProducts", "ranking",
                 "binarySize"]


def learn_filter(df: DataFrame) -> DataFrame:
    """Rows with a price, a rating and reviews; broken exports go first."""
    df = clean.drop_by_id(df)
    for column in ("price", "starRating", "totalNrOfReviews"):
        df = clean.drop_sentinel_cast(df, column, 0.0)
    return df


STARS = [f"{i + 1}starReviews" for i in range(5)]


def add_review_counts(df: DataFrame) -> DataFrame:
    df = df.withColumn("_counts", parse.review_counts(F.col("reviewsPerStarRating")))
    return df.withColumns({c: F.col("_counts")[i] for i, c in enumerate(STARS)}).drop("_counts")


def hide_empty_reviews(df: DataFrame) -> DataFrame:
    """All-zero review rows count as missing."""
    return impute.flagged_to_null(df, STARS, F.col("reviewsPerStarRating") == K.NO_REVIEWS)


def known_version(column: str) -> Column:
    """Required version with ``Varies with device`` as missing."""
    return F.nullif(F.col(column), F.lit(K.VARIES))


def add_version_numbers(df: DataFrame, top: Column, column: str = "requiredAndroidVersion") -> DataFrame:
    """Major and minor number; versions that are unknown or do not start with ``d.d`` (such
    as ``10 and up``) take ``top``, the most frequent ``d.d``."""
    head = parse.version_head(known_version(column))
    df = df.withColumn("_parts", parse.version_major_minor(F.coalesce(head, top)))
    return df.withColumns({f"{column}_major": F.col("_parts.major"),
                           f"{column}_minor": F.col("_parts.minor")}).drop("_parts")


def learn_table(apps: DataFrame, as_of: date | str, author_more_than: int = 10,
                require: Sequence[str] = (), with_text: bool = True) -> DataFrame:
    """Raw listings to the typed table of the learning runs, one row per listing kept.

    Rows whose date or review text is missing cannot be read and are left out, as are
    rows without a value in a ``require`` column (such as ``binarySize``). The rows are written
    once, as the listings may be costly joins; the statistics scan the few columns they need; all
    modes share one pass, as do all medians. ``with_text`` off leaves the texts unread.
    """
    df = learn_filter(apps).dropna(subset=["lastUpdated", "reviewsPerStarRating", *require]).drop(*require)
    if with_text:
        df = df.withColumn("text", parse.concat_text_blank([F.col(c) for c in K.LEARN_TEXT]))
    df = cut(df.drop(*K.LEARN_TEXT))
    catalogue = df.select("appId", "price", "similarApps")
    df = related.frequent_author_flag(df, author_more_than, "bigCompany", F.lit(1.0))
    df = df.withColumns({
        "daysSinceLastUpdated": parse.days_since(F.col("lastUpdated"), as_of).cast("double"),
        "installs": parse.merge_installs(F.col("installs")),
        "category": F.upper("category"),
        "contentRating": F.coalesce("contentRating", F.lit(K.UNRATED)),
        "libraries": F.col("libraries").try_cast("double"),
    })
    head = parse.version_head(F.col("requiredAndroidVersion"))
    modes = column_modes(df, {"installs": F.col("installs"), "category": F.col("category"), "version": head})
    df = df.withColumns({c: F.coalesce(c, modes[c]) for c in ("installs", "category")})
    df = add_version_numbers(df, modes["version"])
    df = impute.nulls_to_medians(hide_empty_reviews(add_review_counts(df)), ["libraries", *STARS])
    df = related.similar_avg_price(df, catalogue)
    return df.drop("author", "lastUpdated", "reviewsPerStarRating", "requiredAndroidVersion", "similarApps")


FEATURE_SETS = {
    "baseline": dict(drop=["appUrl"], complete=["similarAppsAvgPrice"]),
    "ml": dict(drop=["similarAppsAvgPrice", "appUrl"], complete=[]),
    "ml_per_category": dict(drop=["similarAppsAvgPrice", "appUrl", "installs", "contentRating"],
                            complete=[]),
}


def feature_set(table: DataFrame, name: str, check: bool = True) -> DataFrame:
    """The columns of one kind of run; no column may have missing values."""
    spec = FEATURE_SETS[name]
    df = table.drop(*spec["drop"])
    if spec["complete"]:
        df = df.dropna(subset=spec["complete"])
    return clean.assert_complete(df) if check else df


def add_star_shares(df: DataFrame, total: str) -> DataFrame:
    df = df.withColumn("_counts", parse.reviews_per_star(F.col("reviewsPerStarRating")))
    return df.withColumns({f"{i + 1}_star_reviews": parse.star_share(F.col("_counts")[i], F.col(total))
                           for i in range(5)}).drop("_counts")


def report_columns(apps: DataFrame, as_of: date | str, author_more_than: int = 1,
                   categories: Sequence[Sequence[str]] = (), one_game: bool = False,
                   ranges: bool = True) -> DataFrame:
    """Raw listings to the columns of the report runs, before one-hot encoding."""
    df = apps.dropna(subset=["price"]).withColumn("starRating", parse.to_float(F.col("starRating")))
    q = column_quantiles(df, {c: F.col(c) for c in ("price", "starRating")}, target.QUARTILES)
    df = df.withColumn("price_range_index", target.class_of(F.col("price"), *q["price"]))
    df = impute.fill_where(df, "starRating", F.col("starRating") == 0, q["starRating"][1])
    df = related.frequent_author_flag(df, author_more_than, "bigProvider")
    df = df.withColumns({"_range": parse.review_range(F.col("totalNrOfReviews")),
                         "totalNrOfReviews": parse.to_float(F.col("totalNrOfReviews"))})
    category = parse.group_categories(parse.rename_category(F.col("category")), categories)
    df = clean.drop_long_text(df, "author")
    df = df.withColumn("category", parse.game_as_one(category) if one_game else category)
    df = clean.drop_long_text(df, "reviewsPerStarRating")
    df = add_star_shares(df, "totalNrOfReviews").drop("reviewsPerStarRating")
    if ranges:
        df = df.withColumn("totalNrOfReviews", F.col("_range"))
    df = df.drop("_range").withColumns({
        "days_since_lastUpdated": parse.days_since(F.col("lastUpdated"), as_of, missing=0).cast("double"),
        "installs": F.coalesce("installs", F.lit(K.DEFAULT_INSTALLS)),
        **{f"requiredAndroidVersion_{d}": parse.version_digits(F.col("requiredAndroidVersion"))[d]
           for d in ("d1", "d2", "d3")}})
    df = df.withColumn("days_since_release", parse.days_since_release(F.col("age"), as_of).cast("double"))
    means = column_means(df, ["days_since_lastUpdated", "days_since_release"])
    df = impute.fill_where(df, "days_since_lastUpdated", F.col("days_since_lastUpdated") == 0,
                           means["days_since_lastUpdated"])
    df = impute.nulls_to_modes(df, [f"requiredAndroidVersion_{d}" for d in ("d1", "d2", "d3")])
    df = clean.drop_long_text(df, "contentRating")
    df = df.drop("lastUpdated", "requiredAndroidVersion", "inAppProducts")
    df = related.similar_price_stats(df)
    df = impute.nulls_to_means(df, [f"similarApps_{s}" for s in K.SIMILAR_STATS])
    size = parse.binary_size_kb(F.col("binarySize"))
    libraries = F.coalesce(parse.to_float(F.col("libraries")), F.lit(0.0))
    df = df.withColumns({
        "offersInAppPurchases": parse.in_app_flag(F.col("offersInAppPurchases")),
        "ranking": parse.ranking_label(F.col("ranking")),
        "binarySize": parse.binary_size_range(size) if ranges else size,
        "libraries": parse.positive_flag(libraries) if ranges else libraries,
        "days_since_release": F.coalesce("days_since_release", means["days_since_release"])}).drop("age")
    texts = [c for c in K.REPORT_TEXT if c in df.columns]
    return (df.withColumn("text", parse.concat_text_reverse([F.col(c) for c in texts]))
            .drop(*[c for c in texts if c != "name"]))


def report_table(apps: DataFrame, as_of: date | str, ranges: bool = True, **options) -> DataFrame:
    """The report columns with categories and ranges as one-hot columns."""
    df = report_columns(apps, as_of, ranges=ranges, **options)
    return encode.one_hot(df, K.ONE_HOT_COLUMNS + (K.ONE_HOT_NUMERIC if ranges else []))
