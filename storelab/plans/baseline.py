"""The baseline run: predict the price class of the average related price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.operators import clean, impute, related, scoreboard, target
from storelab.session import cut

SOURCE = ["appId", "price", "category", "similarApps"]
ALL = "all"


def priced_listings(apps: DataFrame) -> DataFrame:
    """Listings with a price, an upper-case category and the related average price."""
    df = clean.drop_sentinel(apps, "price", 0.0).withColumn("category", F.upper("category"))
    df = impute.nulls_to_modes(df, ["category"])
    df = related.similar_avg_price(df).dropna(subset=["similarAppsAvgPrice"])
    return df.select("appId", "price", "category", "similarAppsAvgPrice")


def baseline_predictions(listings: DataFrame, min_rows: int = 100) -> DataFrame:
    """``y_eval`` and ``y_pred`` for the whole set and for each category with enough rows.

    Cuts are fitted on all rows of a subset and used for the price and for the average.
    Every row is in two subsets, so one pass serves all of them.
    """
    tagged = listings.select(*[c for c in listings.columns if c != "category"],
                             F.explode(F.array(F.lit(ALL), F.col("category"))).alias("Category"))
    subsets = clean.min_support(tagged, "Category", min_rows)
    cuts = target.price_cuts(subsets, by=["Category"])
    return target.add_price_class_by(subsets, cuts, "Category", {
        "price": "y_eval", "similarAppsAvgPrice": "y_pred"})


def baseline_scoreboard(apps: DataFrame, min_rows: int = 100) -> DataFrame:
    """Scores of the baseline per category."""
    return scoreboard.score_rows(baseline_predictions(cut(priced_listings(apps)), min_rows))
