import pytest
from pyspark.sql import functions as F

from storelab.functions import parse


def values(spark, rows, make, schema="c string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r.v for r in df.select(make(F.col("c")).alias("v")).collect()]


@pytest.mark.parametrize("text,number", [
    ("N/A", 0.0), (" 4.5 ", 4.5), ("1.0d", 0.0), ("1e3", 1000.0), (None, None), ("nan", None), ("-2", -2.0)])
def test_to_float(spark, text, number):
    assert values(spark, [text], parse.to_float) == [number]


def test_days(spark):
    rows = ["September 4, 2016", "September 04, 2016", None, "soon"]
    assert values(spark, rows, lambda c: parse.days_since(c, "2016-09-10")) == [6, 6, None, None]
    assert values(spark, rows, lambda c: parse.days_since(c, "2016-09-10", missing=0)) == [6, 6, 0, None]
    assert values(spark, ["2014 November", "unknown"], lambda c: parse.days_since_release(c, "2014-11-11")) == [10, None]


def test_review_range(spark):
    rows = ["99", "100", "499", "500", "N/A", " ", None, "many"]
    assert values(spark, rows, parse.review_range) == [1, 2, 2, 3, 1, 1, 1, 1]


def test_installs(spark):
    rows = ["500,000 - 1,000,000", "5", "a - b", "1 - 2 - 3", None]
    out = values(spark, rows, parse.installs_min_max)
    assert [tuple(v) for v in out] == [(500000, 1000000), (5, 5), (0, 0), (0, 0), (0, 0)]


def test_version(spark):
    rows = ["4.0.3 and up", "4", "Varies with device", None]
    assert [tuple(v) for v in values(spark, rows, parse.version_digits)] == [
        (4, 0, 3), (4, 0, 0), (None,) * 3, (None,) * 3]
    out = values(spark, ["4.1 and up", "10.0", None], parse.version_major_minor)
    assert [tuple(v) for v in out] == [(4.0, 1.0), (None, None), (None, None)]
    assert values(spark, ["4.1 and up", "Varies"], parse.version_head) == ["4.1", None]


def test_prices_and_sizes(spark):
    rows = ["$0.99 - $49.99 per item", "$1.99 per item", None]
    assert [tuple(v) for v in values(spark, rows, parse.in_app_price_range)] == [
        (0.99, 49.99), (1.99, 1.99), (0.0, 0.0)]
    rows = ["1.5MB", "10.0 KB", "123MB", "5MB", "12MB", "N/A", None, "2.0 TB"]
    assert values(spark, rows, parse.binary_size_kb) == [1536.0, 10.0, 125952.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = [2999.0, 3000.0, 10000.0, 10001.0, 35000.0, 35001.0, None]
    assert values(spark, rows, parse.binary_size_range, "c double") == [1, 2, 2, 3, 3, 4, 1]


def test_labels(spark):
    assert values(spark, [None, "  ", "Top  ranked"], parse.ranking_label) == ["no_info", "other", "Top_ranked"]
    assert values(spark, ["Offers in-app purchases", None, "x"], parse.in_app_flag) == [1, 0, 0]
    assert values(spark, ["Casino", "Tools", None], parse.rename_category) == ["Puzzle", "Tools", None]
    groups = [["A", "B"], ["C", "A_B"]]
    assert values(spark, ["A", "C", "D"], lambda c: parse.group_categories(c, groups)) == ["C_A_B", "C_A_B", "D"]
    assert values(spark, ["ACTION", "TOOLS"], parse.game_prefix) == ["GAME-ACTION", "TOOLS"]


def test_reviews(spark):
    text = '[{"1":578440},{"2":411470},{"3":32410},{"4":2962},{"5":11951}]'
    assert values(spark, [text, None], parse.reviews_per_star) == [[578440, 411470, 32410, 2962, 11951], None]
    assert values(spark, [text, None], parse.review_counts) == [[578440.0, 411470.0, 32410.0, 2962.0, 11951.0], None]
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (None, 10.0)], "n double, t double")
    assert [r.v for r in df.select(parse.star_share(F.col("n"), F.col("t")).alias("v")).collect()] == [0.0, 0.5, None]


def test_ids(spark):
    for style in ("json", "strip"):
        assert values(spark, ['["a.b","c"]', "[]"], lambda c: parse.similar_ids(c, style)) == [["a.b", "c"], []]


def test_text(spark):
    df = spark.createDataFrame([("n", None, "d"), (None, "a", "d")], "name string, author string, descr string")
    cols = [F.col("name"), F.col("author"), F.col("descr")]
    assert [r.v for r in df.select(parse.concat_text_reverse(cols).alias("v")).collect()] == ["dnann", None]
    assert [r.v for r in df.select(parse.concat_text_blank(cols[1:]).alias("v")).collect()] == ["nan d", "a d"]
    df = spark.createDataFrame([(0.3444, 1.715), (0.2684, 1.281), (0.5, 1.0)], "f double, e double")
    assert [r.v for r in df.select(parse.score_text(F.col("f"), F.col("e")).alias("v")).collect()] == [
        "0.344 (1.72)", "0.268 (1.28)", "0.5 (1.0)"]
