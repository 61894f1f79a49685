import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelab.operators import (clean, encode, evaluate, impute, knn, profile, related, scoreboard,
                                select_features, split, target)
from storelab.operators.ordered import column_modes, quantiles, row_numbers, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one value half of that group."""
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", 5.0 if i % 6 == 0 else rnd.uniform(0, 100)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double").repartition(6).cache()


def test_running_totals(skewed):
    rows, df = skewed
    out = {r.id: r.s for r in running_totals(df, ["id"], {"s": F.col("v")}, ["g"]).collect()}
    seen = {}
    for i, g, v in rows:
        seen[g] = seen.get(g, 0.0) + v
        assert out[i] == pytest.approx(seen[g])
    assert len(out) == len(rows)


def test_row_numbers_without_groups(skewed):
    rows, df = skewed
    out = {r.id: r.row_number for r in row_numbers(df, [F.desc("id")]).collect()}
    assert out == {i: len(rows) - i for i in range(len(rows))}


@pytest.mark.parametrize("small", [0, 100_000])
def test_quantiles(skewed, small):
    rows, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for r in quantiles(df, "v", probs, ["g"], small=small).collect():
        assert r.q == pytest.approx(list(np.percentile([v for _, g, v in rows if g == r.g], [p * 100 for p in probs])))
    whole = quantiles(df, "v", probs, small=small).first().q
    assert whole == pytest.approx(list(np.percentile([v for _, _, v in rows], [p * 100 for p in probs])))


def test_quantile_paths_agree(skewed):
    """Both ways to work out a quantile give the same bits."""
    _, df = skewed
    df = df.withColumn("v", F.col("v") / 3)
    probs = [i / 37 for i in range(38)]
    for by in ([], ["g"]):
        small, large = (sorted(map(str, quantiles(df, "v", probs, by, small=n).collect())) for n in (100_000, 0))
        assert small == large


def test_quartile_of_few(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "v double")
    for small in (0, 10):
        assert quantiles(df, "v", [0.25], small=small).first().q == [1.75]


def test_modes_break_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2), ("a", None)], "x string, y int")
    modes = column_modes(df, {"x": F.col("x"), "y": F.col("y")})
    row = df.select(modes["x"].alias("x"), modes["y"].alias("y")).first()
    assert (row.x, row.y) == ("a", "2")


# --- lookups ------------------------------------------------------------------------

def listings(spark, rows):
    return spark.createDataFrame(rows, "appId string, price double, similarApps string")


def test_similar_prices(spark):
    df = listings(spark, [("a", 1.0, "[]"), ("b", 4.0, None), ("t", 9.0, '["a","a","b"]'), ("u", 2.0, '["zz"]'),
                          ("d", 3.0, '["a"]'), ("d", 5.0, '["d"]')])
    stats = {(r.appId, r.price): r for r in related.similar_price_stats(df).collect()}
    t = stats["t", 9.0]
    assert (t.similarApps_count, t.similarApps_mean, t.similarApps_min, t.similarApps_max) == (2.0, 2.5, 1.0, 4.0)
    assert t.similarApps_std == pytest.approx(np.std([1, 4], ddof=1))
    # an id found twice counts twice here and is skipped in the average
    assert stats["d", 5.0].similarApps_count == 2.0 and stats["d", 5.0].similarApps_mean == 4.0
    assert stats["u", 2.0].similarApps_count == 0.0 and stats["u", 2.0].similarApps_mean is None
    assert stats["a", 1.0].similarApps_count == 0.0 and stats["b", 4.0].similarApps_count is None
    avg = {(r.appId, r.price): r.similarAppsAvgPrice for r in related.similar_avg_price(df).collect()}
    assert avg["t", 9.0] == 2.0 and avg["d", 5.0] is None and avg["u", 2.0] is None and avg["a", 1.0] is None
    assert len(avg) == 6


def test_similar_prices_with_hot_id(spark):
    """Every listing names the same app; lists that repeat are worked out once."""
    rows = [(f"a{i}", float(i % 50), '["a1","a%d"]' % (i % 20)) for i in range(600)]
    out = related.similar_avg_price(listings(spark, rows)).collect()
    price = {a: p for a, p, _ in rows}
    assert len(out) == 600
    for r in out:
        i = int(r.appId[1:]) % 20
        assert r.similarAppsAvgPrice == pytest.approx((price["a1"] + price[f"a{i}"]) / 2)


def test_frequent_authors(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "author string")
    out = related.frequent_author_flag(df, 1, "big").collect()
    assert sorted((r.author or "", r.big) for r in out) == [("", 0), ("", 0), ("x", 1), ("x", 1), ("y", 0)]


# --- cleaning, target, encoding -----------------------------------------------------

def test_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", 0.0)], "k string, v double")
    with pytest.raises(ValueError, match="v \\(1\\)"):
        clean.assert_complete(df)
    with pytest.raises(ValueError, match="do not occur"):
        clean.filter_isin_checked(df, "k", ["a", "z"])
    assert [r.k for r in clean.drop_sentinel(df, "v", 0.0).collect()] == ["a"]
    assert clean.sentinel_counts(df, "v", 0.0).first().asDict() == {"dropped": 2, "kept": 1}
    assert clean.min_support(df, "k", 2).count() == 2


def test_long_text_keeps_null(spark):
    df = spark.createDataFrame([("x" * 81,), ("x",), (None,)], "author string")
    assert clean.drop_long_text(df, "author").count() == 2


def test_price_class(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)] + [(None,)], "price double")
    out = target.add_price_class(df, target.price_cuts(df), name="c").collect()
    assert [r.c for r in sorted(out, key=lambda r: r.price or 99)] == [1, 1, 2, 2, 3, 3, 4, 4, None]
    cuts = spark.createDataFrame([(2.0, 4.0, 6.0)], "q25 double, q50 double, q75 double")
    out = {r.price: r.c for r in target.add_price_class(df, cuts, name="c").collect()}
    assert (out[2.0], out[4.0], out[6.0], out[7.0]) == (1, 2, 3, 4)


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 7.0), (10.0, 7.0), (20.0, 7.0)], "x double, c double")
    out = encode.min_max_scale(df, df.where("x < 20"), ["x", "c"]).orderBy("x").collect()
    assert [(r.x, r.c) for r in out] == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]


def test_outliers_take_new_quartiles(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    b[:60] += 8 * np.sign(a[:60]) * (np.abs(a[:60]) > 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    keep = np.ones(400, bool)
    for v in (a, b):
        q1, q3 = np.percentile(v[keep], [25, 75])
        keep &= (v >= q1 - 0.5 * (q3 - q1)) & (v <= q3 + 0.5 * (q3 - q1))
    out = encode.drop_outliers(df, {"a": (0.5, 0.5), "b": (0.5, 0.5)}).collect()
    assert sorted(r.a for r in out) == pytest.approx(sorted(a[keep]))


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, c string")
    out = {r.id: (r.c_a, r.c_b) for r in encode.one_hot(df, ["c"]).collect()}
    assert out == {1: (0, 1), 2: (1, 0), 3: (0, 0)}
    with pytest.raises(ValueError, match="more than 1"):
        encode.one_hot(df, ["c"], limit=1)
    codes = encode.label_codes(df, "c")
    assert {r.c: r.code for r in codes.collect()} == {"a": 0, "b": 1}
    unseen = spark.createDataFrame([(1, "z")], "id int, c string")
    with pytest.raises(Exception, match="unseen value"):
        encode.label_encode(unseen, codes, "c", "n").collect()


def test_chi2_and_f(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 200)
    x = rng.integers(0, 5, 200) + y
    df = spark.createDataFrame([(int(a), float(b), 1.0) for a, b in zip(y, x)], "y int, x double, one double")
    total, share = x.sum(), np.array([(y == k).mean() for k in range(3)])
    seen = np.array([x[y == k].sum() for k in range(3)])
    chi2 = ((seen - share * total) ** 2 / (share * total)).sum()
    scores = {r.feature: r.score for r in select_features.chi2_scores(df, ["x", "one"], "y").collect()}
    assert scores["x"] == pytest.approx(chi2)
    groups = [x[y == k] for k in range(3)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (200 - 3)
    assert select_features.f_scores(df, ["x"], "y").first().score == pytest.approx(between / within)
    r = np.corrcoef(x, y)[0, 1]
    found = {s.feature: s.score for s in select_features.f_regression_scores(df, ["x", "one"], "y").collect()}
    assert found["x"] == pytest.approx(r * r / (1 - r * r) * 198) and found["one"] is None


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bin, r["count"]) for r in profile.histogram(df, "v").collect()] == [(5, 2)]


def test_imputed_zeros_count(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (4.0,), (None,)], "v double")
    assert sorted(r.v for r in impute.zeros_to_mean(df, "v").collect() if r.v is not None) == [1.0, 1.0, 1.0, 4.0]


# --- folds --------------------------------------------------------------------------

def test_fold_sizes(spark):
    df = spark.createDataFrame([(i, "x") for i in range(12)], "id int, y string")
    folds = [r.fold for r in split.stratified_folds(df, "y", "id", 5).orderBy("id").collect()]
    assert folds == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]
    few = split.stratified_folds(df.where("id < 3"), "y", "id", 5).orderBy("id").collect()
    assert [r.fold for r in few] == [1, 2, 3]


def test_random_split_is_repeatable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = split.random_split(df, "k", seed=4).where("split = 'train'")
    b = split.random_split(df.repartition(7), "k", seed=4).where("split = 'train'")
    assert a.exceptAll(b).count() == 0 and 1400 < a.count() < 1600


# --- neighbours ---------------------------------------------------------------------

@pytest.mark.parametrize("block_rows", [40, 10_000])
def test_neighbours(spark, block_rows):
    """A third of the vectors are copies; blocks give the same as one block."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(240, 4)).round(1)
    v[::3] = v[0]
    rows = [(i, [float(x) for x in v[i]], int(i % 4)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, v array<float>, y int")
    train, test = df.where("id >= 60"), df.where("id < 60")
    found = {}
    for r in knn.neighbours(train, test, 5, "id", "v", "y", block_rows).collect():
        found.setdefault(r.row, []).append((r.rank, r.near))
    v32 = v.astype("float32").astype("float64")
    for i in range(60):
        d = np.sqrt(((v32[60:] - v32[i]) ** 2).sum(1))
        best = sorted(range(180), key=lambda j: (d[j], j))[:5]
        assert [n for _, n in sorted(found[i])] == [j + 60 for j in best]


def test_neighbours_skip_far_cells(spark):
    """In separate clumps most cells are left out, and what is found equals a full search."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (12, 3))
    v = np.concatenate([centres[i % 12] + rng.normal(0, 1, (1, 3)) for i in range(900)])
    df = spark.createDataFrame([(i, v[i].tolist(), i % 4) for i in range(900)], "id int, v array<double>, y int")
    train, test = df.where("id >= 100"), df.where("id < 100")
    index = knn.PivotIndex(train, "id", "v", "y", block_rows=50, pivots=40)
    rows = test.select(F.col("id").alias("row"), "v")
    first = index.first_visits(rows, 5).count()
    found = {}
    for r in index.search(test, "id", "v", 5).collect():
        found.setdefault(r.row, []).append((r.rank, r.near, r.distance))
    for i in range(100):
        d = np.sqrt(((v[100:] - v[i]) ** 2).sum(1))
        best = sorted(range(800), key=lambda j: (d[j], j))[:5]
        assert [n for _, n, _ in sorted(found[i])] == [j + 100 for j in best]
    bounds = spark.createDataFrame([(i, max(x[2] for x in found[i])) for i in found], "row int, bound double")
    further = index.further_visits(rows.join(bounds, "row"), 5).count()
    assert first + further < 0.25 * 100 * len(index.pivots)


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i)], i) for i in range(3)], "id int, v array<double>, y int")
    assert knn.neighbours(df, df, 5, "id", "v", "y").count() == 9
    assert knn.neighbours(df.where("id > 9"), df, 5, "id", "v", "y").count() == 0
    assert knn.neighbours(df, df.where("id > 9"), 5, "id", "v", "y").count() == 0


# --- scores against published tables ------------------------------------------------

# Published predictions of the baseline, as (target, prediction): rows.
SOCIAL = {(1, 1): 10, (1, 2): 12, (1, 4): 15, (2, 1): 3, (2, 2): 10, (2, 3): 1, (2, 4): 26, (3, 1): 1, (3, 2): 1,
          (3, 4): 1, (4, 1): 4, (4, 2): 3, (4, 4): 18}
WEATHER = {(1, 1): 9, (1, 2): 30, (1, 3): 28, (1, 4): 9, (2, 2): 5, (2, 3): 47, (2, 4): 22, (3, 1): 1, (3, 3): 29,
           (3, 4): 7, (4, 1): 1, (4, 2): 1, (4, 3): 25, (4, 4): 34}
# Published confusion counts of the boosted model without text.
REPORT = {(1, 1): 394, (1, 2): 195, (1, 3): 43, (1, 4): 185, (2, 1): 271, (2, 2): 264, (2, 3): 61, (2, 4): 189,
          (3, 1): 148, (3, 2): 136, (3, 3): 69, (3, 4): 179, (4, 1): 160, (4, 2): 111, (4, 3): 49, (4, 4): 390}


def pairs(spark, cells, category):
    df = spark.createDataFrame([(category, a, b, n) for (a, b), n in cells.items()],
                               "Category string, y_eval int, y_pred int, n int")
    return df.select("Category", "y_eval", "y_pred", F.explode(F.sequence(F.lit(1), "n")).alias("i")).drop("i")


def test_published_scores(spark):
    rows = pairs(spark, SOCIAL, "SOCIAL").unionByName(pairs(spark, WEATHER, "WEATHER"))
    got = {r.Category: r for r in scoreboard.score_rows(rows).collect()}
    for name, f1, prec, rec, err, text in [
            ("SOCIAL", 0.3444189797130974, 0.41371591371591376, 0.3619047619047619, 1.715, "0.344 (1.72)"),
            ("WEATHER", 0.2684156912358578, 0.4418668587601446, 0.31048387096774194, 1.281, "0.268 (1.28)")]:
        r = got[name]
        assert (r.f1, r.prec, r.rec, r.acc) == pytest.approx((f1, prec, rec, rec), abs=1e-9)
        assert r.err == err and r.combined == text


def test_published_report(spark):
    cells = evaluate.confusion(pairs(spark, REPORT, "x"))
    report = {r.label: r for r in evaluate.class_report(cells).collect()}
    shown = {k: tuple(round(v, 2) for v in (r.precision, r.recall, r.f1)) + (r.support,) for k, r in report.items()}
    assert shown == {"1": (0.40, 0.48, 0.44, 817), "2": (0.37, 0.34, 0.35, 785), "3": (0.31, 0.13, 0.18, 532),
                     "4": (0.41, 0.55, 0.47, 710), "avg / total": (0.38, 0.39, 0.38, 2844)}
    first = evaluate.confusion_percent(cells).collect()
    assert first[0].error_type == 3
    share = {(r.target, r.predict): r.percent for r in first}
    assert share[1, 1] == pytest.approx(0.482252, abs=1e-6) and share[4, 4] == pytest.approx(0.549296, abs=1e-6)
    assert evaluate.accuracy(pairs(spark, REPORT, "x")).first().accuracy == pytest.approx(0.392756680731)


def test_board_leaves_unknown_category_out(spark):
    board = spark.createDataFrame([(0, "SOCIAL", 0.1)], "Runs int, Category string, m___f1 double")
    scores = scoreboard.score_rows(pairs(spark, WEATHER, "WEATHER"))
    assert [r.m___f1 for r in scoreboard.update(board, scores, "m").collect()] == [0.1]
    added = scoreboard.update(board, scores, "m", insert=True)
    assert sorted(r.Category for r in added.collect()) == ["SOCIAL", "WEATHER"]
    assert scoreboard.long_form(added.select("Category", "m___f1")).count() == 2


def test_roc(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = (rng.normal(size=300) + y).round(1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = evaluate.roc_auc(evaluate.roc_points(df, "y", "s")).first().auc
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc == pytest.approx(wins)


def test_explained_variance(spark):
    t, p = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.0, 3.0, 3.0, 5.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "target double, predicted double")
    assert evaluate.explained_variance(df).first()[0] == pytest.approx(1 - np.var(t - p) / np.var(p))
    assert evaluate.explained_variance(df, swapped=False).first()[0] == pytest.approx(1 - np.var(t - p) / np.var(t))


def test_join_groups_is_the_same_both_ways(spark, monkeypatch):
    from storelab.operators import lookup
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1), ("rare", 2), ("gone", 3)], "k string, v int")
    groups = spark.createDataFrame([("hot", 1.0), ("rare", 2.0)], "k string, n double")
    for how in ("inner", "left", "left_semi"):
        small = sorted(map(str, lookup.join_groups(df, groups, "k", how).collect()))
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        assert sorted(map(str, lookup.join_groups(df, groups, "k", how).collect())) == small
        monkeypatch.undo()
        assert len(small) == (503 if how == "left" else 501)


def test_vocabulary_is_not_cut(spark):
    from storelab.operators.models import TfIdf
    df = spark.range(300).select(F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999),
                                             lambda x: x.cast("string")).alias("tokens"))
    model = TfIdf().fit(df)
    assert model.fact("size") == 300_000
    assert model.tables["terms"].agg(F.countDistinct("place"), F.max("place")).first()[:] == (300_000, 299_999)
    assert {r.features.size for r in model.transform(df.limit(2)).collect()} == {300_000}
