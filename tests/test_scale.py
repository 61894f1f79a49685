"""Steps that must not grow faster than their input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelab.operators import knn, lookup, models, terms, text, tuning
from storelab.operators.table_model import ROW, numbered


def test_tokens_counted_inside_rows(spark):
    rows = [(1, ["b", "a", "b", None, "c c"]), (2, []), (3, None), (4, ["a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>").select("id", text.counted(F.col("t")).alias("x"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r.x for r in df.collect()}
    for i, t in rows:
        want = None if t is None else sorted(Counter(w for w in t if w is not None).items())
        assert (found[i] and [tuple(x) for x in found[i]]) == (want or found[i])


def test_join_groups_gathers_no_copies(spark, monkeypatch):
    """Copies of many groups go to the rows by a shuffle, however small their table is on disk."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    rows = spark.range(2_000).select((F.col("id") % 500).alias("k"), "id")
    groups = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("m"))
    for how in ("inner", "left", "left_semi"):
        found = lookup.join_groups(rows, groups, "k", how)
        assert found.count() == (2_000 if how == "left" else 1_600)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_join_terms_sends_rare_terms_once(spark, monkeypatch):
    """Beyond what is broadcast, copies are made of frequent terms alone, and no row is lost."""
    monkeypatch.setattr(terms, "POSTING_ROWS", 10)
    rows = spark.range(300).select(F.col("id").alias(ROW), F.explode(F.array(
        F.lit("every"), F.concat(F.lit("t"), (F.col("id") % 100).cast("string")))).alias("token"))
    known = rows.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.lit(1.0))
    far = terms.join_terms(rows, known, broadcast_rows=0)
    near = terms.join_terms(rows, known)
    assert sorted(map(tuple, far.select(ROW, "token", "df").collect())) == sorted(map(tuple, near.select(ROW, "token", "df").collect()))
    assert far.count() == 600
    copies = known.withColumn("n", F.greatest(F.ceil(F.col("df") / 10), F.lit(1))).agg(F.sum("n")).first()[0]
    assert copies == 130 and "32" not in re.findall(r"sequence\(0, (\d+)", far._jdf.queryExecution().toString())


@pytest.mark.parametrize("block", [50, 4_000_000])
def test_neighbours_keep_k_rows_of_a_block(spark, monkeypatch, block):
    """Documents that share a frequent word with every question do not become rows in pairs."""
    monkeypatch.setattr(terms, "BLOCK_TERMS", block)
    docs = spark.range(400).select(
        F.col("id"), (F.col("id") % 2).cast("double").alias("label"),
        F.array(F.lit("every"), F.concat(F.lit("w"), (F.col("id") % 40).cast("string"))).alias("tokens"))
    model = terms.TermNeighbours(k=3, keyCol="id").fit(docs)
    asked = numbered(docs.where("id < 40"))
    found = model._near(model.asked(asked))
    assert found.groupBy("row", F.col("doc")).count().where("count > 1").count() == 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-800 // block) * -(-80 // block)) * 2
    assert found.count() <= 40 * 3 * blocks
    names = {r[ROW]: r.id for r in asked.collect()}
    for r in model.search(asked).collect():
        assert r.near % 40 == names[r.row] and abs(r.distance) < 1e-6 and r.near == names[r.row] + 40 * (r["rank"] - 1)


def _listings(spark, n=60):
    return spark.range(n).select(
        F.col("id").cast("string").alias("appId"), (F.col("id") % 3 + 1).cast("int").alias("fold"), (F.col("id") % 2).cast("double").alias("label"),
        F.col("id").cast("double").alias("a"), F.array(F.lit("w"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("tokens"),
        F.repeat(F.lit("long text "), 10).alias("text"))


def test_only_read_columns_are_written(spark, monkeypatch):
    """Texts and tokens are not written again by searches and cross-validation that do not read them."""
    written = []
    cut = tuning.cut
    monkeypatch.setattr(tuning, "cut", lambda df, *by: written.append(df.columns) or cut(df, *by))
    df, spec = _listings(spark), dict(kind="tree", depth=2)
    out = tuning.cross_val_predict(df, lambda: models.pipeline(spec, ["a"]), 3, keep=["appId"])
    assert out.count() == 60 and set(out.columns) == {"appId", "fold", "label", "prediction", "y_pred", "y_eval"}
    found, _ = tuning.search_steps(df, lambda c: models.pipeline_steps(c, ["a"]), [spec], 3)
    assert found.count() == 6
    assert tuning.search(df, lambda c: models.pipeline(c, ["a"]), [spec], 3).count() == 6
    assert tuning.learning_curve(df, lambda: models.pipeline(spec, ["a"]), "appId", sizes=(0.5, 1.0), folds=3).count() == 4
    assert written and not any({"text", "tokens"} & set(c) for c in written)


def test_steps_behind_text_read_few_columns(spark, monkeypatch):
    """The text step is written once without its tokens; the fitted pipeline says the same as a plain one."""
    written = []
    cut = tuning.cut
    monkeypatch.setattr(tuning, "cut", lambda df, *by: written.append(df.columns) or cut(df, *by))
    df = _listings(spark)
    stages = [models.TextPrediction([dict(kind="multinomial")], dict(minDF=0.0), "said"),
              *models.pipeline(dict(kind="tree", depth=2), ["a", "said"]).getStages()]
    fitted = tuning.fit_stages(stages, df)
    assert [set(c) for c in written] == [{"a", "label", "said"}]
    want = models.Pipeline(stages=stages).fit(df).transform(df).select("appId", "prediction").collect()
    assert sorted(fitted.transform(df).select("appId", "prediction").collect()) == sorted(want)


def test_number_table_has_no_text(spark, sf_dir):
    """Models on numbers get the same rows, classes and folds as the others, without texts."""
    from storelab.plans import queries_models
    numbers, every = queries_models.number_table(spark, sf_dir), queries_models.model_table(spark, sf_dir)
    assert {"text", "tokens"} <= set(every.columns) and not {"text", "tokens"} & set(numbers.columns)
    columns = ["appId", "price_class", "label", "fold"]
    assert sorted(numbers.select(columns).collect()) == sorted(every.select(columns).collect())


def test_closest_measures_few_rows(monkeypatch):
    """The same neighbours as a full measurement, with distances of a few rows alone; copies count in order."""
    rng = np.random.default_rng(4)
    base, points = rng.normal(size=(500, 8)), rng.normal(size=(20, 8))
    base[300:310] = base[5]
    points[0] = base[5]
    want = knn._distances(base, points)
    measured = []
    plain = knn._distances
    monkeypatch.setattr(knn, "_distances", lambda b, p: measured.append(len(b)) or plain(b, p))
    own, pick, d = knn._closest(base, points, 5)
    for i in range(20):
        order = np.argsort(want[i], kind="stable")[:5]
        assert list(pick[own == i]) == list(order) and list(d[own == i]) == list(want[i][order])
    assert sum(measured) < 20 * 20


def test_tfidf_counts_once(spark):
    """Words are counted once, for the shares of documents and for the weights."""
    docs = spark.createDataFrame([(i, f"word{i % 2} every") for i in range(6)], "id int, text string")
    counts = text.term_counts(docs, "id", text.tokens(F.col("text")))
    plan = text.tfidf(counts, docs, "id", 0.25, 0.75)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert text.tfidf(counts, docs, "id", 0.25, 0.75).count() == 6


def test_stems_of_frequent_and_rare_words_agree(spark):
    """Rare words are joined, frequent ones sent to the rows; stop words, repeated keys and empty texts as before."""
    rows = [(i, f"the cats run running apples{i} w{i % 3} w{i % 3}") for i in range(30)] + [(3, "the cat ponies"), (40, ""), (41, None)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    near, far = [text.stemmed_words(docs, "id", "text", broadcast_rows=n).groupBy("id", "token").agg(F.sum("tf").alias("tf")) for n in (1000, 3)]
    found = sorted(map(tuple, near.collect()))
    assert found == sorted(map(tuple, far.collect())) == sorted(map(tuple, text.stemmed_counts(docs, "id", "text").collect()))
    assert {t: n for i, t, n in found if i == 3} == {"cat": 2, "run": 2, "apples3": 1, "w0": 2, "poni": 1}
    plan = text.stemmed_documents(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan  # no occurrence of a frequent word is shuffled by its word


def test_arrays_are_worked_out_once(spark):
    """An inner explode adds a filter that works the tokens out again."""
    docs = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "id int, text string")
    for df in (text.term_counts(docs, "id", text.words(F.col("text"))), text.vocabulary(docs, "text")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    assert sorted(map(tuple, text.term_counts(docs, "id", text.words(F.col("text"))).collect())) == [(1, "a", 1), (1, "b", 2)]


def test_learning_table_reads_listings_once(spark, sf_dir):
    """All statistics and the rows come from one pass over the joined listings; texts only where asked for."""
    from storelab.plans import tables
    from storelab.plans.registry import AS_OF
    from storelab.sources.apps import apps
    raw, n = apps(spark, sf_dir, tables.LEARN_SOURCE), spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (n.add(1), x)[1], "string")
    rows = raw.count()
    listed = raw.withColumn("requiredAndroidVersion", seen("requiredAndroidVersion"))
    full = tables.learn_table(listed, AS_OF)
    numbers = tables.learn_table(raw, AS_OF, with_text=False)
    assert sorted(map(str, full.drop("text").collect())) == sorted(map(str, numbers.collect()))
    assert 0 < n.value <= rows and "text" in full.columns and "text" not in numbers.columns
