import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from storelab.operators import text
from storelab.operators.models import TextPrediction, TfIdf, pipeline
from storelab.operators.table_model import ROW, numbered
from storelab.operators.terms import TermBayes, TermNeighbours
from storelab.session import scratch_path

# Examples of the published stemming algorithm.
STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz
failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit radicalli radic vileli vile operator oper feudalism feudal hopefulness hope formaliti formal
sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv allowance allow
airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt homologous homolog effective effect
probate probat rate rate cease ceas controll control roll roll dying die news news geology geolog us us""".split()


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS[::2]], "word string")
    got = {r.word: r.stem for r in text.add_stem(df, "word").collect()}
    assert got == dict(zip(STEMS[::2], STEMS[1::2]))


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first().v


def test_tokens(spark):
    assert one(spark, "A Größe, x_1 I don't\\nknow", text.tokens) == ["größe", "x_1", "don", "nknow"]
    assert one(spark, "A b\\nc", text.words) == ["a", "b", "c"]
    kept = one(spark, "the cat and the other dog", lambda c: text.without_stop_words(text.tokens(c)))
    assert kept == ["cat", "dog"]


def test_ngrams(spark):
    assert one(spark, "aa bb cc", lambda c: text.ngrams(text.tokens(c))) == ["aa bb", "bb cc", "aa bb cc"]
    assert one(spark, "aa", lambda c: text.ngrams(text.tokens(c))) == []


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "apple pears", 0.0), (2, "apple apple plum", 0.0), (3, "grape plum", 1.0), (4, "grape grape", 1.0)]
    return spark.createDataFrame(rows, "id int, text string, label double")


def test_tfidf(docs):
    counts = text.term_counts(docs, "id", text.tokens(F.col("text")))
    weights = {(r.id, r.token): r.weight for r in text.tfidf(counts, docs, "id").collect()}
    common, rare = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert common == pytest.approx(1.5108, abs=1e-4)
    assert weights[1, "apple"] == pytest.approx(common / math.hypot(common, rare))
    limited = text.tfidf(counts, docs, "id", 0.4, 0.6, binary=True)
    assert {r.token for r in limited.collect()} == {"apple", "plum", "grape"}
    tokens = docs.withColumn("tokens", text.tokens(F.col("text")))
    vectors = TfIdf().fit(tokens).transform(tokens).select("id", vector_to_array("features").alias("v"))
    for r in vectors.collect():
        assert sorted(x for x in r.v if x) == pytest.approx(sorted(w for (i, _), w in weights.items() if i == r.id))


def test_limits_without_tokens(docs):
    with pytest.raises(ValueError, match="widen the limits"):
        TfIdf(minDF=0.9, maxDF=0.95).fit(docs.withColumn("tokens", text.tokens(F.col("text"))))


def test_text_prediction(docs):
    tokens = text.stemmed_documents(docs, "id", "text")
    model = TextPrediction([dict(kind="multinomial"), dict(kind="tree")], dict(minDF=0.0, maxDF=1.0)).fit(tokens)
    out = model.transform(tokens).collect()
    assert all(r.textFeaturePrediction == r.label for r in out)


# --- text models --------------------------------------------------------------------

def bags(seed, n, words=60, longest=12):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [[f"w{w}" for w in rng.choice(words, rng.integers(0, longest), p=p / p.sum())] for _ in range(n)]


def vectors(train, docs):
    df = Counter(t for d in train for t in set(d))
    idf = {t: math.log((1 + len(train)) / (1 + c)) + 1 for t, c in df.items()}
    out = []
    for d in docs:
        v = {t: c * idf[t] for t, c in Counter(d).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / length for t, x in v.items()})
    return out, idf


def frame(spark, docs, start=0):
    rows = [(start + i, d, float(i % 3)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "id int, tokens array<string>, label double").repartition(4, "id")


@pytest.mark.parametrize("k,weights", [(1, "uniform"), (10, "uniform"), (20, "distance"), (200, "uniform")])
def test_term_neighbours(spark, k, weights):
    """The same neighbours as a full search; empty documents, copies and unknown words included."""
    train, test = bags(1, 150) + [[], [], ["w1", "w1"], ["w1"]], bags(2, 40) + [[], ["new"], ["w1"]]
    v, _ = vectors(train, train)
    q, _ = vectors(train, test)
    model = TermNeighbours(k=k, weights=weights, keyCol="id").fit(frame(spark, train))
    docs = numbered(frame(spark, test))
    names = {r[ROW]: r.id for r in docs.collect()}
    found = {}
    for r in model.search(docs).collect():
        found.setdefault(names[r.row], []).append((r["rank"], r.near, r.distance))
    for i, one in enumerate(q):
        def distance(other):
            product = round(sum(x * other.get(t, 0) for t, x in one.items()), 12)
            return math.sqrt(max(bool(one) + bool(other) - 2 * product, 0))
        best = sorted((round(distance(o), 9), j) for j, o in enumerate(v))[:k]
        assert [(n, round(d, 9)) for _, n, d in sorted(found[i])] == [(j, d) for d, j in best]
    assert model.transform(frame(spark, test)).where("prediction is null").count() == 0


def test_term_neighbours_skip_terms(spark):
    """Terms that cannot lift a product to the k-th best are left out of the search."""
    docs = bags(3, 150, 200, 30)
    model = TermNeighbours(k=3, keyCol="id").fit(frame(spark, docs * 3))
    asked = model.essential(model.questions(numbered(frame(spark, [d + ["w1"] for d in docs[:40]]))))
    every, needed = asked.agg(F.sum("df"), F.sum(F.when((F.col("goal") == 0) | (F.col("rest") >= F.col("goal")), F.col("df")))).first()
    assert needed < 0.7 * every


def test_term_bayes(spark):
    train, test = bags(5, 90), bags(6, 40) + [[], ["new"]]
    v, idf = vectors(train, train)
    q, _ = vectors(train, test)
    labels = [i % 3 for i in range(len(train))]
    sums = [Counter() for _ in range(3)]
    for x, c in zip(v, labels):
        sums[c].update(x)

    def score(one, c):
        total = sum(sums[c].values()) + 0.5 * len(idf)
        return math.log(labels.count(c) / len(labels)) + sum(x * math.log((sums[c][t] + 0.5) / total) for t, x in one.items())

    plain = [max(range(3), key=lambda c: (score(one, c), -c)) for one in q]
    model = TermBayes(smoothing=0.5).fit(frame(spark, train))
    assert [r.prediction for r in model.transform(frame(spark, test)).orderBy("id").collect()] == plain


def test_stored_text_models(spark):
    """An unfitted and a fitted pipeline give the same predictions after loading."""
    train, test = frame(spark, bags(7, 60)), frame(spark, bags(8, 30))
    specs = [dict(kind="multinomial"), dict(kind="knn", k=3), dict(kind="tree", depth=2)]
    for chosen in (specs[:1], specs[1:2], specs[2:], specs):
        made = Pipeline(stages=[TextPrediction(chosen, dict(minDF=0.0))])
        fitted = made.fit(train)
        paths = [scratch_path(spark, "stored") for _ in range(2)]
        made.write().save(paths[0])
        fitted.write().save(paths[1])
        want = [(r.id, r.textFeaturePrediction) for r in fitted.transform(test).orderBy("id").collect()]
        for model in (PipelineModel.load(paths[1]), Pipeline.load(paths[0]).fit(train)):
            assert [(r.id, r.textFeaturePrediction) for r in model.transform(test).orderBy("id").collect()] == want


def test_vector_neighbours(spark):
    rows = [(i, float(i // 10), float(i % 2), float(i // 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    model = pipeline(dict(kind="knn", k=3), ["a", "b"]).fit(df)
    assert model.transform(df).where("prediction <> label").count() == 0
