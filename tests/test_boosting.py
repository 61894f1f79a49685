"""Boosting against a plain version that tries every split of every node."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from storelab.operators import boosting
from storelab.operators.models import pipeline
from storelab.session import scratch_path


def plain_tree(x, r, rows, depth, leaves):
    """Dict of row to leaf value's rows, by exhaustive splits."""
    best = (0, None)
    if depth:
        for f in range(x.shape[1]):
            for border in sorted({(a + b) / 2 for a, b in zip(*(lambda v: (v[:-1], v[1:]))(np.unique(x[:, f])))}):
                left, right = [i for i in rows if x[i, f] <= border], [i for i in rows if x[i, f] > border]
                if left and right:
                    gain = round(len(left) * len(right) / len(rows) * (np.mean(r[left]) - np.mean(r[right])) ** 2, 10)
                    if gain > best[0]:
                        best = (gain, (left, right))
    if best[1] is None:
        leaves.append(rows)
        return
    for part in best[1]:
        plain_tree(x, r, part, depth - 1, leaves)


def plain_scores(x, y, trees, depth, rate):
    k, n = int(y.max()) + 1, len(y)
    truth = np.eye(k)[y.astype(int)]
    score = np.tile(np.log(truth.mean(axis=0)), (n, 1))
    for _ in range(trees):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        step = np.zeros_like(score)
        for c in range(k):
            r, leaves = truth[:, c] - p[:, c], []
            plain_tree(x, r, list(range(n)), depth, leaves)
            for leaf in leaves:
                down = sum(abs(r[i]) * (1 - abs(r[i])) for i in leaf)
                step[leaf, c] = rate * (k - 1) / k * sum(r[leaf]) / down if down > 1e-150 else 0
        score += step
    return score


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (90, 3)) + rng.random((90, 3)).round(1)
    return x, ((x[:, 0] + 2 * x[:, 1] + rng.integers(0, 3, 90)) // 8 % 3).astype(float)


@pytest.mark.parametrize("depth", [1, 3])
def test_same_as_plain(data, depth):
    x, y = data
    model = boosting.fit(x, y, 6, depth, 0.3)
    assert np.allclose(boosting.scores(model, x), plain_scores(x, y, 6, depth, 0.3))
    assert (np.diff(model["losses"]) < 0).all()


def test_features_tried(data):
    x, y = data
    x = np.hstack([x, np.zeros((90, 6))])
    models = [boosting.fit(x, y, 5, 3, 0.1, "sqrt", seed=s) for s in (1, 1, 2)]
    assert (models[0]["feature"] == models[1]["feature"]).all() and (models[0]["feature"] != models[2]["feature"]).any()


def test_bins():
    x = np.r_[np.arange(1000.0), [5.0] * 500][:, None]
    cuts = boosting.borders(x, 16)[0]
    assert len(cuts) <= 15 and len(boosting.borders(x, 1000)[0]) == 999


def test_estimator(spark, data):
    x, y = data
    rows = [(*map(float, v), c) for v, c in zip(x, map(float, y))] + [(1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double").repartition(4)
    model = pipeline(dict(kind="gbt", trees=40, depth=3, rate=0.2), ["a", "b", "c"]).fit(df)
    out = model.transform(df).where("label is not null")
    assert out.where(F.col("prediction") == F.col("label")).count() > 85
    path = scratch_path(spark, "boosting")
    model.write().save(path)
    again = PipelineModel.load(path).transform(df).where("label is not null")
    assert again.exceptAll(out).count() == 0
    losses = model.stages[-1].arrays()["losses"]
    assert (np.diff(losses) < 0).all()
    one = pipeline(dict(kind="gbt", trees=3), ["a"]).fit(df.where("label = 1"))
    assert one.transform(df).where("prediction <> 1").count() == 0
    with pytest.raises(ValueError, match="label"):
        pipeline(dict(kind="gbt"), ["a"]).fit(df.where("label > 7"))


def test_every_row_is_fitted(spark):
    """More rows than one task bins are all read, for the same model as in one task, whatever the partitions."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(0, 2, (900, 9)), rng.random((900, 2)).round(3)].astype(float)
    y = ((x[:, 0] + 3 * x[:, 9] + 2 * x[:, 10]) // 1.5 % 3).astype(float)
    rows = [(*map(float, v), float(c)) for v, c in zip(x, y)] + [(*([0.5] * 11), None)]
    names = [f"x{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "label"]))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    whole = boosting.SoftmaxBoosting(trees=6, depth=3).fit(ready).arrays()
    for parts in (2, 7):
        far = boosting.SoftmaxBoosting(trees=6, depth=3, fitRows=100).fit(ready.repartition(parts)).arrays()
        assert all(np.allclose(whole[k], far[k]) for k in whole)


def test_blocks_and_packs_give_the_same_sums(monkeypatch):
    """Few rows and many rows are summed in other ways, with equal counts and sums of all features."""
    rng = np.random.default_rng(8)
    widths = [2, 2, 1, 5, 200, 2, 3, 2, 2, 2, 2, 2]
    columns = np.array([np.r_[np.arange(w), rng.integers(0, w, 700 - w)] for w in widths], np.uint8)
    node, target = rng.integers(0, 4, 700), rng.normal(size=700)
    found = []
    for few, block in ((1000, 64), (0, 64), (0, 10_000)):
        monkeypatch.setattr(boosting, "FEW_ROWS", few)
        monkeypatch.setattr(boosting, "BLOCK", block)
        data = boosting.Binned(columns, widths)
        found.append([(list(own), w, count, total) for nodes in (1, 4) for own, w, count, total in data.sums(node % nodes, target, nodes)])
    for other in found[1:]:
        for (own, w, count, total), (own2, w2, count2, total2) in zip(found[0], other, strict=True):
            assert own == own2 and w == w2 and (count == count2).all() and np.allclose(total, total2)


def test_borders_from_counts():
    rng = np.random.default_rng(5)
    for column in (rng.integers(0, 40, 500).astype(float), rng.random(700), np.r_[np.zeros(300), rng.random(99)]):
        values, counts = np.unique(column, return_counts=True)
        for bins in (7, 16, 255):
            assert (boosting.counted_borders(values, counts, bins) == boosting.borders(column[:, None], bins)[0]).all()
