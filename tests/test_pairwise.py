"""Margins of pairs of classes: the dual rises, the gap closes, votes and weights equal plain versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from storelab.operators import models, pairwise
from storelab.operators.linear import sparse_rows
from storelab.operators.pairwise import PairwiseMargins, votes
from storelab.session import cut, scratch_path

CENTRES = [(0, 2), (2, -1), (-2, -1), (1, 1)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    return [(i, rng.normal(0, 0.8, 3) + (*CENTRES[i % 4], 0.0), float(i % 4)) for i in range(240)]


@pytest.fixture(scope="module")
def points(spark, rows):
    made = [(i, Vectors.dense(x) if i % 2 else Vectors.sparse(3, range(3), x), c) for i, x, c in rows]
    return cut(spark.createDataFrame(made, ["id", "features", "label"]).repartition(5, "id"))


def plain(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """One pair by coordinate ascent in one place, to many digits."""
    x = np.c_[x, np.ones(len(x))]
    w, dual = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(3000):
        for i in range(len(x)):
            new = min(cost, max(0.0, dual[i] + (1 - y[i] * (w @ x[i])) / (x[i] @ x[i])))
            w += (new - dual[i]) * y[i] * x[i]
            dual[i] = new
    return w


def test_equals_plain_weights_and_closes_the_gap(points, rows):
    fitted = PairwiseMargins(cost=0.5, tol=1e-6, iterations=5000).fit(points).pairs()
    x, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for (a, b), (weights, history) in zip(combinations(range(4), 2), fitted, strict=True):
        loss, dual = history.T
        assert (np.diff(dual) >= -1e-9).all() and (loss >= dual - 1e-9).all() and loss[-1] - dual[-1] <= 1e-6 * loss[-1]
        keep = (c == a) | (c == b)
        sign = np.where(c[keep] == a, 1.0, -1.0)
        assert np.allclose(weights, plain(x[keep], sign, 0.5), atol=0.01)
        # the loss that the model reports is that of its weights
        own = np.c_[x[keep], np.ones(keep.sum())] @ weights * sign
        assert np.isclose(loss[-1], (weights ** 2).sum() / 2 + 0.5 * np.maximum(0, 1 - own).sum())


def test_votes_equal_brute_force(points, rows):
    model = PairwiseMargins(cost=1.0).fit(points)
    weights, out = [w for w, _ in model.pairs()], {r.id: r.prediction for r in model.transform(points).collect()}
    right = 0
    for i, x, c in rows:
        count = [0] * 4
        for (a, b), w in zip(combinations(range(4), 2), weights):
            count[a if w[:-1] @ x + w[-1] > 0 else b] += 1
        assert out[i] == count.index(max(count))
        right += out[i] == c
    assert right > 180
    assert (votes(np.array([[1.0, -1.0, 1.0]]), 3) == [[1, 1, 1]]).all()


@pytest.mark.parametrize("parts", [1, 16])
def test_partitions_do_not_matter(spark, points, rows, parts):
    fit = lambda df: [w for w, _ in PairwiseMargins(cost=0.5).fit(df).pairs()]
    assert all((a == b).all() for a, b in zip(fit(points), fit(points.repartition(parts)), strict=True))


def test_costs_differ(points):
    """A larger cost gives a smaller share to the size of the weights."""
    sizes = [sum(w[:-1] @ w[:-1] for w, _ in PairwiseMargins(cost=c, tol=0.001).fit(points).pairs()) for c in (0.001, 0.1, 10.0)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] / 2


def test_edges(spark, points):
    one = points.where("label = 2")
    assert {r.prediction for r in PairwiseMargins().fit(one).transform(points).collect()} == {2.0}
    with pytest.raises(ValueError, match="label"):
        PairwiseMargins().fit(points.where("label > 9"))
    empty = [(Vectors.sparse(2, [], []), 0.0), (Vectors.sparse(2, [], []), 1.0), (Vectors.sparse(2, [0], [1.0]), 1.0),
             (Vectors.sparse(2, [0], [1.0]), None)]
    odd = spark.createDataFrame(empty, ["features", "label"])
    out = PairwiseMargins(cost=10.0).fit(odd).transform(odd).collect()
    assert len(out) == 4 and out[2].prediction == out[3].prediction == 1.0


def test_stored_and_seeded(spark, points):
    fit = lambda: models.classifier(dict(kind="svm", cost=10.0))[0].fit(points)
    model = fit()
    assert all((a == b).all() for (a, _), (b, _) in zip(fit().pairs(), model.pairs(), strict=True))
    path = scratch_path(spark, "svm")
    PipelineModel([model]).write().save(path)
    again = PipelineModel.load(path).transform(points).select("id", "prediction")
    assert again.exceptAll(model.transform(points).select("id", "prediction")).count() == 0
    assert model.transform(points).where(F.col("prediction").isNull()).count() == 0


def test_no_row_is_left_out(spark, monkeypatch):
    """A model has one dual weight for each labelled row of its classes, however many there are."""
    monkeypatch.setattr(pairwise, "fit_pair", lambda rows, size, sign, **_: (np.array([len(sign), sign.sum(), rows[2].sum()]), [[0.0, 0.0]]))
    df = spark.range(230_000).select((F.col("id") % 2).cast("double").alias("label"),
                                     array_to_vector(F.array(F.lit(1.0), F.lit(0.0))).alias("features"))
    (weights, _), = PairwiseMargins().fit(df).pairs()
    assert weights.tolist() == [230_000, 0, 230_000]


def test_entries_of_vectors(spark):
    """Dense and sparse vectors give the same entries; zeros and empty vectors give none."""
    rows = [(Vectors.dense([0.0, 2.0, 3.0]),), (Vectors.sparse(3, [0, 2], [0.0, 5.0]),), (Vectors.sparse(3, [], []),), (Vectors.dense([1.0, 0.0, 0.0]),)]
    table = spark.createDataFrame(rows, ["x"]).coalesce(1).toArrow()
    for column in (table.column("x"), table.column("x").combine_chunks(), table.slice(1, 2).column("x")):
        bounds, places, values = sparse_rows(column)
        found = [dict(zip(places[a:b].tolist(), values[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]
        assert found == ([{1: 2.0, 2: 3.0}, {2: 5.0}, {}, {0: 1.0}] if len(column) == 4 else [{2: 5.0}, {}])
