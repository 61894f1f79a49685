"""Gradient steps: what they learn, exact zeros, and the same result for the same rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from storelab.operators import linear, models
from storelab.operators.linear import SgdClassifier
from storelab.session import cut, scratch_path


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        c = i % 3
        x = rng.normal(0, 0.4, 2) + [(0, 2), (2, -1), (-2, -1)][c]
        rows.append((i, *map(float, x), *map(float, rng.normal(0, 1, 4)), float(c)))
    df = spark.createDataFrame(rows, "id int, a double, b double, n1 double, n2 double, n3 double, n4 double, label double")
    return cut(VectorAssembler(inputCols=["a", "b", "n1", "n2", "n3", "n4"], outputCol="features").transform(df).repartition(4, "id"))


@pytest.mark.parametrize("loss", ["log", "hinge"])
@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_learns(points, loss, penalty):
    model = SgdClassifier(loss=loss, penalty=penalty, alpha=0.01).fit(points)
    out = model.transform(points)
    assert out.where("prediction = label").count() > 570 and out.columns == [*points.columns, "prediction"]
    again = SgdClassifier(loss=loss, penalty=penalty, alpha=0.01).fit(points)
    assert (again.arrays()["weights"] == model.arrays()["weights"]).all()


def test_l1_gives_zeros(points):
    weights = {p: SgdClassifier(loss="log", penalty=p, alpha=0.05).fit(points).arrays()["weights"] for p in ("l1", "l2")}
    assert (weights["l1"][:, 2:6] == 0).mean() > 0.7 and (weights["l2"][:, 2:6] == 0).mean() == 0


def test_steps_follow_the_gradient():
    """The derivative of each loss agrees with its differences."""
    m = np.linspace(-3, 3, 41) + 0.01
    for sign in (-1.0, 1.0):
        for loss, value in (("hinge", lambda x: np.maximum(0, 1 - sign * x)), ("log", lambda x: np.log1p(np.exp(-sign * x)))):
            d = (value(m + 1e-6) - value(m - 1e-6)) / 2e-6
            assert np.allclose(linear.slope(m, np.full(41, sign), loss), d, atol=1e-4)


def test_stored_and_in_pipelines(spark, points):
    model = models.pipeline(dict(kind="sgd", loss="hinge", penalty="l2", alpha=0.01), ["a", "b"]).fit(points.drop("features"))
    path = scratch_path(spark, "sgd")
    model.write().save(path)
    out = model.transform(points.drop("features")).select("id", "prediction")
    assert PipelineModel.load(path).transform(points.drop("features")).select("id", "prediction").exceptAll(out).count() == 0
    with pytest.raises(ValueError, match="label"):
        SgdClassifier().fit(points.where(F.col("label") > 7))
