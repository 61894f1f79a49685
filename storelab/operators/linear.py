"""Linear classifiers by stochastic gradient steps: log or hinge loss, l2 or l1 penalty.

An epoch is one job: every task starts from the weights of the epoch before, takes
mini-batch steps over its rows in a seeded order, and sends its weights and number of rows;
the weights of the next epoch are their average. Weights of tasks are added up in groups
before they reach the driver, which holds classes times features numbers. Each class has
weights of its own against all others. Vectors stay sparse.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelab.operators.table_model import TableModel
from storelab.session import cut

BATCH = 16
SUM_GROUPS = 32


def sparse_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, places and values of the non-zero entries of a column of vectors."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x, dense = held.field("values"), held.field("type").to_numpy(zero_copy_only=False) == 1
    sizes, values = x.value_lengths().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places[~dense[owner]] = held.field("indices").flatten().to_numpy(zero_copy_only=False)
    some = values != 0
    bounds = np.r_[0, np.cumsum(np.bincount(owner[some], minlength=len(sizes)))].astype(np.int64)
    return bounds, places[some], values[some]


def margins(weights: np.ndarray, bounds: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row per vector, one column per class; the last weight is the constant."""
    out = np.tile(weights[:, -1], (len(bounds) - 1, 1))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for c in range(len(weights)):
        out[:, c] += np.bincount(owner, weights[c, places] * values, len(bounds) - 1)
    return out


def slope(margin: np.ndarray, sign: np.ndarray, loss: str) -> np.ndarray:
    """Derivative of the loss by the margin."""
    if loss == "hinge":
        return -sign * (sign * margin < 1)
    return -sign / (1 + np.exp(np.clip(sign * margin, -500, 500)))


def first_step(alpha: float, loss: str) -> float:
    """Steps are 1 / (alpha * (t0 + t)); t0 fits the size of the loss at typical weights."""
    typical = np.sqrt(1 / np.sqrt(alpha))
    rate = typical / max(1.0, abs(float(slope(np.array(-typical), np.array(1.0), loss))))
    return 1 / (rate * alpha)


def steps(weights: np.ndarray, rows, own: np.ndarray, t: float, loss: str, penalty: str, alpha: float, order: np.ndarray) -> float:
    """Take mini-batch steps over the rows in the given order; changes ``weights``, gives the next t."""
    bounds, places, values = rows
    t0 = first_step(alpha, loss)
    for i in range(0, len(order), BATCH):
        part = order[i: i + BATCH]
        sizes = bounds[part + 1] - bounds[part]
        inner = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(bounds[part] - inner[:-1], sizes) + np.arange(inner[-1])
        p, v = places[at], values[at]
        sign = np.where(own[part][:, None] == np.arange(len(weights)), 1.0, -1.0)
        g = slope(margins(weights, inner, p, v), sign, loss) / len(part)
        rate = 1 / (alpha * (t0 + t))
        if penalty == "l2":
            weights[:, :-1] *= max(0.0, 1 - rate * alpha)
        owner = np.repeat(np.arange(len(part)), sizes)
        for c in range(len(weights)):
            np.subtract.at(weights[c], p, rate * g[owner, c] * v)
        weights[:, -1] -= rate * g.sum(axis=0)
        if penalty == "l1":
            weights[:, :-1] = np.sign(weights[:, :-1]) * np.maximum(np.abs(weights[:, :-1]) - rate * alpha, 0)
        t += 1
    return t


class SgdClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    loss = Param(Params._dummy(), "loss", "log or hinge", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "l2 or l1", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "weight of the penalty", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "orders the rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", loss="hinge", penalty="l2",
                 alpha=0.0001, epochs=10, seed=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", loss="hinge", penalty="l2",
                         alpha=0.0001, epochs=10, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SgdClassifierModel":
        get = self.getOrDefault
        data = cut(dataset.where(F.col(get("labelCol")).isNotNull()).select(
            F.col(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y")))
        labels = np.array([r.y for r in data.select("y").distinct().orderBy("y").collect()])
        if not len(labels):
            raise ValueError("no row has a label")
        weights = np.zeros((len(labels), data.first().x.size + 1))
        t = 0.0
        for epoch in range(get("epochs")):
            weights, t = self._epoch(data, labels, weights, t, epoch)
        out = io.BytesIO()
        np.savez(out, weights=weights, labels=labels)
        made = cut(dataset.sparkSession.createDataFrame([(bytearray(out.getvalue()),)], "model binary"))
        return self._copyValues(SgdClassifierModel(dict(model=made)))

    def _epoch(self, data: DataFrame, labels: np.ndarray, start: np.ndarray, t: float, epoch: int) -> tuple[np.ndarray, float]:
        get = self.getOrDefault
        loss, penalty, alpha, seed = get("loss"), get("penalty"), get("alpha"), get("seed")

        def run(batches):
            weights, now, n, part = start.copy(), t, 0, 0
            for batch in batches:
                own = np.searchsorted(labels, batch.column("y").to_numpy())
                order = np.random.default_rng([seed, epoch, part]).permutation(batch.num_rows)
                now = steps(weights, sparse_rows(batch.column("x")), own, now, loss, penalty, alpha, order)
                n, part = n + batch.num_rows, part + 1
            if n:
                yield sums(n, (now - t) * n, weights * n)

        def add(key, table):
            total = sum(np.frombuffer(w, np.float64) for w in table.column("weights").to_pylist())
            return pa.Table.from_batches([sums(sum(table.column("n").to_pylist()), sum(table.column("t").to_pylist()), total)])

        def sums(n, steps_taken, weights):
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([float(steps_taken)]), pa.array([weights.tobytes()], pa.binary())],
                                              ["n", "t", "weights"])

        kinds = "n long, t double, weights binary"
        tasks = data.mapInArrow(run, kinds).withColumn("group", F.spark_partition_id() % SUM_GROUPS)
        rows = tasks.groupBy("group").applyInArrow(lambda table: add(None, table.drop_columns(["group"])), kinds).collect()
        n = sum(r.n for r in rows)
        total = sum(np.frombuffer(r.weights, np.float64) for r in rows).reshape(start.shape)
        mean, t = total / n, t + sum(r.t for r in rows) / n
        if penalty == "l1":  # tasks have their zeros at different places; one more step of the penalty joins them
            shrunk = np.maximum(np.abs(mean[:, :-1]) - 1 / (first_step(alpha, loss) + t), 0)
            mean[:, :-1] = np.sign(mean[:, :-1]) * shrunk
        return mean, t


class SgdClassifierModel(TableModel, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    TABLES = ("model",)

    def arrays(self) -> dict:
        with np.load(io.BytesIO(self.tables["model"].first().model)) as saved:
            return dict(saved)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model, x = self.arrays(), self.getOrDefault("featuresCol")

        def run(batches):
            for batch in batches:
                found = margins(model["weights"], *sparse_rows(batch.column(x))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model["labels"][found])], [*batch.schema.names, name])

        name = self.getOrDefault("predictionCol")
        return dataset.mapInArrow(run, T.StructType([*dataset.schema.fields, T.StructField(name, T.DoubleType())]))
