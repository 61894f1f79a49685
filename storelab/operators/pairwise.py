"""Large-margin classifier of all pairs of classes, by dual coordinate ascent.

For each two classes the hinge loss ``|w|^2 / 2 + cost * sum(max(0, 1 - sign * w.x))`` is made
small over their rows; the constant counts as one more feature with the value one. Each row has
a dual weight between 0 and ``cost``; a pass moves the dual weights one after another, in seeded
order, each to the place that raises the dual most. The gap between loss and dual, measured
after each pass, bounds how far the weights are from the best ones; fitting ends when it is at
most ``tol`` times the loss, or after ``iterations`` passes.

Each pair is a task of its own over all labelled rows of its classes, which it holds as 16 bytes
per entry and about 100 per row; rows are sorted before they reach it, so that it does not depend
on partitions. Averaging the weights of tasks that each hold a part of a pair needs hundreds of
jobs for the same gap, so it is not done. Scoring runs wherever the rows are. Rows without label are left out, equal rows count as often as they occur, rows without
entries move the constant alone; one class alone has no pair and is always predicted. Each pair
votes for one of its classes, and the smaller class wins a tie.
"""

from __future__ import annotations

from itertools import combinations

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

from storelab.operators.linear import margins, sparse_rows
from storelab.operators.table_model import TableModel
from storelab.session import cut

FITTED = "pair int, weights binary, history array<array<double>>"


def fit_pair(rows, size: int, sign: np.ndarray, cost: float, passes: int, tol: float, seed: int) -> tuple[np.ndarray, list]:
    """Weights (the last is the constant), and loss and dual after each pass."""
    bounds, places, values = rows
    square = np.array([float(v @ v) + 1 for a, b in zip(bounds[:-1], bounds[1:]) for v in [values[a:b]]])
    weights, constant, dual, history = np.zeros(size), 0.0, np.zeros(len(sign)), []
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(sign)):
            a, b = bounds[i], bounds[i + 1]
            at, v = places[a:b], values[a:b]
            s, old = sign[i], dual[i]
            new = min(cost, max(0.0, old + (1 - s * (weights[at] @ v + constant)) / square[i]))
            if new != old:
                weights[at] += (new - old) * s * v
                constant += (new - old) * s
                dual[i] = new
        full = np.r_[weights, constant]
        half = full @ full / 2
        loss = half + cost * np.maximum(0, 1 - sign * margins(full[None], *rows)[:, 0]).sum()
        history.append([float(loss), float(dual.sum() - half)])
        if loss - history[-1][1] <= tol * loss:
            break
    return np.r_[weights, constant], history


def votes(margin: np.ndarray, classes: int) -> np.ndarray:
    """Votes per row and class from the margins of all pairs."""
    out = np.zeros((len(margin), classes), np.int64)
    for i, (a, b) in enumerate(combinations(range(classes), 2)):
        out[:, a] += margin[:, i] > 0
        out[:, b] += margin[:, i] <= 0
    return out


class PairwiseMargins(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    cost = Param(Params._dummy(), "cost", "weight of the loss", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "most passes over the rows", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "gap at which fitting ends, as a share of the loss", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "orders the rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", cost=1.0, iterations=1000, tol=0.01,
                 seed=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", cost=1.0, iterations=1000, tol=0.01,
                         seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PairwiseMarginsModel":
        get = self.getOrDefault
        rows = dataset.where(F.col(get("labelCol")).isNotNull()).select(
            F.col(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y"))
        data = cut(rows.withColumn("h", F.xxhash64("x", "y")))
        labels = [r.y for r in data.select("y").distinct().orderBy("y").collect()]
        if not labels:
            raise ValueError("no row has a label")
        size, pairs = data.first().x.size, list(combinations(labels, 2))
        options = dict(cost=get("cost"), passes=get("iterations"), tol=get("tol"))
        seed = get("seed")
        own = F.array_compact(F.array(*[F.when(F.col("y").isin(*pair), i) for i, pair in enumerate(pairs)])) if pairs else F.array().cast("array<int>")

        def fit(batches):
            found = [(b.column("pair")[0].as_py(), b.column("y").to_numpy(), sparse_rows(b.column("x"))) for b in batches if b.num_rows]
            if found:
                pair = found[0][0]
                sign = np.where(np.concatenate([y for _, y, _ in found]) == pairs[pair][0], 1.0, -1.0)
                bounds = np.r_[0, np.cumsum(np.concatenate([np.diff(r[0]) for _, _, r in found]))]
                rows = bounds, *[np.concatenate([r[i] for _, _, r in found]) for i in (1, 2)]
                found.clear()
                weights, history = fit_pair(rows, size, sign, seed=[seed, pair], **options)
                yield pa.RecordBatch.from_arrays([pa.array([pair], pa.int32()), pa.array([weights.tobytes()], pa.binary()),
                                                  pa.array([history], pa.list_(pa.list_(pa.float64())))], ["pair", "weights", "history"])

        dealt = data.select("*", F.explode(own).alias("pair")).repartitionById(max(1, len(pairs)), F.col("pair"))
        made = cut(dealt.sortWithinPartitions("h", "y").mapInArrow(fit, FITTED))
        return self._copyValues(PairwiseMarginsModel(dict(model=made), dict(labels=labels)))


class PairwiseMarginsModel(TableModel, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    TABLES = ("model",)

    def pairs(self) -> list:
        """Per pair its weights, and loss and dual after each pass."""
        return [(np.frombuffer(r.weights, np.float64), np.array(r.history)) for r in self.tables["model"].orderBy("pair").collect()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, labels, x = [w for w, _ in self.pairs()], np.array(self.fact("labels")), self.getOrDefault("featuresCol")

        def run(batches):
            for batch in batches:
                found = np.zeros(batch.num_rows, np.int64)
                if weights:
                    found = votes(margins(np.array(weights), *sparse_rows(batch.column(x))), len(labels)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[found])], [*batch.schema.names, name])

        name = self.getOrDefault("predictionCol")
        return dataset.mapInArrow(run, T.StructType([*dataset.schema.fields, T.StructField(name, T.DoubleType())]))
