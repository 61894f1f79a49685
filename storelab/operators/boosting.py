"""Gradient boosting for several classes: one loop with softmax gradients and a tree per class and round.

Every labelled row is fitted, and the result does not depend on partitions. Up to ``fitRows``
rows go to one task as they are. Beyond, all tasks count the values of the features, which
gives the borders of the bins, and turn their rows into bins; the rounds, each of which needs
the one before, run in one task that holds a row as two bytes per feature at most and about 20
numbers. All trees of a fit share one table of bins, and every level of a tree is two sums per
node, feature and bin. Scoring is a vectorised function over all rows, wherever they are.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.operators.table_model import TableModel
from storelab.session import cut

# Labelled rows up to which one task makes the bins as well.
FIT_ROWS = 200_000
BINS = 255
# Rows up to which all features of equal numbers of bins are summed at once, and rows of a block beyond or of a score.
FEW_ROWS, BLOCK, SCORED = 3_000, 1 << 15, 1 << 12


def borders(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the values between two bins: between all distinct values if they are few,
    between equally frequent ones beyond."""
    out = []
    for column in x.T:
        distinct = np.unique(column)
        if len(distinct) > bins:
            distinct = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="inverted_cdf"))
        out.append((distinct[1:] + distinct[:-1]) / 2)
    return out


def counted_borders(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """As ``borders`` of one feature, from its distinct values in order and how often each occurs."""
    if len(values) > bins:
        n = counts.sum()
        rank = np.clip(np.ceil(n * np.linspace(0, 1, bins) - 1), 0, n - 1)
        values = np.unique(values[np.searchsorted(counts.cumsum(), rank, "right")])
    return (values[1:] + values[:-1]) / 2


def packs(widths: Sequence[int], most: int = BINS + 1) -> list[list[int]]:
    """Features dealt into packs whose numbers of bins have a product of at most ``most``."""
    out, product = [], most + 1
    for f in sorted((f for f, w in enumerate(widths) if w > 1), key=lambda f: widths[f]):
        if product * widths[f] > most:
            out.append([])
            product = 1
        out[-1].append(f)
        product *= widths[f]
    return out


class Binned:
    """Bins of all rows, one row of ``columns`` per feature. Features of equal numbers of bins stand side by
    side: a feature of two values takes two sums per node, not as many as the longest one.

    Few rows become one list of cells. Of many rows a block of one pack of features is summed at a time, by
    the joint value of the pack, and the sums of its features follow from these: what a sum reads and
    writes stays near the processor, and a row takes two bytes per feature at most.
    """

    def __init__(self, columns: np.ndarray, widths: Sequence[int]):
        self.columns, self.widths, self.width, self.n = columns, widths, max(widths, default=1), columns.shape[1]
        self.groups, self.cells, self.packs = [], [], []
        for w in sorted(set(widths) - {1}):
            own = np.flatnonzero(np.array(widths) == w)
            count = np.stack([np.bincount(columns[f], minlength=w) for f in own])
            self.groups.append((own, w, count))
            if self.n <= FEW_ROWS:
                self.cells.append((columns[own].T + np.arange(len(own)) * w).astype(np.int64))
        if self.n > FEW_ROWS:
            for own in packs(widths):
                code = columns[own[0]]
                for f in own[1:]:
                    code = code * columns.dtype.type(widths[f]) + columns[f]
                size = int(np.prod([widths[f] for f in own]))
                # which joint values make up each bin of each feature
                bins = np.unravel_index(np.arange(size), [widths[f] for f in own])
                parts = np.concatenate([np.eye(widths[f])[b] for f, b in zip(own, bins)], axis=1)
                self.packs.append((own, size, code, parts))

    def sums(self, node: np.ndarray, target: np.ndarray, nodes: int):
        """Per group its features, number of bins, and count and sum of each node, feature and bin."""
        if self.n <= FEW_ROWS:
            for (own, w, whole), cells in zip(self.groups, self.cells):
                m = len(own)
                flat = (node[:, None] * (m * w) + cells if nodes > 1 else cells).ravel()
                count = (np.bincount(flat, minlength=nodes * m * w) if nodes > 1 else whole).reshape(nodes, m, w)
                yield own, w, count, np.bincount(flat, np.repeat(target, m), nodes * m * w).reshape(nodes, m, w)
            return
        made = [(np.zeros(nodes * size, np.int64), np.zeros(nodes * size)) for _, size, _, _ in self.packs]
        place = np.empty(min(self.n, BLOCK), np.int64)
        for at in range(0, self.n, BLOCK):
            part = slice(at, at + BLOCK)
            of, r = node[part], target[part]
            here = place[:len(r)]
            for (_, size, code, _), (count, total) in zip(self.packs, made):
                np.multiply(of, size, out=here)
                here += code[part]
                if nodes > 1:
                    count += np.bincount(here, minlength=nodes * size)
                total += np.bincount(here, r, nodes * size)
        counts, totals = {}, {}
        for (own, size, _, parts), (count, total) in zip(self.packs, made):
            count, total = count.reshape(nodes, size), total.reshape(nodes, size)
            if len(own) > 1:
                count, total = (count @ parts).astype(np.int64), total @ parts
            ends = np.cumsum([self.widths[f] for f in own])
            for f, end in zip(own, ends):
                here = slice(end - self.widths[f], end)
                counts[f], totals[f] = count[:, here], total[:, here]
        for own, w, whole in self.groups:
            count = np.stack([counts[f] for f in own], axis=1) if nodes > 1 else whole[None]
            yield own, w, count, np.stack([totals[f] for f in own], axis=1)


def step_down(node: np.ndarray, columns: np.ndarray, feature: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The place of each row one level below ``node``: right where its value is above the border of its node.
    Each node, of which there are few, is compared with all rows, which costs less than to look up a value for each row."""
    right = np.zeros((len(feature), len(node)), bool)
    for i, (f, b) in enumerate(zip(feature, border)):
        if f >= 0:
            np.greater(columns[f], b, out=right[i])
    return 2 * node + (right[0] if len(feature) == 1 else right.ravel().take(node * len(node) + np.arange(len(node))))


def grow(data: Binned, target: np.ndarray, depth: int, rng: np.random.Generator | None, n_tried: int):
    """A regression tree as a full tree of ``depth`` levels: feature and bin of each inner node
    (-1 where it does not split), and the leaf of each row.

    A split maximises left * right / (left + right) * (difference of means)**2.
    """
    d, n = data.columns.shape
    feature, border = np.full((1 << depth) - 1, -1, np.int32), np.zeros((1 << depth) - 1, np.int32)
    node = np.zeros(n, np.int64)  # place in the level
    for level in range(depth):
        nodes = 1 << level
        # of each node and feature its best gain and the first bin that reaches it
        gains, places = np.full((nodes, d), -1.0), np.zeros((nodes, d), np.int64)
        for own, w, count, summed in data.sums(node, target, nodes):
            # sums of a feature are added up over the same places whatever its number of bins
            total = np.zeros((nodes, len(own), data.width))
            total[:, :, :w] = summed
            left_n, left_s = count.cumsum(axis=2)[:, :, :-1], total[:, :, :w].cumsum(axis=2)[:, :, :-1]
            all_n, all_s = count.sum(axis=2)[:, :, None], total.sum(axis=2)[:, :, None]
            right_n, right_s = all_n - left_n, all_s - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_n * right_n / all_n * (left_s / left_n - right_s / right_n) ** 2
            # rounded, so that equal gains stay equal and the first feature wins
            gain = np.where((left_n > 0) & (right_n > 0), np.round(gain, 10), -1.0)
            places[:, own] = gain.argmax(axis=2)
            gains[:, own] = gain.max(axis=2)
        if n_tried < d:
            tried = np.argsort(rng.random((nodes, d)), axis=1) < n_tried
            gains = np.where(tried, gains, -1.0)
        best = gains.argmax(axis=1) if d else np.zeros(nodes, np.int64)
        split = gains[np.arange(nodes), best] > 0 if d else np.zeros(nodes, bool)
        here = slice(nodes - 1, 2 * nodes - 1)
        feature[here] = np.where(split, best, -1)
        border[here] = np.where(split, places[np.arange(nodes), best] if d else 0, 0)
        for at in range(0, n, BLOCK):
            part = slice(at, at + BLOCK)
            node[part] = step_down(node[part], data.columns[:, part], feature[here], border[here])
    return feature, border, node


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value, one row per feature; a byte is enough for ``BINS``."""
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.int32
    out = np.zeros((len(cuts), len(x)), kind)
    for i, c in enumerate(cuts):
        out[i] = np.searchsorted(c, x[:, i], "left")
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, subset: str = "all", bins: int = BINS, seed: int = 25) -> dict:
    """The model of rows ``x`` with labels ``y``, and the log loss after each round."""
    cuts = borders(x, bins)
    return boosted(binned(x, cuts), cuts, y, trees, depth, rate, subset, seed)


def boosted(columns: np.ndarray, cuts: Sequence[np.ndarray], y: np.ndarray, trees: int, depth: int, rate: float,
            subset: str = "all", seed: int = 25) -> dict:
    """As ``fit``, for rows whose values are bins between ``cuts`` already."""
    labels = np.unique(y)
    k, (d, n) = len(labels), columns.shape
    data = Binned(columns, [len(c) + 1 for c in cuts])
    own = np.searchsorted(labels, y)
    start = np.log(np.bincount(own, minlength=k) / n)
    score = np.tile(start, (n, 1))
    n_tried = max(1, int(np.sqrt(d))) if subset == "sqrt" else d
    rng = np.random.default_rng(seed)
    model = {"labels": labels, "start": start, "feature": np.full((trees, k, (1 << depth) - 1), -1, np.int32),
             "border": np.full((trees, k, (1 << depth) - 1), np.inf), "leaf": np.zeros((trees, k, 1 << depth))}
    losses = []
    for t in range(trees if k > 1 else 0):
        residual = np.empty((k, n))  # of each class together, as its trees read it
        for at in range(0, n, BLOCK):
            part = slice(at, at + BLOCK)
            p = np.exp(score[part] - score[part].max(axis=1, keepdims=True))
            residual[:, part] = (np.eye(k)[own[part]] - p / p.sum(axis=1, keepdims=True)).T
        for c, r in enumerate(residual):
            feature, place, leaf = grow(data, r, depth, rng, n_tried)
            up = np.bincount(leaf, r, 1 << depth)
            down = np.bincount(leaf, np.abs(r) * (1 - np.abs(r)), 1 << depth)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(np.abs(down) < 1e-150, 0.0, (k - 1) / k * up / down) * rate
            score[:, c] += value[leaf]
            model["feature"][t, c], model["leaf"][t, c] = feature, value
            inner = np.flatnonzero(feature >= 0)
            model["border"][t, c, inner] = [cuts[feature[i]][place[i]] for i in inner]
        loss = 0.0
        for at in range(0, n, BLOCK):
            part = slice(at, at + BLOCK)
            top, held = score[part].max(axis=1), score[part]
            loss += (top + np.log(np.exp(held - top[:, None]).sum(axis=1)) - held[np.arange(len(held)), own[part]]).sum()
        losses.append(float(loss / n))
    model["losses"] = np.array(losses)
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """One score per row and class."""
    out = np.tile(model["start"], (len(x), 1))
    depth = model["leaf"].shape[2].bit_length() - 1
    for at in range(0, len(x), SCORED):
        columns, found = np.ascontiguousarray(x[at: at + SCORED].T), out[at: at + SCORED]
        for feature, border, leaf in zip(model["feature"], model["border"], model["leaf"]):
            for c in range(out.shape[1]):
                node = np.zeros(len(found), np.int64)
                for level in range(depth):
                    here = slice((1 << level) - 1, (2 << level) - 1)
                    node = step_down(node, columns, feature[c][here], border[c][here])
                found[:, c] += leaf[c][node]
    return out


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for any number of classes, fitted on all rows with a label."""

    trees = Param(Params._dummy(), "trees", "rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of each tree that is added", TypeConverters.toFloat)
    subset = Param(Params._dummy(), "subset", "features tried at a split: all or sqrt", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "draws the features tried", TypeConverters.toInt)
    fitRows = Param(Params._dummy(), "fitRows", "labelled rows up to which one task makes the bins as well", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", trees=100, depth=3, rate=0.1,
                 subset="all", seed=25, fitRows=FIT_ROWS):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", trees=100, depth=3, rate=0.1,
                         subset="all", seed=25, fitRows=FIT_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        get = self.getOrDefault
        options = {n: get(n) for n in ("trees", "depth", "rate", "subset", "seed")}
        rows = cut(dataset.where(F.col(get("labelCol")).isNotNull()).select(
            vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y")))
        n = rows.count()
        if not n:
            raise ValueError("no row has a label")
        if n > get("fitRows"):
            return self._copyValues(SoftmaxBoostingModel(dict(model=cut(_fitted_bins(rows, options)))))

        def run(batches):
            parts = [(b.column("x"), b.column("y").to_numpy()) for b in batches if b.num_rows]
            if parts:
                y = np.concatenate([p[1] for p in parts])
                x = np.concatenate([_matrix(p[0]) for p in parts])
                order = np.lexsort((*x.T, y))
                yield _saved(fit(x[order], y[order], **options))

        return self._copyValues(SoftmaxBoostingModel(dict(model=cut(rows.repartition(1).mapInArrow(run, "model binary")))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _saved(model: dict) -> pa.RecordBatch:
    out = io.BytesIO()
    np.savez(out, **model)
    return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])


def _fitted_bins(rows: DataFrame, options: dict) -> DataFrame:
    """The model of rows (x, y) that are too many to be made to bins by one task."""
    def count(batches):
        for b in batches:
            for f, column in enumerate(_matrix(b.column("x")).T if b.num_rows else ()):
                values, n = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f), pa.int32()), pa.array(values), pa.array(n)], ["feature", "value", "n"])

    def border(table: pa.Table) -> pa.Table:
        table = table.sort_by("value")
        found = counted_borders(table.column("value").to_numpy(), table.column("n").to_numpy(), BINS)
        return pa.table({"feature": table.column("feature")[:1], "cuts": pa.array([found], pa.list_(pa.float64()))})

    counts = rows.mapInArrow(count, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    cuts = [np.array(r.cuts) for r in counts.groupBy("feature").applyInArrow(border, "feature int, cuts array<double>").orderBy("feature").collect()]

    def into_bins(batches):
        for b in batches:
            if b.num_rows:
                made = np.ascontiguousarray(binned(_matrix(b.column("x")), cuts).T)
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in made], pa.binary())], ["y", "b"])

    def run(batches):
        parts = [(b.column("y").to_numpy(), np.frombuffer(b"".join(b.column("b").to_pylist()), np.uint8).reshape(b.num_rows, -1).T)
                 for b in batches if b.num_rows]
        y, columns = (np.concatenate(p, axis=-1) for p in zip(*parts))
        yield _saved(boosted(np.ascontiguousarray(columns), cuts, y, **options))

    return (rows.mapInArrow(into_bins, "y double, b binary").repartition(1).sortWithinPartitions("y", "b")
            .mapInArrow(run, "model binary"))


class SoftmaxBoostingModel(TableModel, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    TABLES = ("model",)

    def arrays(self) -> dict:
        with np.load(io.BytesIO(self.tables["model"].first().model)) as saved:
            return dict(saved)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.arrays()

        @F.pandas_udf("double")
        def best(x: pd.Series) -> pd.Series:
            return pd.Series(model["labels"][scores(model, np.stack(x.to_numpy())).argmax(axis=1)])

        return dataset.withColumn(self.getOrDefault("predictionCol"), best(vector_to_array(self.getOrDefault("featuresCol"))))
