"""Exact nearest neighbours between two sets of vectors, by distances to pivots.

Training rows are dealt to the cell of their nearest pivot, with their distance to it. A
test row first looks at the cells nearest to it that hold k rows together; the k-th
distance found there bounds its search. By the triangle inequality a cell, or a row in a
cell, whose distance to the pivot differs from the test row's by more than that bound holds
no neighbour, and neither does a cell whose pivot is farther than the test row's own by
more than twice the bound. Only the cells left are looked at in a second round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelab.session import cut

# Most rows of either side in one unit of work; larger cells are split into blocks.
BLOCK_ROWS = 20_000
# Pivots are about the square root of the training rows, and this many at most.
PIVOTS = 1024
# Doubles held at once while distances are worked out.
_CHUNK = 4_000_000
# Distances are rounded, so bounds are widened by this share before a cell is left out.
_SLACK = 1e-9


class PivotIndex:
    """Training rows by the cell of their nearest pivot; built once, searched by any test rows.

    Pivots are the rows with the least hash of their key. They, and three numbers per cell,
    are all that the driver holds. A cell with many rows, such as copies of one vector, is
    split into blocks by a hash of the key.
    """

    def __init__(self, train: DataFrame, key: str, vector: str, label: str, block_rows: int = BLOCK_ROWS,
                 pivots: int | None = None):
        rows = train.select(F.col(key).alias("near"), F.col(vector).alias("v"), F.col(label).cast("double").alias("near_label"))
        self.block_rows, self.near_type = block_rows, rows.schema["near"].dataType.simpleString()
        self.rows = train.count()
        wanted = pivots or min(PIVOTS, max(1, math.isqrt(self.rows)))
        chosen = rows.orderBy(F.xxhash64("near"), "near").limit(wanted).collect()
        self.pivots = np.unique(np.array([r.v for r in chosen], np.float64), axis=0) if chosen else np.zeros((0, 0))
        points = self.pivots

        def dealt(batches):
            for pdf in batches:
                if len(pdf):
                    d = _all_distances(points, _matrix(pdf["v"]))
                    pdf = pdf.assign(cell=d.argmin(axis=1), radius=d.min(axis=1))
                    yield pdf

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        self.cells = cut(rows.mapInPandas(dealt, f"{kinds}, cell int, radius double"))
        self.size, self.inner, self.outer = (np.zeros(len(points)) for _ in range(3))
        # one row per cell
        for r in self.cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("a"), F.max("radius").alias("b")).collect():
            self.size[r.cell], self.inner[r.cell], self.outer[r.cell] = r.n, r.a, r.b
        self.blocks = np.maximum(1, -(-self.size // block_rows)).astype(int)

    def first_visits(self, test: DataFrame, k: int) -> DataFrame:
        """(row, v, cell): for each test row the nearest cells that hold k rows together."""
        points, size = self.pivots, self.size

        def visits(batches):
            for pdf in batches:
                if len(pdf):
                    order = np.argsort(_all_distances(points, _matrix(pdf["v"])), axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1)
                    n = np.minimum((held < k).sum(axis=1) + 1, order.shape[1])
                    yield pdf.assign(cells=[o[:m].tolist() for o, m in zip(order, n)])

        return self._visits(test, visits)

    def further_visits(self, test: DataFrame, k: int) -> DataFrame:
        """(row, v, bound, cell): the cells not looked at yet that may hold a row within ``bound``."""
        points, size, inner, outer = self.pivots, self.size, self.inner, self.outer

        def visits(batches):
            for pdf in batches:
                if len(pdf):
                    d = _all_distances(points, _matrix(pdf["v"]))
                    order = np.argsort(d, axis=1, kind="stable")
                    place = np.argsort(order, axis=1, kind="stable")
                    n = np.minimum((np.cumsum(size[order], axis=1) < k).sum(axis=1) + 1, order.shape[1])
                    least = np.maximum(np.maximum(d - outer, inner - d), (d - d.min(axis=1)[:, None]) / 2)
                    bound = pdf["bound"].to_numpy()[:, None] * (1 + _SLACK) + _SLACK * (1 + d)
                    may = (place >= n[:, None]) & (size > 0) & (least <= bound)
                    yield pdf.assign(cells=[np.flatnonzero(m).tolist() for m in may])

        return self._visits(test, visits)

    def _visits(self, test: DataFrame, visits) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in test.schema.fields)
        listed = test.mapInPandas(visits, f"{kinds}, cells array<int>")
        return listed.withColumn("cell", F.explode("cells")).drop("cells")

    def _look(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best rows of each visited block for each test row."""
        blocks = F.element_at(F.array(*[F.lit(int(b)) for b in self.blocks]), F.col("cell") + 1)
        # as many blocks of test rows per cell as its visitors need, counted
        crowds = visits.groupBy("cell").agg(F.count("*").alias("n"))
        crowd = F.ceil(F.col("n") / self.block_rows).cast("int").alias("crowds")
        crowds = F.broadcast(crowds.select("cell", crowd))  # one row per cell, at most PIVOTS
        right = (visits.join(crowds, "cell")
                 .withColumn("q", F.pmod(F.xxhash64("row"), F.col("crowds")).cast("int"))
                 .withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("crowds"))
        left = (self.cells.join(crowds, "cell")
                .withColumn("b", F.pmod(F.xxhash64("near"), blocks).cast("int"))
                .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds"))
        points = self.pivots
        row_type = visits.schema["row"].dataType.simpleString()

        def closest(near: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(near) and len(rows):
                near = near.sort_values("near", kind="stable")
                ids, labels, radius = (near[c].to_numpy() for c in ("near", "near_label", "radius"))
                base, tests, names = _matrix(near["v"]), _matrix(rows["v"]), rows["row"].to_numpy()
                to_pivot = np.sqrt(((tests - points[near["cell"].iloc[0]]) ** 2).sum(axis=1))
                reach = rows["bound"].to_numpy() * (1 + _SLACK) + _SLACK * (1 + to_pivot)
                step = max(1, _CHUNK // base.size)
                for s in range(0, len(tests), step):
                    part = slice(s, s + step)
                    # rows outside the ring of every test row of the chunk are not measured
                    low, high = (to_pivot[part] - reach[part]).min(), (to_pivot[part] + reach[part]).max()
                    inside = np.flatnonzero((radius >= low) & (radius <= high))
                    if not len(inside):
                        continue
                    own, pick, d = _closest(base[inside], tests[part], k)
                    pick = inside[pick]
                    out.append(pd.DataFrame({"row": names[part][own], "near": ids[pick], "near_label": labels[pick], "distance": d}))
            if not out:
                return pd.DataFrame({"row": [], "near": [], "near_label": [], "distance": []})
            return pd.concat(out, ignore_index=True)

        return left.groupBy("cell", "b", "q").cogroup(right.groupBy("cell", "b", "q")).applyInPandas(
            closest, f"row {row_type}, near {self.near_type}, near_label double, distance double")

    def search(self, test: DataFrame, key: str, vector: str, k: int) -> DataFrame:
        """The k closest training rows of each test row, by distance, then by key: columns row,
        near, near_label, distance, rank. Keys of test rows are unique."""
        test = test.select(F.col(key).alias("row"), F.col(vector).alias("v"))
        if not len(self.pivots):
            return (test.select("row", F.lit(None).cast(self.near_type).alias("near"), F.lit(None).cast("double").alias("near_label"),
                                F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).where("false"))
        open_ = F.lit(float("inf"))
        first = cut(_best(self._look(self.first_visits(test, k).withColumn("bound", open_), k), k))
        bounds = first.groupBy("row").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(open_).alias("bound"))
        more = self._look(self.further_visits(test.join(bounds, "row"), k), k)
        return _best(first.drop("rank").unionAll(more), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(train: DataFrame, test: DataFrame, k: int, key: str, vector: str, label: str,
               block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """The k closest training rows of each test row, by Euclidean distance, then by key."""
    return PivotIndex(train, key, vector, label, block_rows, pivots).search(test, key, vector, k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _all_distances(base: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all points to a bounded number of pivots, in chunks."""
    step = max(1, _CHUNK // max(base.size, 1))
    return np.concatenate([_distances(base, points[s:s + step]) for s in range(0, len(points), step)])


def _distances(base: np.ndarray, points: np.ndarray) -> np.ndarray:
    """One row of distances per point; the caller bounds the number of points."""
    return np.sqrt(((base[None, :, :] - points[:, None, :]) ** 2).sum(axis=2))


def _closest(base: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k closest rows of ``base`` to each point: places of points and rows, and the distances.

    A matrix product says which rows may be among them, with more slack than its rounding
    needs; distances are measured for these alone.
    """
    lengths, own_lengths = (base ** 2).sum(axis=1), (points ** 2).sum(axis=1)
    rough = lengths - 2 * points @ base.T
    may = np.ones(rough.shape, bool)
    if len(base) > k and np.isfinite(rough).all():
        slack = _SLACK * (1 + lengths.max() + own_lengths)
        may = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None]
    picks, found = [], []
    for i, one in enumerate(may):
        rows = np.flatnonzero(one)
        d = _distances(base[rows], points[i: i + 1])[0]
        best = _smallest(d, k)
        picks.append(rows[best])
        found.append(d[best])
    return np.repeat(np.arange(len(points)), [len(p) for p in picks]), np.concatenate(picks), np.concatenate(found)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest values, the earlier position on ties."""
    if len(d) > k:
        limit = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= limit)
    else:
        near = np.arange(len(d))
    return near[np.argsort(d[near], kind="stable")][:k]


def _weights(found: DataFrame, weights: str) -> DataFrame:
    """1 per neighbour, or the inverse distance; exact matches then outvote all others."""
    if weights == "uniform":
        return found.withColumn("w", F.lit(1.0))
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("row"))
    return found.withColumn("w", F.when(exact == 1, (F.col("distance") == 0).cast("double"))
                            .otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))


def classify(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """Class with the largest weight among the neighbours, the smallest class on ties."""
    votes = _weights(found, weights).groupBy("row", "near_label").agg(F.sum("w").alias("w"))
    best = F.min(F.struct((-F.round("w", 9)).alias("k"), F.col("near_label").alias("c")))
    return votes.groupBy("row").agg(best["c"].alias("prediction"))


def regress(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """Weighted mean of the neighbours' targets."""
    return _weights(found, weights).groupBy("row").agg(
        (F.sum(F.col("w") * F.col("near_label")) / F.sum("w")).alias("prediction"))
