"""Centroid clustering (Lloyd's rounds on integer vectors) over a vector approximation file.

Every component is reduced to a cell of ``BITS`` bits; a vector's cells are packed into a
sixth of its integers' size. Cell borders follow mean and deviation of each dimension over
all vectors, the outermost ones its least and largest value, so a cell bounds its
component exactly. Per centroid and dimension a lookup table holds the least and the
largest share of the squared distance for each cell. Shares are taken around the mean of
the centroids; what they have in common, the distance to that mean, is the same for all
centroids and left out. Summed over the dimensions they give an interval per centroid. If
one interval ends before all others begin, its centroid is the nearest; only vectors whose
intervals overlap, or that change their cluster, are fetched and measured exactly.

The full vectors lie in a table bucketed by row number, which joins fetch from without
moving it: only (row, cells, cluster) of the rows to fetch is shuffled. Sums of a cluster
are kept on and changed by the vectors that enter or leave it; tasks add up their vectors
first, so a round sends k rows per task and k * 64 numbers to the driver. The first round has
no cluster to compare with, and the last assignment needs the distance of every vector, so
these two read all vectors once.

All arithmetic is on integers: float64 products where all values are below 2**53, int64
beyond.

Defined results: a vector without exactly ``dims`` components, or with a null, NaN or
infinite one, is left out; a null ``vec_id`` counts as empty text in the order of the first
centroids, equal ids follow by vector; repeated rows are vectors of their own; with fewer
vectors than k there are as many centroids as vectors; an empty table gives no rows; a
component beyond 2**27 after scaling is an error, as distances would not fit a long; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.session import cut, scratch_path

BITS = 6
DIMS, SCALE = 64, 256
LARGEST = 1 << 27
# Inner borders lie between these multiples of the deviation.
REACH = 2.6
BUCKET_BYTES = 128 << 20
CHUNK = 4096


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, vector) of the vectors that count."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = (F.size("embedding") == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.forall(whole, lambda v: F.abs(v) <= LARGEST)
    return (embeddings.where(F.coalesce(usable, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                    F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is beyond 2**27 after scaling")).cast("array<long>"))
                    .cast("array<int>").alias("vector")))


def stored(vectors: DataFrame, dims: int) -> DataFrame:
    """The vectors as a table in buckets of the row number, in the shared folder."""
    spark = vectors.sparkSession
    n = vectors.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (4 * dims + 16) // BUCKET_BYTES))
    name = f"vectors_{uuid.uuid4().hex}"
    (vectors.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row")
     .option("path", scratch_path(spark, "vectors")).saveAsTable(name))
    return spark.table(name)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers, exactly."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, one row per vector."""
    x = x.astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * product(x, centroids.T) + (centroids * centroids).sum(axis=1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


class Cells:
    """Cell borders of every dimension; cell c of a dimension holds the integers low[c] to high[c]."""

    def __init__(self, least, most, mean, deviation, bits: int = BITS):
        steps = np.linspace(-REACH, REACH, (1 << bits) - 1)
        self.bits, self.borders = bits, np.floor(mean + np.outer(steps, deviation)).astype(np.int64).T.copy()
        dims = len(self.borders)
        self.low = np.concatenate([least[:, None], self.borders + 1], axis=1)
        self.high = np.concatenate([self.borders, most[:, None]], axis=1)
        # the outermost values of all vectors bound every cell
        self.low, self.high = np.maximum(self.low, least[:, None]), np.minimum(self.high, most[:, None])
        self.dims = dims

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.borders[d], x[:, d], "left") for d in range(self.dims)], axis=1).astype(np.uint8)

    def packed(self, cells: np.ndarray) -> np.ndarray:
        """One row of bytes per vector."""
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return np.packbits(bits.reshape(len(cells), -1), axis=1)

    def unpacked(self, raw: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(raw, axis=1)[:, : self.dims * self.bits].reshape(len(raw), self.dims, self.bits)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.uint8)
        return (bits * weights).sum(axis=2, dtype=np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest share of the distance by dimension, cell and centroid."""
        around = centroids.sum(axis=0) // len(centroids)
        e = centroids - around
        ends = np.stack([self.low, self.high]) - around[:, None]
        shares = -2 * ends[:, :, :, None] * e.T[None, :, None, :] + (e * e).T[None, :, None, :]
        return shares.min(axis=0), shares.max(axis=0)


def nearest_by_cells(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest centroid of each vector, or -1 where the intervals of several overlap."""
    low, high = (np.zeros((len(cells), t.shape[2]), np.int64) for t in tables)
    for d in range(cells.shape[1]):
        low += tables[0][d][cells[:, d]]
        high += tables[1][d][cells[:, d]]
    open_ = low <= high.min(axis=1)[:, None]
    return np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), -1)


def _blobs(raw: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((np.arange(len(raw) + 1) * raw.shape[1]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets, pa.py_buffer(raw.tobytes())])


def _raw(column: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(len(column), -1)


def fitted_cells(vectors: DataFrame, dims: int) -> Cells:
    """Cells from the extremes, mean and deviation of each dimension over all vectors."""
    def run(batches):
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        least, most = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            if len(x):
                n += len(x)
                total += x.sum(axis=0)
                squares += (x.astype(np.float64) ** 2).sum(axis=0)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(least), pa.array(most),
                                              pa.array(total), pa.array(squares)], ["dim", "n", "least", "most", "total", "squares"])

    parts = vectors.select("vector").mapInArrow(run, "dim long, n long, least long, most long, total double, squares double")
    rows = parts.groupBy("dim").agg(F.sum("n"), F.min("least"), F.max("most"), F.sum("total"), F.sum("squares")).orderBy("dim").collect()
    n, least, most, total, squares = (np.array([r[i] for r in rows]) for i in range(1, 6))
    mean = total / n
    return Cells(least, most, mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)))


_STATE = "kind string, row long, cells binary, cluster int, n long, sums array<long>"


def _state_batch(rows, cells, clusters) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(["row"] * n), rows, cells, pa.array(clusters.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
        ["kind", "row", "cells", "cluster", "n", "sums"])


def _sums_batch(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    k = len(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(["sum"] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array(counts),
         pa.array(list(sums), pa.list_(pa.int64()))], ["kind", "row", "cells", "cluster", "n", "sums"])


def _add(counts, sums, clusters, x, sign) -> None:
    np.add.at(counts, clusters, sign)
    order = np.argsort(clusters, kind="stable")
    found, first = np.unique(clusters[order], return_index=True)
    if len(found):
        sums[found] += sign * np.add.reduceat(x[order].astype(np.int64), first, axis=0)


def _first_round(vectors: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Cells and nearest centroid of every vector, and the sums of each task."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x = matrix(part.column("vector"), dims)
                own = distances(x, centroids).argmin(axis=1)
                _add(counts, sums, own, x, 1)
                yield _state_batch(part.column("row"), _blobs(cells.packed(cells.of(x))), own)
        yield _sums_batch(counts, sums)

    return cut(vectors.select("row", "vector").mapInArrow(run, _STATE), ["kind"])


def _by_cells(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(row, cells, cluster, fetch): rows to fetch keep their old cluster, the others have their new one."""
    tables = cells.tables(centroids)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                old = part.column("cluster").to_numpy()
                new = nearest_by_cells(cells.unpacked(_raw(part.column("cells"))), tables)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("cells"), part.column("cluster"), pa.array(new != old)],
                                                 ["row", "cells", "cluster", "fetch"])

    return cut(state.select("row", "cells", "cluster").mapInArrow(run, "row long, cells binary, cluster int, fetch boolean"), ["fetch"])


def _by_vectors(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Nearest centroid of fetched vectors, and what enters and leaves each cluster per task."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x, old = matrix(part.column("vector"), dims), part.column("cluster").to_numpy()
                new = distances(x, centroids).argmin(axis=1)
                moved = new != old
                _add(counts, sums, new[moved], x[moved], 1)
                _add(counts, sums, old[moved], x[moved], -1)
                yield _state_batch(part.column("row"), part.column("cells"), new)
        yield _sums_batch(counts, sums)

    return cut(fetched.select("row", "cells", "cluster", "vector").mapInArrow(run, _STATE), ["kind"])


def _changes(made: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by cluster: one row per task and cluster is read, one per cluster collected."""
    rows = (made.where("kind = 'sum'").groupBy("cluster")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("totals")).collect())
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in rows:
        counts[r.cluster], sums[r.cluster] = r.n, r.totals
    return counts, sums


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings, dims, scale), dims)
    centroids = first_centroids(vectors, k, salt)
    if len(centroids):
        centroids = _moved_centroids(vectors, centroids, rounds)
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                d = distances(matrix(part.column("vector"), dims), centroids)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])],
                                                 ["vec_id", "cluster", "distance"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    made = cut(vectors.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    sums = {r.cluster: int(r.total) for r in
            made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = sum(sums.values())
    # one row per centroid
    told = spark.createDataFrame([(c, sums[c], whole, names[c]) for c in range(k) if c in sums],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (made.join(F.broadcast(told), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _moved_centroids(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    k, dims = centroids.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    state, cells = None, fitted_cells(vectors, dims) if rounds else None
    for _ in range(rounds):
        if state is None:
            made = _first_round(vectors, cells, centroids)
            state = made.where("kind = 'row'")
        else:
            seen = _by_cells(state, cells, centroids)
            asked = seen.where("fetch").select("row", "cells", "cluster")
            made = _by_vectors(asked.join(vectors.select("row", "vector"), "row"), centroids)
            state = (seen.where("not fetch").select("row", "cells", "cluster")
                     .unionAll(made.where("kind = 'row'").select("row", "cells", "cluster")))
        more_counts, more_sums = _changes(made, k, dims)
        counts, sums = counts + more_counts, sums + more_sums
        filled = counts > 0
        centroids = centroids.copy()
        centroids[filled] = sums[filled] // counts[filled][:, None]
    return centroids
