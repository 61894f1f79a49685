"""Clustering over approximations against plain rounds, and on edge cases."""

import hashlib
import math

import numpy as np
import pytest

from storelab.llm import va_clustering as va

SCHEMA = "vec_id long, embedding array<float>, label int, `row` long, cluster int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, "k") for i, e in rows], SCHEMA).repartition(5)


def plain(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], object).reshape(-1, dims)
    c = x[:k].copy()

    def assign():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = [min(range(len(c)), key=lambda j: (r[j], j)) for r in d]
        return own, [r[j] for r, j in zip(d, own)]

    for _ in range(rounds):
        own = np.array(assign()[0])
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    own, d = assign()
    sums = {j: sum(a for a, b in zip(d, own) if b == j) for j in own}
    name = {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in own}
    return sorted((-1 if i is None else i, j, a, sums[j], sum(d), name[j]) for (i, _), j, a in zip(kept, own, d))


def found(df, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in va.clustered(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = [(i, np.round(rng.normal(i % 5 / 4, 0.2, 64), 3).astype(np.float32).tolist()) for i in range(400)]
    out += [(1000 + i, [0.5] * 64) for i in range(200)]  # a third are copies
    out += [(7, out[7][1]), (None, [0.25] * 64), (None, [-0.25] * 64), (2000, None), (2001, [0.1] * 63), (2002, [0.1] * 65), (2003, []),
            (2004, [0.1] * 63 + [None]), (2005, [0.1] * 63 + [float("nan")]), (2006, [0.1] * 63 + [float("-inf")]), (2007, [3000.0] * 64)]
    return out


def test_clusters(spark, rows):
    assert found(frame(spark, rows)) == plain(rows)


def test_few_vectors_and_rounds(spark, rows):
    assert found(frame(spark, rows[:3])) == plain(rows[:3])
    assert found(frame(spark, rows[:50]), k=4, rounds=0) == plain(rows[:50], 4, 0)
    assert found(frame(spark, rows[:50]), k=1, rounds=2) == plain(rows[:50], 1, 2)


def test_empty_and_too_large(spark):
    assert found(frame(spark, [])) == [] and found(frame(spark, [(1, None)])) == []
    with pytest.raises(Exception, match="2\\*\\*27"):
        found(frame(spark, [(1, [1e9] * 64)]))


def test_intervals_hold_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 40, (500, 64)).astype(np.int64)
    centroids = x[:9].copy()
    cells = va.Cells(x.min(axis=0), x.max(axis=0), x.mean(axis=0), x.std(axis=0))
    own = cells.of(x)
    assert (cells.unpacked(cells.packed(own)) == own).all() and cells.packed(own).shape[1] == 48
    dim = np.arange(64)
    assert (cells.low[dim, own] <= x).all() and (x <= cells.high[dim, own]).all()
    low, high = cells.tables(centroids)
    around = centroids.sum(axis=0) // 9
    base = ((x - around) ** 2).sum(axis=1)
    d = va.distances(x, centroids)
    assert (low[dim, own].sum(axis=1) + base[:, None] <= d).all() and (d <= high[dim, own].sum(axis=1) + base[:, None]).all()
    near = va.nearest_by_cells(own, (low, high))
    assert (near[near >= 0] == d.argmin(axis=1)[near >= 0]).all() and (near >= 0).mean() > 0.1


def test_only_some_vectors_are_fetched(spark, sf_dir):
    """From the second round on vectors with one possible centroid stay where they are."""
    vectors = va.stored(va.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), 64)
    cells, centroids = va.fitted_cells(vectors, 64), va.first_centroids(vectors, 40, "2")
    made = va._first_round(vectors, cells, centroids)
    counts, sums = va._changes(made, 40, 64)
    seen = va._by_cells(made.where("kind = 'row'"), cells, sums // np.maximum(counts, 1)[:, None])
    asked = seen.where("fetch")
    assert 0 < asked.count() < 0.9 * vectors.count()
    # a small table may be broadcast; the join of a large one leaves the vectors in their buckets
    plan = asked.hint("merge").join(vectors.select("row", "vector"), "row")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_products_beyond_float():
    a = np.array([[(1 << 27) - 1] * 64], np.int64)
    assert va.distances(a, -a)[0, 0] == 64 * (2 * ((1 << 27) - 1)) ** 2
