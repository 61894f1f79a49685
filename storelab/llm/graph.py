"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.operators.lookup import in_few_tasks, join_groups
from storelab.session import cut


def _settled(edges: DataFrame, rows: int) -> bool:
    """Whether edges (a, b) with a > b are stars already: no node has two, or both one up and one down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select("b", F.lit(0), F.lit(1)))
    seen = in_few_tasks(ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("uses")), rows)
    return (seen.agg(F.max("uses")).first()[0] or 0) < 2


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = in_few_tasks(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), rows)
    # a hub has many edges, so its edges are not brought together; one edge comes out for each, so repeats may stay
    return join_groups(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(in_few_tasks(down.groupBy("a").agg(F.min("b").alias("m")), rows))
    moved = join_groups(down, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return in_few_tasks(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), rows)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): every node of an edge that is not the smallest of its component.

    Each round is two aggregates and two joins whose result is written to the shared
    folder; a star of any size is one round, a chain of n nodes about log n rounds. The rounds
    end once all edges are stars, which one aggregate tells. Only that answer reaches the
    driver. Nodes without edges are not returned. ``rows``, if known, bounds the number of edges.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    distinct = ends.where("a <> b").distinct()
    now = cut(distinct if rows is None else in_few_tasks(distinct, rows))
    rows = now.count()
    while not _settled(now, rows):
        now = cut(_small_star(_large_star(now, rows), rows))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
