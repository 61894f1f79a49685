"""Rows next to values fitted per group, without moving a frequent group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.session import cut

BROADCAST_ROWS = 100_000
SALTS = 32


# Rows of a narrow table that one task writes, and the tasks that a small one gets.
TASK_ROWS, LEAST_TASKS = 50_000, 8


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """A narrow result of at most about ``rows`` rows, in as many tasks as these need: a small table
    is not written as one file per shuffle partition."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def join_groups(df: DataFrame, groups: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join rows with ``groups``, which holds each key at most once.

    The groups are written and counted. Up to ``BROADCAST_ROWS`` of them are broadcast and
    the rows stay where they are. Beyond, a row joins on its key and one of ``SALTS``
    salts, so a frequent key, or no key at all, is spread over as many tasks. Both ways
    give the same rows; a NULL key matches nothing.
    """
    groups = cut(groups)
    if groups.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(groups), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
    copies = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])))
    # written tables are small on disk, and copies are not counted in the planner's size, so that it would broadcast them all
    return df.withColumn("_salt", salt).join(copies.hint("merge"), [on, "_salt"], how).drop("_salt")
