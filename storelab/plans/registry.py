"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelab.sources.apps import apps_sql

AS_OF = "2002-01-01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def on_apps(select: str, *ctes: str) -> str:
    """SQL over the ``apps`` view and further CTEs."""
    return "with " + ",\n".join([apps_sql(), *ctes]) + "\n" + select


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def number(c: str) -> str:
    """SQL for a number read from text: 0.0 if unreadable, NULL if missing."""
    pattern = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
    return (f"(case when {c} is null or lower(trim({c})) = 'nan' then null "
            f"when regexp_full_match({c}, '{pattern}') then try_cast(trim({c}) as double) else 0.0::double end)")


def days(c: str, fmt: str = "%B %-d, %Y") -> str:
    return f"date_diff('day', cast(try_strptime({c}, '{fmt}') as date), date '{AS_OF}')"
