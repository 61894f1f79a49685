"""Compare queries with their SQL on the same files; used by the tests."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(([_cell(v) for v in r] for r in df.itertuples(index=False, name=None)), key=repr)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    for c in spark_df.columns:
        if spark_df[c].isna().any() and str(sql_df[c].dtype) == "Int64":
            # pandas makes whole numbers with gaps to floats, DuckDB to a type of its own
            if spark_df[c].dtype.kind == "f" and (spark_df[c].dropna() % 1 == 0).all():
                spark_df = spark_df.assign(**{c: spark_df[c].astype("Int64")})
        kinds = (spark_df[c].dtype.kind, sql_df[c].dtype.kind)
        if kinds[0] != kinds[1] and {"i", "f"} >= set(kinds):
            return f"type of {c}: {spark_df[c].dtype} / {sql_df[c].dtype}"
    a, b = rows(spark_df), rows(sql_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows, first {bad[0]}" if bad else None
