"""Session helpers: the shared folder, lineage cuts and a local session."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "storelab") -> SparkSession:
    """Session for tests and benches on one machine; jobs take the caller's session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STORELAB_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="storelab-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table inside the shared folder."""
    return f"{shared_dir(spark)}/storelab/{name}-{uuid.uuid4().hex}"


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Empty the tables that ``cut`` writes inside, once the results were read or written.

    A table is replaced by an empty one, which any file system that Spark writes to can do.
    Frames made inside must not be read afterwards.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            spark.createDataFrame([], "emptied int").write.mode("overwrite").parquet(path)


def cut(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compute ``df`` once, as a parquet table in the shared folder, and read it back.

    Used for narrow intermediate results that are read several times and must be the
    same each time (sampled range boundaries, repeated filters). The files outlive a
    lost executor, readers take only the columns they need, and their size is known to
    the planner. With ``by`` there is one folder per value, so that a filter on it reads
    one folder.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.partitionBy(*by).parquet(path, compression="zstd")
    for made in _SCOPES[-1:]:
        made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
