"""Fitted models whose content is tables: they are made, read and stored by executors, so they
may be larger than the driver. The driver holds their parameters and a few numbers."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.session import cut


class TableModel(Model, MLWritable, MLReadable):
    """A model with named tables, a few numbers (``facts``) and ordinary parameters."""

    TABLES: tuple[str, ...] = ()

    facts = Param(Params._dummy(), "facts", "numbers of the fit, as JSON", TypeConverters.toString)

    def __init__(self, tables: dict[str, DataFrame] | None = None, facts: dict | None = None):
        super().__init__()
        self.tables = tables or {}
        self._set(facts=json.dumps(facts or {}))

    def fact(self, name: str):
        return json.loads(self.getOrDefault("facts"))[name]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        model = self.cls()
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        model.tables = {n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in self.cls.TABLES}
        return model


ROW = "_row_of_model"


def numbered(df: DataFrame) -> DataFrame:
    """The rows, written once, with a number of their own, on which results are put back."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def put_back(df: DataFrame, results: DataFrame) -> DataFrame:
    """Add the columns of ``results`` (with ``ROW``) to the numbered rows, all of which stay."""
    return df.join(results, ROW, "left").drop(ROW)
