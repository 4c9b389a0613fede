"""Stored tables as plain Parquet folders, one below the other: a version is a folder that its writer names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spendweave.schemas import TABLES


class Table:
    """``<root>/<version>`` folders. The job that writes a version names it (its day, say), and writing it again replaces it.

    Nothing points to a newest version and nothing guards two writers of one name: where that matters, hand the DataFrames to
    a table format with transactions instead.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def exists(self, version: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/{version}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True

    def read(self, version: str | None = None) -> DataFrame:
        """A version's rows; without a version, an empty table to begin with."""
        if version is None:
            if self.schema is None:
                raise ValueError("an empty table needs a schema")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{version}")

    def write(self, df: DataFrame, version: str, partition_by: list[str] | None = None) -> None:
        """``df`` mustn't be read from the version that it replaces."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{version}")


class Lake:
    """The named tables of one deployment under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", TABLES[name])

    def present(self, version: str) -> list[str]:
        return [name for name in TABLES if self.table(name).exists(version)]
