"""A stored classification history: written and corrected by touched partitions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.operators.history import cleared, cleared_ids, newest_written, numbered_rows, superseded_by
from spendweave.params import Params
from spendweave.session import cut

#: Buckets of suppliers in a stored history; a batch reads and rewrites the live rows of the buckets that it touches.
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("supplier_id"), F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, batch: str, buckets: int) -> DataFrame:
    """Closed rows lie under the batch that closed them, live rows under one constant."""
    live = ~F.col("superseded")
    return rows.withColumn("live", live).withColumn("bucket", _bucket(buckets)).withColumn("batch", F.when(live, "live").otherwise(batch))


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.repartition("live", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("live", "bucket", "batch").parquet(path)


def create(history: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Lay out ``history`` under ``path``: live and closed rows apart, both by supplier bucket."""
    _overwrite(_placed(history, "first", buckets), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole history, without the columns of its layout."""
    return spark.read.parquet(path).drop("live", "bucket", "batch")


def _live(spark: SparkSession, path: str, suppliers: DataFrame, buckets: int) -> DataFrame:
    """Live rows of the buckets that hold any of ``suppliers(supplier_id)``; other partitions aren't opened."""
    touched = sorted(r[0] for r in suppliers.select(_bucket(buckets).alias("b")).distinct().collect())  # no more than BUCKETS
    stored = spark.read.parquet(path)
    return stored.where(F.col("live") & F.col("bucket").isin(touched)).drop("live", "bucket", "batch")


def append(spark: SparkSession, path: str, new: DataFrame, params: Params, batch: str, order: list[str] | None = None, top: int | None = None, buckets: int = BUCKETS) -> None:
    """Write a batch of classifications: superseded live rows move to the closed partitions of ``batch``, touched live buckets are rewritten.

    The closed history is neither read nor shuffled (but for the highest id, where ``top`` doesn't give it); a batch's closed
    partitions are overwritten, not added to, when it is repeated. Both kinds of partitions are replaced by one job, but files of
    a partition become visible one by one: readers that mustn't see a batch half done need a table format with transactions.
    """
    stored = spark.read.parquet(path)
    top = (stored.agg(F.max("id")).first()[0] or 0) if top is None else top
    schema = stored.drop("live", "bucket", "batch").schema
    numbered = numbered_rows(schema, new, params, top, order)
    numbered = numbered.select(*[(F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    last = newest_written(numbered)
    rows, _ = cut(superseded_by(_live(spark, path, last, buckets).unionByName(numbered), last))
    _overwrite(_placed(rows, batch, buckets), path)


def clear(spark: SparkSession, path: str, suppliers: DataFrame, buckets: int = BUCKETS) -> None:
    """Undo the corrections on the live rows of ``suppliers(id)``: only the live rows of their buckets are read and rewritten."""
    live = _live(spark, path, suppliers.select(F.col("id").alias("supplier_id")), buckets)
    rows, _ = cut(cleared(live, cut(cleared_ids(live, suppliers))[0]))
    _overwrite(_placed(rows, "live", buckets), path)
