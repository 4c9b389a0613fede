"""Session preparation and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the semantics the operators rely on: UTC days, and adaptive execution for skew splitting."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


def cut(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives lost executors, its size is known to the planner (so small ones are
    broadcast and large ones are not), and ``metrics`` are gathered by the same job that writes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    values: dict = {}
    if metrics:
        seen = Observation(uuid.uuid4().hex)
        df = df.observe(seen, *[column.alias(name) for name, column in metrics.items()])
        df.write.parquet(path)
        values = seen.get
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), values


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to four tasks a core, for rows of few bytes and much work.

    The number is given: adaptive execution would put so few bytes back into a task or two.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", group: str | None = None) -> DataFrame:
    """Row numbers over a distributed sort, optionally restarting per value of ``group`` (few values).

    A plain window without a partition key moves every row into one task. Here the rows are range
    partitioned, numbered inside their partition, and shifted by the row counts of the partitions
    before them; only (partition, group) counts are ever summed in one place. ``order`` must be total.
    """
    keys = ([F.col(group).asc()] if group else []) + list(order)
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    placed, _ = cut(placed)
    by = ["_part"] + ([group] if group else [])
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = f"sum(_n) over ({'partition by ' + group if group else ''} order by _part rows between unbounded preceding and 1 preceding)"
    shift = counts.select(*by, (F.coalesce(F.expr(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # one row per (range partition, group value): bounded by the partition count, whatever the data size
    return (
        placed.join(F.broadcast(shift), by)
        .withColumn(name, (F.col("_pos") + F.col("_shift")).cast("long"))
        .drop("_part", "_pos", "_shift")
    )


HOT_ROWS = 10_000  # fewer rows than this on one key need no spreading
HOT_SHARE = 4  # a key is hot from a fourth of a partition's fair share on


def spread_join(
    many: DataFrame, one: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = 64
) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``) when a few keys may hold a large share of ``many``.

    Keys are counted once, with partial aggregation, rows without a key as well. Those with more than ``HOT_ROWS`` rows and more than a fourth of what a
    partition would get if all were equal are salted on the many side (by a hash of ``spread_by``, so a retried task repeats
    its choice) and repeated on the one side, so the result is exact. There can be no more than four times as many hot keys as
    shuffle partitions, so broadcasting them is bounded. Rows without a key meet nothing and are spread as well.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.lit(1).alias("_one"))
    hot = (
        counts.where(F.col(key).isNotNull() & (F.col("_n") > HOT_ROWS)).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
        .where(F.col("_n") * parts * HOT_SHARE > F.col("_all")).select(key, F.lit(True).alias("_hot"))
    )
    left = (
        many.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0))
        .drop("_hot")
    )
    right = (
        one.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
