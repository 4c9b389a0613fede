"""Streaming counters: model usage per day, requests per sliding minute, audit actions per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def usage_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily counters per model. State is one row per model and open day; rows later than the watermark are
    dropped and counted in the query's progress (``numRowsDroppedByWatermark``)."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "model")
        .agg(
            F.count(F.lit(1)).alias("request_count"), F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"), F.sum("failures").alias("failure_count"),
        )
        .select(F.col("window.start").alias("window_start"), "model", "request_count", "prompt_tokens", "completion_tokens", "failure_count")
    )


def rate_stream(calls: DataFrame, per_minute: int, key: str = "model", span: str = "60 seconds", slide: str = "1 second", late: str = "5 minutes") -> DataFrame:
    """Requests per key and sliding window, with whether the limit is reached."""
    counted = calls.withWatermark("ts", late).groupBy(F.window("ts", span, slide), key).agg(F.count(F.lit(1)).alias("in_window"))
    return counted.select(F.col("window.start").alias("window_start"), key, "in_window", (F.col("in_window") >= per_minute).alias("at_limit"))


def audit_stream(audit: DataFrame, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    counted = audit.withWatermark("created_at", late).groupBy(F.window("created_at", bucket), "action").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), "action", "events")


def run_available(counters: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and keep each batch's updates as files; read them with ``latest``.

    A replayed batch overwrites its own folder, so every update is kept exactly once.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = counters.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key."""
    values = [c for c in updates.columns if c not in keys + ["batch_id", "batch"]]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
