"""Time operators: sliding request counts and missed schedule slots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.values import as_of

WINDOW_SECONDS = 60


def rate_window(calls: DataFrame, per_minute: int, key: str = "model", ts: str = "ts", span: int = WINDOW_SECONDS) -> DataFrame:
    """Requests in the ``span`` seconds ending at each call (half-open at the old end), whether the limit is
    reached, and the wait in milliseconds until a slot frees up.

    A window never reaches back further than the previous ``span``-long bucket, so each call is also
    copied into the following bucket and windows run per (key, bucket): a key with a third of all calls
    is spread over time instead of being sorted in one task.
    """
    width = span * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    spread = calls.withColumn("_at", at).withColumn("_home", F.floor(F.col("_at") / F.lit(width)))
    spread = spread.withColumn("_bucket", F.explode(F.array("_home", F.col("_home") + 1)))
    recent = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = spread.withColumn("in_window", F.count(F.lit(1)).over(recent)).withColumn("_oldest", F.min("_at").over(recent))
    native = counted.where(F.col("_bucket") == F.col("_home"))
    over = F.col("in_window") >= per_minute
    wait = F.greatest(F.lit(0), F.floor((F.col("_oldest") + width - F.col("_at")) / 1000)).cast("long")
    return (
        native.withColumn("at_limit", over)
        .withColumn("next_slot_ms", F.when(over, wait).otherwise(F.lit(0).cast("long")))
        .drop("_at", "_home", "_bucket", "_oldest")
    )


def missed_slots(runs: DataFrame, every: timedelta, moment: datetime, look_back: timedelta = timedelta(days=7), key: str = "schedule", ts: str = "ran_at") -> DataFrame:
    """Due slots after each schedule's last run, up to ``moment``, at most ``look_back`` old.

    Slots lie at whole multiples of the interval. Per schedule only the last run is kept, so at most
    ``look_back / every`` slots are made for each.
    """
    step = int(every.total_seconds())
    now, floor = int(_epoch(moment)), int(_epoch(moment - look_back))
    last = runs.groupBy(key).agg(F.max(F.unix_seconds(F.col(ts).cast("timestamp"))).alias("_last"))
    since = F.greatest(F.col("_last"), F.lit(floor))
    first = (F.floor(since / F.lit(step)) + 1) * step
    slots = last.withColumn("_first", first).where(F.col("_first") <= now).select(key, "_last", F.explode(F.sequence("_first", F.lit(now), F.lit(step))).alias("_slot"))
    return slots.select(key, F.timestamp_seconds("_slot").alias("slot"), F.timestamp_seconds("_last").alias("last_run"))


def _epoch(moment: datetime) -> float:
    return (moment - datetime(1970, 1, 1)).total_seconds()
