"""Audit rows emitted by the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.values import as_of
from spendweave.params import Params


def audit_rows(df: DataFrame, entity: str, entity_id: str | None, action: str | Column, details: list[str], actor: str, params: Params) -> DataFrame:
    """One event per row of ``df``, with the named columns as JSON details."""
    return df.select(
        F.lit(None).cast("bigint").alias("id"),
        F.lit(entity).alias("entity"),
        (F.col(entity_id).cast("bigint") if entity_id else F.lit(None).cast("bigint")).alias("entity_id"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.to_json(F.struct(*details)).alias("details"),
        F.lit(actor).alias("actor"),
        as_of(params.as_of).cast("timestamp").alias("created_at"),
    )
