"""Ingest: files to the next version of the supplier registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.operators.aggregates import fold_lines
from spendweave.operators.audit import audit_rows
from spendweave.operators.merge import upsert_suppliers, upsert_summary
from spendweave.params import Params
from spendweave.session import cut
from spendweave.sources.delimited import map_layouts, read_delimited


def resolve_entities(lines: DataFrame, suppliers: DataFrame, params: Params, amount_mode: str = "replace", actor: str = "job") -> dict[str, DataFrame]:
    """Mapped lines folded per entity and merged into the registry."""
    folded, _ = cut(fold_lines(lines))
    out = upsert_suppliers(suppliers, folded, params, amount_mode)
    events = out["actions"].where(F.col("action") != "unchanged")
    out["summary"] = upsert_summary(out["actions"], folded)
    out["audit"] = audit_rows(events, "supplier", "id", F.col("action"), ["name", "changed_fields"], actor, params)
    return out


def ingest_files(spark: SparkSession, path: str, suppliers: DataFrame, params: Params, comment: str | None = None, style: str = "auto") -> dict[str, DataFrame]:
    """Read a file set, map its columns and resolve its entities; rejected and shifted rows are side outputs."""
    read = read_delimited(spark, path, comment)
    lines, rejects = map_layouts(read, style, params)
    return resolve_entities(lines, suppliers, params) | {"rejects": rejects, "shifted": read.shifted, "errors": read.errors}
