"""Report sections as files, their provenance, and the report catalogue."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.text import squeeze
from spendweave.functions.values import round_to
from spendweave.operators.families import display_order, display_rows
from spendweave.session import spread_join

VERBOSE_ONLY = ["sic", "country", "subsidiary_count", "parent_source", "stale_reason"]


def _blank(name: str, rows: DataFrame) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def _flag(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit(False)), "true").otherwise("false")


def _moment(name: str, rows: DataFrame) -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")) if name in rows.columns else F.lit("")


def supplier_export(labelled: DataFrame, verbose: bool = False) -> DataFrame:
    """Detail section: one projection over list rows that already carry ``parent_label``."""
    r = labelled
    label = F.col("parent_label")
    columns = [
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"),
        *[_blank(c, r).alias(c) for c in ("domain", "industry", "naics", "sic", "country")],
        _blank("effective_code", r).alias("unspsc_code"), _blank("segment", r).alias("segment"), _blank("family", r).alias("family"),
        _blank("class_name", r).alias("class"), _blank("commodity", r).alias("commodity"),
        F.col("confidence").cast("decimal(3,2)").alias("confidence"),
        _flag("inherited_from_parent").alias("inherited_from_parent"), _flag("reviewed").alias("reviewed"),
        _blank("llm_model", r).alias("llm_model"), squeeze(_blank("reasoning", r)).alias("reasoning"),
        F.col("parent_id"), F.when(label == "Independent", "").otherwise(label).alias("parent_name"), _flag("is_parent").alias("is_parent"),
        F.col("subsidiary_count"), _blank("parent_source", r).alias("parent_source"),
        F.coalesce("total_amount", F.lit(0)).cast("decimal(18,2)").alias("total_amount"), F.col("currency"), F.col("transaction_count"),
        _moment("enriched_at", r).alias("enriched_at"), _flag("stale").alias("stale"), _blank("stale_reason", r).alias("stale_reason"),
        _moment("created_at", r).alias("created_at"), _moment("updated_at", r).alias("updated_at"),
    ]
    out = r.select(*columns)
    return out if verbose else out.drop(*VERBOSE_ONLY)


def segment_section(segments: DataFrame) -> DataFrame:
    return segments.select("segment_code", "segment", "suppliers", "spend", F.col("spend_share").alias("spend_share_percent"), "avg_confidence")


def rollup_section(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        F.col("root_id").alias("parent_id"), F.col("root_name").alias("parent_name"), F.coalesce("root_domain", F.lit("")).alias("parent_domain"),
        _flag("is_virtual").alias("is_virtual_parent"), F.coalesce("code", F.lit("")).alias("unspsc_code"), round_to(F.col("confidence"), 2).alias("confidence"),
        "supplier_count", "subsidiary_count", "total_amount", "stale_count", "low_confidence_count",
    )


def review_section(review: DataFrame) -> DataFrame:
    return review.select(
        "supplier_id", F.col("name").alias("supplier_name"), F.coalesce("code", F.lit("")).alias("unspsc_code"), F.coalesce("commodity", F.lit("")).alias("commodity"),
        "confidence", F.coalesce("parent_name", F.lit("")).alias("parent_name"), F.coalesce("llm_model", F.lit("")).alias("llm_model"),
        squeeze(F.coalesce("reasoning", F.lit(""))).alias("reasoning"), F.col("spend").alias("total_amount"),
    )


def family_edges(members: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """Parent line and subsidiary lines per cluster. The parent's amount is blank when it has subsidiaries.

    One line per edge, so the size of a family never becomes the size of a row.
    """
    lines = display_rows(members, cluster_rows)
    own = members.select(
        F.col("id").alias("supplier_id"), F.col("effective_code").alias("_code"), F.col("confidence").alias("_conf"), F.coalesce("total_amount", F.lit(0)).alias("_amount")
    )
    root_code = cluster_rows.select("cluster_key", F.col("root_id").alias("supplier_id")).join(own.select("supplier_id", "_code"), "supplier_id", "left")
    root_code = root_code.select("cluster_key", F.coalesce("_code", F.lit("")).alias("parent_code"))
    coded = spread_join(lines.join(own, "supplier_id", "left"), root_code, "cluster_key", spread_by="supplier_name", how="left")
    is_sub = F.col("role") == "subsidiary"
    return coded.select(
        "cluster_key",
        F.col("root_name").alias("parent_name"),
        "parent_code",
        "role",
        "indent",
        "supplier_id",
        "supplier_name",
        F.when(is_sub, F.coalesce("_code", F.lit(""))).otherwise(F.col("parent_code")).alias("unspsc_code"),
        F.when(is_sub, F.col("_conf")).alias("confidence"),
        F.when(is_sub, F.col("_amount")).when(F.col("subsidiary_count") == 0, F.col("cluster_total_amount")).alias("amount"),
        "cluster_total_amount",
        "root_name",
        "subsidiary_count",
    )


def hierarchy_export(members: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    return family_edges(members, cluster_rows).orderBy(*display_order()).drop("root_name", "subsidiary_count", "cluster_key", "indent", "supplier_id")


def report_metadata(summary: DataFrame, name: str, made_at: datetime, made_by: str, taxonomy_version: str, rollup: str, filters: list[str]) -> DataFrame:
    return summary.select(
        F.lit(name).alias("report"), F.lit(made_at.isoformat() + "Z").alias("generated_at"), F.lit(made_by).alias("generated_by"),
        F.lit(taxonomy_version).alias("taxonomy_version"), F.lit(rollup).alias("rollup"), F.lit("; ".join(filters) or "none").alias("filters"),
        "total_suppliers", "total_spend", "classified", "percent_classified", "low_confidence", "percent_low_confidence",
    )


def write_section(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(sections: dict[str, DataFrame], metadata: DataFrame, path: str, rollup: str = "supplier") -> list[str]:
    """One folder per section. The roll-up is written when asked for or when any family exists, the review
    appendix when it has rows; emptiness is tested with ``limit(1)``."""
    written = []
    for name, df in sections.items():
        if name == "rollup" and rollup != "parent" and not df.where(F.col("subsidiary_count") > 0).limit(1).count():
            continue
        if name == "review" and not df.limit(1).count():
            continue
        write_section(df, f"{path}/{name}")
        written.append(name)
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    return written


def list_reports(reports: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    size = min(100, max(1, size))
    return reports.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((max(1, number) - 1) * size).limit(size)


def report_retention(reports: DataFrame, keep: int = 30) -> tuple[DataFrame, DataFrame]:
    """Survivors (newest ``keep`` per format) and, per format, the number and bytes of what goes.

    Only survivors are ranked, and their limit is applied before the shuffle; what goes is the total less
    the survivors, so a format with most of the rows is never sorted in one task.
    """
    newest = Window.partitionBy("format").orderBy(F.col("created_at").desc(), F.col("id").desc())
    kept = reports.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
    sums = lambda df, n, b: df.groupBy("format").agg(F.count(F.lit(1)).alias(n), F.sum("size_bytes").alias(b))
    freed = sums(reports, "n", "b").join(sums(kept, "kn", "kb"), "format").select(
        "format", (F.col("n") - F.col("kn")).alias("deleted"), (F.col("b") - F.col("kb")).alias("freed_bytes")
    )
    return kept, freed


def filters_json(filters: dict) -> str:
    return json.dumps(filters, sort_keys=True, default=str)
