"""Summaries, segment shares, tallies, usage counters and the pre-aggregated fold of transaction lines."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.text import SPACE, entity_key, had_legal_suffix, title_case
from spendweave.functions.values import as_of, low_confidence, round_to
from spendweave.params import Params


def _spend() -> Column:
    return F.coalesce(F.sum("total_amount"), F.lit(0))


def _mean(value: str) -> Column:
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def _raw_stats(rows: DataFrame, params: Params) -> DataFrame:
    classified = F.col("classification_id").isNotNull()
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_suppliers"),
        _spend().alias("total_spend"),
        yes(classified).alias("classified"),
        yes(~classified).alias("unclassified"),
        yes(low_confidence(F.col("confidence"), F.col("reviewed"), params.confidence_threshold)).alias("low_confidence"),
        yes(F.col("reviewed")).alias("reviewed"),
        yes(F.col("inherited_from_parent")).alias("inherited"),
        yes(F.col("enriched_at").isNotNull()).alias("enriched"),
        yes(F.col("stale") | F.col("enriched_at").isNull()).alias("stale"),
        yes(F.col("is_parent")).alias("parents"),
        yes(F.col("parent_id").isNotNull()).alias("subsidiaries"),
        _mean("confidence").alias("mean_confidence"),
    )


def _percent(part: str) -> Column:
    return F.when(F.col("total_suppliers") > 0, F.col(part).cast("double") / F.col("total_suppliers") * 100.0).otherwise(0.0)


def report_summary(rows: DataFrame, params: Params) -> DataFrame:
    return _raw_stats(rows, params).select(
        "total_suppliers", "total_spend", "classified", "unclassified",
        round_to(_percent("classified"), 1).alias("percent_classified"),
        "low_confidence",
        round_to(_percent("low_confidence"), 1).alias("percent_low_confidence"),
        "reviewed", "inherited", "stale", "parents", "subsidiaries",
        round_to(F.col("mean_confidence"), 3).alias("average_confidence"),
    )


def supplier_stats(rows: DataFrame, params: Params) -> DataFrame:
    """Dashboard figures: the same counts, unrounded, with the number enriched."""
    return _raw_stats(rows, params).select(
        "*", _percent("classified").alias("percent_classified"), _percent("low_confidence").alias("percent_low_confidence")
    )


def segment_breakdown(rows: DataFrame) -> DataFrame:
    """Spend per two-digit segment over all rows; the grand total is a sum over the few segment rows."""
    code = F.col("effective_code")
    name = F.coalesce(F.col("segment"), F.when(code.isNotNull(), F.lit("Unmapped segment")).otherwise("Not classified"))
    parts = (
        rows.withColumn("_segment", F.coalesce(F.substring(code, 1, 2), F.lit("--")))
        .withColumn("_name", name)
        .groupBy("_segment")
        .agg(
            F.min_by("_name", F.struct(F.lower("name"), F.col("name"), F.col("id"))).alias("segment"),
            F.count(F.lit(1)).alias("suppliers"),
            _spend().alias("spend"),
            _mean("confidence").alias("_mean"),
        )
    )
    # the window spans at most 101 segment rows
    return (
        parts.withColumn("_total", F.sum("spend").over(Window.partitionBy()))
        .select(
            F.col("_segment").alias("segment_code"),
            "segment",
            "suppliers",
            "spend",
            F.when(F.col("_total") != 0, round_to(F.col("spend").cast("double") / F.col("_total").cast("double") * 100.0, 1))
            .otherwise(0.0)
            .alias("spend_share"),
            round_to(F.col("_mean"), 3).alias("avg_confidence"),
        )
        .orderBy(F.col("spend").desc(), "segment_code")
    )


def segment_breakdown_classified(rows: DataFrame, min_confidence: float | None = None) -> DataFrame:
    rows = rows.where(F.col("classification_id").isNotNull())
    if min_confidence is not None:
        rows = rows.where(F.col("confidence") >= min_confidence)
    return (
        rows.groupBy(
            F.coalesce(F.col("segment_code"), F.substring("effective_code", 1, 2)).alias("code"),
            F.coalesce(F.col("segment"), F.lit("Unmapped")).alias("name"),
        )
        .agg(F.count(F.lit(1)).alias("suppliers"), _spend().alias("spend"), _mean("confidence").alias("avg_confidence"))
        .select(F.col("code").alias("segment_code"), F.col("name").alias("segment"), "suppliers", "spend", "avg_confidence")
        .orderBy(F.col("spend").desc(), "segment_code")
    )


def list_segments(taxonomy: DataFrame) -> DataFrame:
    return (
        taxonomy.groupBy(
            F.coalesce(F.col("segment_code"), F.substring("code", 1, 2)).alias("seg"), F.coalesce(F.col("segment"), F.lit("Unknown")).alias("name")
        )
        .agg(F.count(F.lit(1)).alias("codes"))
        .select(F.col("seg").alias("segment_code"), F.col("name").alias("segment"), "codes")
        .orderBy("segment_code")
    )


def taxonomy_stats(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.agg(F.count(F.lit(1)).alias("codes"), F.count_distinct("segment_code").alias("segments"), F.max("version").alias("version"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts by action and by entity from one scan: counted per pair first, then regrouped."""
    pairs = audit.groupBy("action", "entity").agg(F.count(F.lit(1)).alias("n"))
    return (
        pairs.groupingSets([["action"], ["entity"]], "action", "entity")
        .agg(F.sum("n").alias("events"), F.grouping("action").alias("_by_entity"))
        .select(
            F.when(F.col("_by_entity") == 1, "entity").otherwise("action").alias("dimension"),
            F.coalesce("action", "entity").alias("value"),
            "events",
        )
        .orderBy("dimension", F.col("events").desc(), "value")
    )


FOLD_TEXT = ["domain", "industry", "naics", "sic", "description", "country", "parent_name", "parent_domain"]


def fold_lines(lines: DataFrame, key: str | None = None) -> DataFrame:
    """Fold repeated suppliers of a file into one row per entity key.

    Input columns: ``name``, ``amount``, ``row_no`` (file order) and any of the text columns, ``currency``
    and ``transaction_count``. Lines are first combined per exact spelling and text values: that step
    aggregates map-side on primitive buffers, so the name rules run once per distinct spelling instead
    of once per line, and one supplier owning a third of all lines shuffles only its few spellings.
    """
    text = [c for c in FOLD_TEXT + ["currency"] if c in lines.columns]
    count = F.coalesce(F.col("transaction_count"), F.lit(1)) if "transaction_count" in lines.columns else F.lit(1)
    keyed = [key] if key else []
    # a cheap test: a filter on the display name would be pushed below the grouping and run per line
    lines = lines.where(F.col("name").rlike(SPACE.replace("[", "[^", 1)))
    spelled = lines.groupBy(*keyed, "name", *text).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("amount").alias("amount"),
        F.sum(count).alias("transaction_count"),
        F.min("row_no").alias("row_no"),
    )
    spelled = spelled.withColumn("display", title_case(F.col("name")))
    entity = F.col(key) if key else entity_key(F.col("display"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("row_no")))
    return (
        spelled.withColumn("key", entity)
        .groupBy("key")
        .agg(
            F.min_by("display", "row_no").alias("name"),
            F.sum("lines").alias("line_count"),
            F.count(F.lit(1)).alias("spellings"),
            F.count_if(had_legal_suffix(F.col("display"))).alias("suffix_spellings"),
            F.sum("amount").alias("amount"),
            F.sum("transaction_count").alias("transaction_count"),
            F.min("row_no").alias("row_no"),
            *[first(c).alias(c) for c in text if c != "currency"],
            *([F.min_by("currency", "row_no").alias("currency")] if "currency" in text else []),
        )
        .withColumn("amount", F.when(F.col("line_count") > 1, F.coalesce("amount", F.lit(0))).otherwise(F.col("amount")).cast("decimal(28,2)"))
        .withColumn("duplicates", F.col("line_count") - 1)
    )


def credits_used(cache: DataFrame, provider: str, moment: datetime, days: int = 30) -> DataFrame:
    since = as_of(moment - timedelta(days=days))
    return cache.where((F.col("provider") == provider) & (F.col("created_at") >= since)).agg(
        F.coalesce(F.sum("credits_used"), F.lit(0)).alias("credits")
    )


def usage_daily(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model", F.to_date("ts").alias("usage_day")).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("failures").alias("failure_count"),
    )


def usage_budget(usage: DataFrame, models: DataFrame, day: str, params: Params) -> DataFrame:
    """Per model: limit, use and what remains that day, for people and (less the reserve) for jobs."""
    today = usage.where(F.col("usage_day") == F.lit(day).cast("date")).select("model", "request_count", "prompt_tokens", "completion_tokens", "failure_count")
    limit = F.lit(params.default_daily_limit)
    for model, value in params.daily_limits.items():
        limit = F.when(F.col("model") == model, value).otherwise(limit)
    filled = models.select("model").join(today, "model", "left").na.fill(0).withColumn("daily_limit", limit.cast("long"))
    left = F.col("daily_limit") - F.col("request_count")
    zero = F.lit(0).cast("long")
    return filled.withColumn("remaining", F.greatest(zero, left)).withColumn("job_remaining", F.greatest(zero, left - params.budget_reserve))


def usage_history(usage: DataFrame, moment: datetime, days: int = 7) -> DataFrame:
    since = (moment - timedelta(days=days - 1)).date().isoformat()
    return usage.where(F.col("usage_day") >= F.lit(since).cast("date")).orderBy("usage_day", "model")


def rollup_unanimous(rows: DataFrame) -> DataFrame:
    """One row per top-level supplier with its direct children; a code only when all classified members agree."""
    family = F.coalesce(F.col("parent_id"), F.col("id"))
    codes = rows.withColumn("family", family).groupBy("family").agg(
        F.count(F.lit(1)).alias("supplier_count"),
        _spend().alias("total_amount"),
        F.min("effective_code").alias("_low"),
        F.max("effective_code").alias("_high"),
        _mean("confidence").alias("confidence"),
        F.count_if(F.col("stale")).alias("stale_count"),
    )
    tops = rows.where(F.col("parent_id").isNull()).select(F.col("id").alias("family"), F.col("name").alias("parent_name"), "is_parent")
    return tops.join(codes, "family").select(
        F.col("family").alias("parent_id"), "parent_name", "supplier_count", (F.col("supplier_count") - 1).alias("subsidiary_count"), "total_amount",
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("code"), "confidence", "stale_count",
    )


def parent_labels(rows: DataFrame) -> DataFrame:
    """Display label of each supplier's parent, resolved within the given rows."""
    linked = rows.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    own = F.when(F.col("is_parent") | (F.col("subsidiary_count") > 0), F.concat(F.col("name"), F.lit(" (parent)"))).otherwise("Independent")
    return (
        rows.join(linked, F.col("parent_id") == F.col("_pid"), "left")
        .withColumn("parent_label", F.coalesce(F.col("_pname"), F.nullif(F.col("parent_name"), F.lit("")), own))
        .drop("_pid", "_pname")
    )


def report_catalog(reports: DataFrame, fmt: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    if fmt:
        reports = reports.where(F.col("format") == fmt)
    if start:
        reports = reports.where(F.col("created_at") >= as_of(datetime.fromisoformat(start)))
    if end:
        reports = reports.where(F.col("created_at") <= as_of(datetime.fromisoformat(end)))
    return reports


def storage_budget(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("reports"), F.max("size_bytes").alias("largest_bytes")
    )
