"""Non-destructive merge and upsert of supplier rows, enrichment results, stale marks and the lookup cache."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.domains import registrable_domain
from spendweave.functions.text import entity_key
from spendweave.functions.values import as_of
from spendweave.operators.aggregates import fold_lines
from spendweave.operators.current import conform
from spendweave.params import Params
from spendweave.schemas import SUPPLIERS
from spendweave.session import cut, ranked

TEXT = ["domain", "industry", "naics", "sic", "description", "country", "parent_name", "parent_domain"]
RECLASSIFY = ["industry", "naics", "sic", "description", "domain", "parent_name"]


def _changes(old: str, new: str, new_columns: list[str], overwrite: bool, amount_mode: str) -> dict[str, tuple[Column, Column]]:
    """Per field: (does it change, its new value). Blank input never erases; a longer text wins."""
    out: dict[str, tuple[Column, Column]] = {}
    for name in TEXT:
        if name not in new_columns:
            continue
        given = F.nullif(F.trim(F.col(f"{new}.{name}")), F.lit(""))
        have = F.coalesce(F.col(f"{old}.{name}"), F.lit(""))
        if name == "domain":
            given = registrable_domain(given)
            differs = given != have
        else:
            differs = given != have if overwrite else (given != have) & (F.length(have) < F.length(given))
        out[name] = (F.coalesce(differs, F.lit(False)), given)
    if "total_amount" in new_columns:
        given, have = F.col(f"{new}.total_amount"), F.col(f"{old}.total_amount")
        value = given if amount_mode == "replace" else F.coalesce(have, F.lit(0)) + given
        out["total_amount"] = (given.isNotNull() & ~value.eqNullSafe(have), value.cast("decimal(18,2)"))
    if "transaction_count" in new_columns:
        given = F.col(f"{new}.transaction_count")
        out["transaction_count"] = (F.coalesce(given > 0, F.lit(False)), F.coalesce(F.col(f"{old}.transaction_count"), F.lit(0)) + given)
    if "currency" in new_columns:
        given = F.nullif(F.col(f"{new}.currency"), F.lit(""))
        out["currency"] = (given.isNotNull() & ~given.eqNullSafe(F.col(f"{old}.currency")), F.substring(F.upper(given), 1, 8))
    if "enriched_at" in new_columns:
        given, have = F.col(f"{new}.enriched_at"), F.col(f"{old}.enriched_at")
        out["enriched_at"] = (given.isNotNull() & (have.isNull() | (given > have)), given)
    return out


def merge_fields(existing: DataFrame, incoming: DataFrame, params: Params, overwrite: bool = False, amount_mode: str = "replace") -> DataFrame:
    """Existing rows with incoming values merged in, plus ``changed_fields`` and ``matched``.

    ``incoming`` is unique on ``id``. A changed trigger field clears the stale mark.
    """
    e, i = existing.alias("e"), incoming.withColumn("_in", F.lit(True)).alias("i")
    changes = _changes("e", "i", incoming.columns, overwrite, amount_mode)
    changed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, (test, _) in changes.items()]))
    joined = e.join(i, F.col("e.id") == F.col("i.id"), "left")
    columns = []
    for name in existing.columns:
        if name in changes:
            test, value = changes[name]
            columns.append(F.when(test, value).otherwise(F.col(f"e.{name}")).alias(name))
        else:
            columns.append(F.col(f"e.{name}").alias(name))
    out = joined.select(*columns, changed.alias("changed_fields"), F.coalesce("i._in", F.lit(False)).alias("matched"))
    fresh = needs_reclassification(F.col("changed_fields"))
    out = out.withColumn("stale", F.when(fresh, False).otherwise(F.col("stale")))
    if "stale_reason" in existing.columns:
        out = out.withColumn("stale_reason", F.when(~fresh, F.col("stale_reason")))
    return out.withColumn("updated_at", F.when(F.size("changed_fields") > 0, as_of(params.as_of).cast(existing.schema["updated_at"].dataType)).otherwise(F.col("updated_at")))


def needs_reclassification(changed: Column) -> Column:
    return F.arrays_overlap(changed, F.array(*[F.lit(name) for name in RECLASSIFY]))


def upsert_suppliers(existing: DataFrame, folded: DataFrame, params: Params, amount_mode: str = "replace") -> dict[str, DataFrame]:
    """Match folded rows by entity key, then by exact name; merge into the match or insert.

    ``suppliers`` is the next version of the registry and ``actions`` one row per folded input:
    created, updated or unchanged, with the changed fields.
    """
    existing = conform(existing, SUPPLIERS)
    by_key = existing.groupBy(F.col("normalized_name").alias("key")).agg(F.min("id").alias("_by_key"))
    by_name = existing.groupBy("name").agg(F.min("id").alias("_by_name"))
    matched = folded.join(by_key, "key", "left").join(by_name, "name", "left").withColumn("id", F.coalesce("_by_key", "_by_name"))
    # read by the merge, the inserts and the actions: written once
    incoming, _ = cut(matched.select("id", "name", "key", "row_no", "transaction_count", F.col("amount").cast("decimal(18,2)").alias("total_amount"), *[c for c in TEXT + ["currency"] if c in folded.columns]))
    hits = incoming.where(F.col("id").isNotNull())
    # two keys can meet in one supplier (one by key, one by name): fold them as lines of that supplier
    merged_in = fold_lines(hits.withColumnRenamed("total_amount", "amount"), key="id").withColumn("id", F.col("key")).withColumnRenamed("amount", "total_amount")
    merged_in = merged_in.select("id", "transaction_count", F.col("total_amount").cast("decimal(18,2)").alias("total_amount"), *[c for c in TEXT + ["currency"] if c in folded.columns])
    updated = merge_fields(existing, merged_in, params, amount_mode=amount_mode)
    top = existing.agg(F.max("id")).first()[0] or 0
    moment = as_of(params.as_of)
    news = ranked(incoming.where(F.col("id").isNull()).drop("id"), [F.col("key").asc()], "_n").withColumn("id", F.col("_n") + top)
    born = news.select(
        "id", "name", F.col("key").alias("normalized_name"), "total_amount", "transaction_count",
        *[(registrable_domain(F.col(c)) if c in ("domain", "parent_domain") else F.col(c)).alias(c) for c in TEXT if c in news.columns],
        (F.upper(F.coalesce("currency", F.lit(params.currency))) if "currency" in news.columns else F.lit(params.currency)).alias("currency"),
        *([F.when(F.col("parent_name").isNotNull(), "enrichment").alias("parent_source")] if "parent_name" in news.columns else []),
        F.lit(False).alias("is_parent"), F.lit(False).alias("stale"), F.lit(0).alias("enrich_attempts"),
        moment.alias("created_at"), moment.alias("updated_at"),
    )
    suppliers = updated.select(*existing.columns).unionByName(conform(born, SUPPLIERS))
    action = F.when(F.size("changed_fields") > 0, "updated").otherwise("unchanged")
    actions = updated.where("matched").select("id", "name", action.alias("action"), "changed_fields").unionByName(
        news.select("id", "name", F.lit("created").alias("action"), F.array(F.lit("*")).alias("changed_fields"))
    )
    return {"suppliers": suppliers, "actions": actions}


def upsert_summary(actions: DataFrame, folded: DataFrame) -> DataFrame:
    counted = actions.agg(
        F.count_if(F.col("action") == "created").alias("created"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if((F.col("action") == "updated") & needs_reclassification(F.col("changed_fields"))).alias("needs_reclassification"),
    ).withColumn("_one", F.lit(1))
    lines = folded.agg(F.sum("line_count").alias("total_rows"), F.sum("duplicates").alias("duplicate_rows")).withColumn("_one", F.lit(1))
    # both sides are one-row totals
    return counted.join(lines, "_one").drop("_one")


def apply_enrichment(existing: DataFrame, results: DataFrame, params: Params) -> DataFrame:
    """Merge lookup results (unique on ``id``, with ``error``): failures mark the row stale, successes clear it."""
    existing = conform(existing, SUPPLIERS)
    fields = results.select("id", *[c for c in TEXT if c in results.columns])
    merged = merge_fields(existing, fields, params)
    extras = results.select(
        F.col("id").alias("_rid"),
        *[
            (F.col(c) if c in results.columns else F.lit(None).cast(t)).alias(f"_{c}")
            for c, t in (("error", "string"), ("fingerprint", "string"), ("parent_source", "string"), ("parent_confidence", "decimal(3,2)"))
        ],
    )
    out = merged.join(extras, F.col("id") == F.col("_rid"), "left")
    hit, failed = F.col("_rid").isNotNull(), F.coalesce("_error", F.lit("")) != ""
    # a given parent source replaces the stored one even when it is null
    sourced = F.lit("parent_source" in results.columns)
    more = F.array_compact(
        F.array(
            F.when(hit & sourced & ~F.col("_parent_source").eqNullSafe(F.col("parent_source")), "parent_source"),
            F.when(hit & F.col("_parent_confidence").isNotNull(), "parent_confidence"),
            F.when(hit & F.col("_fingerprint").isNotNull() & ~F.col("_fingerprint").eqNullSafe(F.col("enrich_fingerprint")), "enrich_fingerprint"),
        )
    )
    moment = as_of(params.as_of).cast("timestamp")
    return (
        out.withColumn("changed_fields", F.concat("changed_fields", more))
        .withColumn("parent_source", F.when(hit & sourced, F.col("_parent_source")).otherwise(F.col("parent_source")))
        .withColumn("parent_confidence", F.coalesce("_parent_confidence", "parent_confidence"))
        .withColumn("enrich_fingerprint", F.coalesce("_fingerprint", "enrich_fingerprint"))
        .withColumn("enrich_attempts", F.when(hit, F.coalesce("enrich_attempts", F.lit(0)) + 1).otherwise(F.col("enrich_attempts")))
        .withColumn("last_enrich_error", F.when(hit & failed, F.substring("_error", 1, 1000)).when(~hit, F.col("last_enrich_error")))
        .withColumn("enriched_at", F.when(hit & ~failed, moment).otherwise(F.col("enriched_at")))
        .withColumn("stale", F.when(hit, failed).otherwise(F.col("stale")))
        .withColumn("stale_reason", F.when(hit & failed, "enrichment_failed").when(~hit, F.col("stale_reason")))
        .withColumn("updated_at", F.when(hit, moment).otherwise(F.col("updated_at")))
        .select(*existing.columns, "changed_fields", "matched")
    )


def mark_stale(suppliers: DataFrame, reasons: DataFrame, params: Params) -> DataFrame:
    """Mark the given ``(id, reason)`` rows unless they already carry that reason. A row without a reason
    counts as different, so it is marked."""
    rows = suppliers if "stale_reason" in suppliers.columns else suppliers.withColumn("stale_reason", F.lit(None).cast("string"))
    joined = rows.join(reasons.select("id", F.col("reason").alias("_reason")), "id", "left")
    hit = F.col("_reason").isNotNull() & ~F.col("_reason").eqNullSafe(F.col("stale_reason"))
    stamp = as_of(params.as_of).cast(suppliers.schema["updated_at"].dataType)
    return (
        joined.withColumn("newly_marked", hit)
        .withColumn("stale", F.when(F.col("newly_marked"), True).otherwise(F.col("stale")))
        .withColumn("stale_reason", F.when(F.col("newly_marked"), F.col("_reason")).otherwise(F.col("stale_reason")))
        .withColumn("updated_at", F.when(F.col("newly_marked"), stamp).otherwise(F.col("updated_at")))
        .drop("_reason")
    )


def clear_stale(suppliers: DataFrame, ids: DataFrame, params: Params) -> DataFrame:
    hit = F.col("_hit").isNotNull()
    stamp = as_of(params.as_of).cast(suppliers.schema["updated_at"].dataType)
    joined = suppliers.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return (
        joined.withColumn("stale", F.when(hit, False).otherwise(F.col("stale")))
        .withColumn("stale_reason", F.when(~hit, F.col("stale_reason")))
        .withColumn("updated_at", F.when(hit, stamp).otherwise(F.col("updated_at")))
        .select(*suppliers.columns)
    )


# ---- work queues -------------------------------------------------------------------------------------


def needs_enrichment(suppliers: DataFrame, params: Params, older_than: int | None = None, only_stale: bool = False, limit: int | None = None) -> DataFrame:
    """Never enriched or too old, oldest first and then by spend (never enriched rows come last)."""
    cutoff = as_of(params.as_of - timedelta(days=params.stale_days if older_than is None else older_than))
    never, old = F.col("enriched_at").isNull(), F.col("enriched_at") < cutoff
    test = (F.col("stale") | never | old) if only_stale else (never | old) if older_than is not None else never
    rows = suppliers.where(test).orderBy(F.col("enriched_at").asc_nulls_last(), F.col("total_amount").desc_nulls_first(), F.col("id"))
    return rows.limit(limit) if limit else rows


def stale_candidates(suppliers: DataFrame, params: Params, limit: int | None = None) -> DataFrame:
    """Rows to refresh with the first reason that applies, largest spend first."""
    cutoff = as_of(params.as_of - timedelta(days=params.stale_days))
    reason = (
        F.when(F.col("stale"), "flagged_stale")
        .when(F.col("enriched_at").isNull(), "never_enriched")
        .when(F.col("enriched_at") <= cutoff, "enrichment_old")
        .when(F.coalesce("last_enrich_error", F.lit("")) != "", "previous_failure")
    )
    rows = suppliers.withColumn("reason", reason).where(F.col("reason").isNotNull())
    rows = rows.orderBy(F.coalesce("total_amount", F.lit(0)).desc(), F.lower("name"), "name", "id")
    return rows.limit(limit) if limit else rows


# ---- lookup cache ------------------------------------------------------------------------------------


def cache_key(provider: str, name: Column) -> Column:
    return F.concat(F.lit(provider + ":"), entity_key(name))


def cache_split(requests: DataFrame, cache: DataFrame, provider: str, params: Params) -> tuple[DataFrame, DataFrame]:
    """Requests answered by an unexpired cache row, and the rest."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of(params.as_of)))
    asked = requests.withColumn("cache_key", cache_key(provider, F.col("name")))
    found = live.select("cache_key", "payload", F.col("provider").alias("cached_provider"))
    return asked.join(found, "cache_key"), asked.join(live.select("cache_key"), "cache_key", "left_anti")


def cache_upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """Latest write per key wins; the first creation time and the hit counter of an existing row stay."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(writes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    keep = [c for c in cache.columns if c not in ("cache_key", "created_at", "hit_count")]
    return both.groupBy("cache_key").agg(
        F.max_by(F.struct(*keep), F.struct("_new", "created_at")).alias("w"),
        F.min_by(F.coalesce("hit_count", F.lit(0)), F.struct("_new", "created_at")).alias("hit_count"),
        F.min_by("created_at", F.struct("_new", "created_at")).alias("created_at"),
    ).select("cache_key", *[f"w.{c}" for c in keep], "hit_count", "created_at")


def count_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    counted = hits.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_hits"))
    return cache.join(counted, "cache_key", "left").withColumn("hit_count", (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).cast("int")).drop("_hits")
