"""Enrichment: cached or looked-up payloads merged into suppliers, then parent detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.functions.domains import single_word_domain
from spendweave.functions.payloads import FIELDS, normalize_provider
from spendweave.functions.text import enrichment_fingerprint, parent_in_name
from spendweave.functions.values import as_of
from spendweave.operators import batches as b
from spendweave.operators import merge, responses
from spendweave.operators.audit import audit_rows
from spendweave.params import Params
from spendweave.session import cut, spread_join

FOUND_PARENT_CONFIDENCE = "0.80"


def _look_up(misses: DataFrame, lookup: Callable, partitions: int | None) -> DataFrame:
    """Call ``lookup(pdf) -> pdf`` with id, name, domain -> id, payload, error, credits: once per cache key, for the supplier
    with the smallest id; the answer goes to every supplier of that key. A retried task asks again; its output replaces the first."""
    asked = misses.groupBy("cache_key").agg(F.min_by(F.struct("id", "name", "domain"), "id").alias("first")).select("first.*")
    asked = asked.repartition(partitions, "id") if partitions else asked

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield lookup(frame)[["id", "payload", "error", "credits"]]

    answers, _ = cut(asked.mapInPandas(run, "id bigint, payload string, error string, credits int").join(misses.select("id", "cache_key"), "id"))
    told = answers.select("cache_key", F.col("id").alias("asked_id"), "payload", "error", "credits")
    return spread_join(misses.select("id", "cache_key"), told, "cache_key", spread_by="id").drop("cache_key")


def _heuristic(rows: DataFrame) -> DataFrame:
    """Offline fields: a domain from a one-word name and a parent from the name; stored values win."""
    own = {"domain": F.coalesce("domain", single_word_domain(F.col("name"))), "parent_name": parent_in_name(F.col("name"))}
    kept = ("industry", "naics", "sic", "description", "country")
    columns = [own[f] if f in own else F.col(f) if f in kept and f in rows.columns else F.lit(None).cast("string") for f in FIELDS]
    return rows.select("id", *[c.alias(f) for c, f in zip(columns, FIELDS)])


def enrich_run(
    suppliers: DataFrame,
    cache: DataFrame,
    params: Params,
    provider: str = "generic",
    lookup: Callable | None = None,
    detect: Callable | None = None,
    targets: DataFrame | None = None,
    limit: int | None = None,
    force: bool = False,
    partitions: int | None = None,
) -> dict[str, DataFrame]:
    """One pass over the target suppliers.

    Unexpired cache rows answer first; the rest go to ``lookup``, once per cache key (or the offline rules without one); a
    failed lookup falls back to the offline rules and records its error. Suppliers left without a parent go
    to ``detect`` in batches. Returns the new registry and cache, an item per target, and counts by status.
    """
    wanted = targets if targets is not None else merge.needs_enrichment(suppliers, params, older_than=0 if force else None, limit=limit)
    wanted, _ = cut(wanted)
    hits, misses = merge.cache_split(wanted, cache, provider, params)
    if force:
        hits, misses = hits.limit(0), wanted.withColumn("cache_key", merge.cache_key(provider, F.col("name")))
    if lookup is None:
        answers = misses.select("id", F.col("id").alias("asked_id"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("credits"))
    else:
        answers = _look_up(misses, lookup, partitions)
    answers, _ = cut(answers)
    good = answers.where(F.col("error").isNull() & F.col("payload").isNotNull())
    rest = answers.where(F.col("error").isNotNull() | F.col("payload").isNull())
    restored = normalize_provider(hits.select("id", "payload"), provider).withColumn("status", F.lit("cached"))
    looked = normalize_provider(good.select("id", "payload"), provider).withColumn("status", F.lit("enriched"))
    offline = _heuristic(wanted.join(rest.select("id"), "id", "left_semi")).join(rest.select("id", "error"), "id")
    missing = F.lit(None if lookup is None else "no data").cast("string")
    offline = offline.withColumn("error", F.coalesce("error", missing)).withColumn("status", F.when(F.col("error").isNull(), "enriched").otherwise("failed"))
    shaped = [df.select("id", *FIELDS, "status", (F.col("error") if "error" in df.columns else F.lit(None).cast("string")).alias("error")) for df in (restored, looked, offline)]
    results = shaped[0].unionByName(shaped[1]).unionByName(shaped[2])
    c = F.col
    results = (
        results.withColumn("fingerprint", enrichment_fingerprint(c("domain"), c("industry"), c("naics"), c("sic"), c("parent_name"), c("description")))
        .withColumn("parent_source", F.when(c("parent_name").isNotNull(), "enrichment"))
        .withColumn("parent_confidence", F.when(c("parent_name").isNotNull(), F.lit(FOUND_PARENT_CONFIDENCE).cast("decimal(3,2)")))
    )
    results, _ = cut(results)
    updated = merge.apply_enrichment(suppliers, results, params)
    changed = updated.where("matched").select("id", "changed_fields")
    moment = as_of(params.as_of)
    writes = misses.select("id", "cache_key", c("name").alias("supplier_name")).join(good.where("id = asked_id"), "id").select(
        "cache_key", "supplier_name", F.lit(provider).alias("provider"), "payload", c("credits").alias("credits_used"), F.lit(0).alias("hit_count"),
        moment.alias("created_at"), (moment + F.expr(f"INTERVAL {params.cache_ttl_days} DAYS")).alias("expires_at"),
    )
    new_cache = merge.cache_upsert(merge.count_hits(cache, hits), writes)
    items = results.select("id", "status", "error", "parent_name").join(changed, "id").withColumn("needs_reclassification", F.arrays_overlap("changed_fields", F.array(*[F.lit(f) for f in ("industry", "naics", "sic")])))
    registry = updated.drop("changed_fields", "matched")
    if detect is not None:
        registry = detect_parents(registry, items.where(c("parent_name").isNull()).select("id"), params, detect)
    summary = items.groupBy("status").agg(F.count(F.lit(1)).alias("suppliers"), F.count_if("needs_reclassification").alias("needs_reclassification"))
    action = F.when(c("status") == "failed", "enrich_failed").otherwise("enriched")
    return {"suppliers": registry, "cache": new_cache, "items": items, "summary": summary, "audit": audit_rows(items, "supplier", "id", action, ["status", "changed_fields", "error"], "job", params)}


def detect_parents(suppliers: DataFrame, ids: DataFrame, params: Params, detect: Callable) -> DataFrame:
    """Ask ``detect`` (batched like a scorer) for parents; accepted answers become stored parent names."""
    work = suppliers.join(ids, "id", "left_semi").withColumn("model", F.lit(params.accurate_model))
    batches, _ = cut(b.request_batches(work.select("id", "name", "domain", "industry", "model"), params.batch_size))
    answers, _ = cut(b.score_batches(b.parent_prompts(batches, params.batch_size), detect))
    items = responses.answer_items(responses.parse_json(responses.json_text(answers)), responses.PARENT_WRAPPERS, ["parent_name", "is_subsidiary"])
    slots = batches.withColumn("item_no", (F.pmod(F.col("position") - 1, F.lit(params.batch_size)) + 1).cast("int")).select("model", "batch_no", "item_no", "id", F.col("name").alias("asked_name"))
    placed = responses.parent_items(items.join(slots, ["model", "batch_no", "item_no"]), supplier_name="asked_name")
    found = placed.where(F.col("parent_name").isNotNull()).select(
        "id", "parent_name", "parent_domain", F.lit("llm").alias("parent_source"), F.col("confidence").cast("decimal(3,2)").alias("parent_confidence")
    )
    found, _ = cut(found)
    return merge.apply_enrichment(suppliers, found, params).drop("changed_fields", "matched")

