"""Scheduled refresh: stale suppliers enriched, links resolved, codes assigned, one summary row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.operators import aggregates, merge
from spendweave.operators.audit import audit_rows
from spendweave.operators.current import supplier_list
from spendweave.operators.families import resolve_links
from spendweave.params import Params
from spendweave.plans.classify import classify_run
from spendweave.plans.enrich import enrich_run
from spendweave.session import cut


def refresh_run(
    suppliers: DataFrame,
    history: DataFrame,
    taxonomy: DataFrame,
    cache: DataFrame,
    usage: DataFrame,
    params: Params,
    score: Callable,
    lookup: Callable | None = None,
    detect: Callable | None = None,
    mode: str = "full",
    batch_size: int = 25,
    max_batches: int = 12,
    usage_day: str | None = None,
) -> dict[str, DataFrame]:
    """Modes ``enrich``, ``classify`` and ``full``; ``summary`` is one row, and ``audit`` holds the events of all steps and one of the run.

    The work set is capped by the batch limits and, for classification, by what is left of the accurate tier's daily budget.
    Suppliers that stay without a parent go to ``detect``, as in ``enrich_run``. ``stopped`` tells ``llm_budget`` when the budget
    kept codes from being assigned, ``no_work`` when nothing was looked up or assigned though something was due, or nothing was
    due in a run of one mode; else ``completed``.
    """
    counts = {"candidates": 0, "enriched": 0, "enrichment_failed": 0, "stale_marked": 0, "batches": 0, "links": 0, "classified": 0, "inherited": 0, "low_confidence": 0}
    stopped, registry, events = "no_work", suppliers, []
    if mode in ("enrich", "full"):
        todo, seen = cut(merge.stale_candidates(registry, params, batch_size * max_batches), rows=F.count(F.lit(1)))
        counts["candidates"], counts["batches"] = seen["rows"], -(-seen["rows"] // batch_size)
        if seen["rows"]:
            out = enrich_run(registry, cache, params, lookup=lookup, detect=detect, targets=todo.drop("reason"))
            for row in out["summary"].collect():  # at most one row per status
                counts["enrichment_failed" if row.status == "failed" else "enriched"] += row.suppliers
            counts["stale_marked"] = counts["enrichment_failed"]
            registry, cache = cut(out["suppliers"])[0], out["cache"]
            events.append(cut(out["audit"])[0])
        elif mode == "full":
            stopped = "completed"
        linked = resolve_links(registry, params)
        registry, _ = cut(linked["suppliers"])
        done = linked["links"].where("status = 'linked'")
        counts["links"] = done.count()
        events.append(audit_rows(done, "supplier", "supplier_id", "parent_linked", ["parent_id", "source", "parent_created"], "job", params))
    if mode in ("classify", "full"):
        day = usage_day or params.as_of.date().isoformat()
        models = usage.sparkSession.createDataFrame([(params.accurate_model,)], "model string")
        budget = aggregates.usage_budget(usage, models, day, params).first().job_remaining
        if budget <= 0:
            stopped = "llm_budget"
        else:
            out = classify_run(registry, history, taxonomy, params, score, limit=batch_size, max_batches=min(max_batches, max(1, budget // max(1, batch_size))))
            history, _ = cut(out["history"])
            events.append(cut(out["audit"])[0])
            rows = out["summary"].collect()  # at most one row per status
            for row in rows:
                if row.status in counts:
                    counts[row.status] += row.suppliers
                counts["low_confidence"] += row.low_confidence
            if rows and not counts["candidates"]:
                stopped = "completed"
    if stopped == "no_work" and (counts["enriched"] or counts["classified"]):
        stopped = "completed"
    stats = aggregates.supplier_stats(supplier_list(registry, history, taxonomy), params)
    summary, _ = cut(stats.select(F.lit(mode).alias("mode"), F.lit(stopped).alias("stopped"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "parents", "total_suppliers"))
    audit = audit_rows(summary, "sync", None, "synced", summary.columns, "job", params)
    for more in events:
        audit = audit.unionByName(more)
    return {"suppliers": registry, "history": history, "cache": cache, "summary": summary, "audit": audit}
