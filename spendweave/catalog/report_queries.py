"""Summaries, segment shares, tallies, usage, folds, report sections and the report catalogue."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.operators import aggregates as a
from spendweave.operators import quality, timing
from spendweave.operators.families import clusters, family_members
from spendweave.operators.filters import SupplierFilter
from spendweave.params import Params
from spendweave.sources import reports as r

P = Params()
EVENTS_END = datetime(2024, 2, 1)

COUNTS = """count(*) AS total_suppliers, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_spend, count(classification_id) AS classified, count(*) - count(classification_id) AS unclassified,
count(CASE WHEN confidence < 0.7 AND NOT reviewed THEN 1 END) AS low_confidence, count(CASE WHEN reviewed THEN 1 END) AS reviewed, count(CASE WHEN inherited_from_parent THEN 1 END) AS inherited,
count(CASE WHEN stale OR enriched_at IS NULL THEN 1 END) AS stale, count(CASE WHEN is_parent THEN 1 END) AS parents, count(parent_id) AS subsidiaries"""
PCT = "count(classification_id)::DOUBLE / count(*) * 100.0::DOUBLE"
LOWPCT = "count(CASE WHEN confidence < 0.7 AND NOT reviewed THEN 1 END)::DOUBLE / count(*) * 100.0::DOUBLE"
MEAN = "sum(confidence)::DOUBLE / count(confidence)"


@query(
    "report_summary",
    with_views(f"SELECT {COUNTS}, {q.round_to(PCT, 1)} AS percent_classified, {q.round_to(LOWPCT, 1)} AS percent_low_confidence, {q.round_to(MEAN, 3)} AS average_confidence FROM v_list"),
)
def report_summary(t: Tables) -> DataFrame:
    return a.report_summary(t.rows, P)


@query(
    "supplier_stats",
    with_views(f"SELECT {COUNTS}, count(enriched_at) AS enriched, {PCT} AS percent_classified, {LOWPCT} AS percent_low_confidence, {MEAN} AS mean_confidence FROM v_list"),
)
def supplier_stats(t: Tables) -> DataFrame:
    return a.supplier_stats(t.rows, P)


SEGMENTS = f"""parts AS (SELECT coalesce(substr(effective_code, 1, 2), '--') AS segment_code,
  arg_min(coalesce(segment, CASE WHEN effective_code IS NULL THEN 'Not classified' ELSE 'Unmapped segment' END), (lower(name), name, id)) AS segment,
  count(*) AS suppliers, coalesce(sum(total_amount), 0)::DOUBLE AS spend, {MEAN} AS mean FROM v_list GROUP BY 1),
whole AS (SELECT sum(total_amount)::DOUBLE AS total FROM v_list),
segments AS (SELECT segment_code, segment, suppliers, spend, CASE WHEN total <> 0 THEN {q.round_to('spend / total * 100.0::DOUBLE', 1)} ELSE 0 END AS spend_share, {q.round_to('mean', 3)} AS avg_confidence FROM parts, whole)"""


@query("segment_breakdown", with_views("SELECT * FROM segments", SEGMENTS))
def segment_breakdown(t: Tables) -> DataFrame:
    return a.segment_breakdown(t.rows)


@query(
    "segment_breakdown_sql",
    with_views(f"""SELECT coalesce(segment_code, substr(effective_code, 1, 2)) AS segment_code, coalesce(segment, 'Unmapped') AS segment, count(*) AS suppliers,
coalesce(sum(total_amount), 0)::DOUBLE AS spend, {MEAN} AS avg_confidence FROM v_list WHERE classification_id IS NOT NULL AND confidence >= 0.2 GROUP BY 1, 2"""),
)
def segment_breakdown_sql(t: Tables) -> DataFrame:
    return a.segment_breakdown_classified(t.rows, 0.2)


@query("child_counts", with_views("SELECT parent_id, count(*) AS child_count FROM v_suppliers WHERE parent_id IS NOT NULL GROUP BY 1"))
def child_counts(t: Tables) -> DataFrame:
    from spendweave.operators.current import child_counts as counts

    return counts(t.suppliers)


@query("list_segments", with_views("SELECT segment_code, segment, count(*) AS codes FROM v_taxonomy GROUP BY 1, 2"))
def list_segments(t: Tables) -> DataFrame:
    return a.list_segments(t.taxonomy)


@query("taxonomy_stats", with_views("SELECT count(*) AS codes, count(DISTINCT segment_code) AS segments, 'v1' AS version FROM v_taxonomy"))
def taxonomy_stats(t: Tables) -> DataFrame:
    return a.taxonomy_stats(t.taxonomy)


@query(
    "audit_summary",
    with_views("SELECT 'action' AS dimension, action AS value, count(*) AS events FROM v_audit GROUP BY 2 UNION ALL SELECT 'entity', entity, count(*) FROM v_audit GROUP BY 2"),
)
def audit_summary(t: Tables) -> DataFrame:
    return a.audit_summary(t.audit)


LINES = f"""lines AS (SELECT raw_name AS name, amount, CAST(NULL AS VARCHAR) AS industry, CASE WHEN l_linenumber = 3 THEN concat('https://www.s', CAST(supplier_no - 1 AS VARCHAR), '.example.com/a') END AS domain,
    l_orderkey * 10 + l_linenumber AS row_no FROM v_tx
  UNION ALL SELECT c_name, CAST(o_totalprice AS DECIMAL(18,2)), lower(c_mktsegment), CAST(NULL AS VARCHAR), o_orderkey + 1000000000000000 FROM orders JOIN customer ON o_custkey = c_custkey),
spelled AS (SELECT *, {q.title('name')} AS display FROM lines),
folded AS (SELECT {q.key('display')} AS entity, arg_min(display, row_no) AS name, count(*) AS line_count, sum(amount) AS amount, count(*) AS transaction_count, count(*) - 1 AS duplicates,
  arg_min(industry, row_no) FILTER (industry IS NOT NULL) AS industry, arg_min(domain, row_no) FILTER (domain IS NOT NULL) AS domain FROM spelled GROUP BY 1)"""


@query("fold_suppliers", with_views("SELECT entity, name, line_count, amount::DOUBLE AS amount, transaction_count, duplicates, industry, domain FROM folded", LINES))
def fold_suppliers(t: Tables) -> DataFrame:
    return a.fold_lines(t.lines).select(F.col("key").alias("entity"), "name", "line_count", "amount", "transaction_count", "duplicates", "industry", "domain")


@query("credits_30d", with_views("SELECT CAST(coalesce(sum(credits_used), 0) AS BIGINT) AS credits FROM v_cache WHERE provider = 'generic' AND created_at >= TIMESTAMP '1995-01-05 00:00:00'"))
def credits_30d(t: Tables) -> DataFrame:
    return a.credits_used(t.cache, "generic", datetime(1995, 2, 4))


USAGE = """usage AS (SELECT model, CAST(ts AS DATE) AS usage_day, count(*) AS request_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(failures) AS BIGINT) AS failure_count FROM v_calls GROUP BY 1, 2)"""


@query("usage_daily", with_views("SELECT * FROM usage", USAGE))
def usage_daily(t: Tables) -> DataFrame:
    return a.usage_daily(t.calls)


@query(
    "usage_budget",
    with_views("""SELECT m.model, coalesce(request_count, 0) AS request_count, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(failure_count, 0) AS failure_count,
CASE m.model WHEN 'click' THEN 120 ELSE 60 END AS daily_limit, greatest(0, CASE m.model WHEN 'click' THEN 120 ELSE 60 END - coalesce(request_count, 0)) AS remaining,
greatest(0, CASE m.model WHEN 'click' THEN 120 ELSE 60 END - coalesce(request_count, 0) - 50) AS job_remaining
FROM (SELECT DISTINCT model FROM v_calls) m LEFT JOIN (SELECT * FROM usage WHERE usage_day = DATE '2024-01-07') u ON u.model = m.model""", USAGE),
)
def usage_budget(t: Tables) -> DataFrame:
    limits = Params(daily_limits={"click": 120}, default_daily_limit=60)
    return a.usage_budget(a.usage_daily(t.calls), t.calls.select("model").distinct(), "2024-01-07", limits)


@query("usage_history", with_views("SELECT * FROM usage WHERE usage_day >= DATE '2024-01-26'", USAGE))
def usage_history(t: Tables) -> DataFrame:
    return a.usage_history(a.usage_daily(t.calls), EVENTS_END, 7)


@query(
    "rollup_unanimous",
    with_views(f"""SELECT s.id AS parent_id, s.name AS parent_name, f.supplier_count, f.supplier_count - 1 AS subsidiary_count, f.total_amount, CASE WHEN f.codes = 1 THEN f.code END AS code, f.confidence, f.stale_count
FROM v_list s JOIN (SELECT coalesce(parent_id, id) AS family, count(*) AS supplier_count, sum(total_amount)::DOUBLE AS total_amount, count(DISTINCT effective_code) AS codes, min(effective_code) AS code,
  {MEAN} AS confidence, count(CASE WHEN stale THEN 1 END) AS stale_count FROM v_list GROUP BY 1) f ON f.family = s.id WHERE s.parent_id IS NULL"""),
)
def rollup_unanimous(t: Tables) -> DataFrame:
    return a.rollup_unanimous(t.rows)


@query(
    "table_profile",
    with_views("""SELECT 'suppliers' AS measure, count(*) AS n FROM v_suppliers UNION ALL SELECT 'classifications', count(*) FROM v_classifications UNION ALL SELECT 'taxonomy', count(*) FROM v_taxonomy
UNION ALL SELECT 'audit_log', count(*) FROM v_audit UNION ALL SELECT 'parents', count(*) FROM v_suppliers WHERE is_parent UNION ALL SELECT 'classified_suppliers', count(DISTINCT supplier_id) FROM v_classifications WHERE NOT superseded"""),
)
def table_profile(t: Tables) -> DataFrame:
    return quality.table_profile(t.suppliers, t.classifications, t.taxonomy, t.audit)


@query(
    "report_catalog",
    with_views("""SELECT id, name, size_bytes, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM v_reports WHERE format = 'pdf') AS total_bytes, (SELECT count(*) FROM v_reports WHERE format = 'pdf') AS reports,
(SELECT max(size_bytes) FROM v_reports WHERE format = 'pdf') AS largest_bytes FROM v_reports WHERE format = 'pdf' ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25"""),
)
def report_catalog(t: Tables) -> DataFrame:
    wanted = a.report_catalog(t.reports, fmt="pdf")
    one = a.storage_budget(wanted).withColumn("_one", F.lit(1))
    return r.list_reports(wanted, 2, 25).select("id", "name", "size_bytes", F.lit(1).alias("_one")).join(one, "_one").drop("_one")


@query(
    "report_retention",
    with_views("""SELECT format, count(*) AS deleted, CAST(sum(size_bytes) AS BIGINT) AS freed_bytes FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY created_at DESC, id DESC) AS n FROM v_reports) x WHERE n > 30 GROUP BY 1"""),
)
def report_retention(t: Tables) -> DataFrame:
    return r.report_retention(t.reports, 30)[1]


@query(
    "supplier_export",
    with_views("""SELECT s.id AS supplier_id, s.name AS supplier_name, coalesce(s.domain, '') AS domain, s.industry, s.naics, s.country, coalesce(s.effective_code, '') AS unspsc_code, coalesce(s.segment, '') AS segment,
coalesce(s.family, '') AS family, coalesce(s.class_name, '') AS class, coalesce(s.commodity, '') AS commodity, s.confidence::DOUBLE AS confidence,
CASE WHEN s.inherited_from_parent THEN 'true' ELSE 'false' END AS inherited_from_parent, CASE WHEN s.reviewed THEN 'true' ELSE 'false' END AS reviewed, s.parent_id,
coalesce(p.name, nullif(s.parent_name, ''), CASE WHEN s.is_parent OR s.subsidiary_count > 0 THEN concat(s.name, ' (parent)') ELSE '' END) AS parent_name,
CASE WHEN s.is_parent THEN 'true' ELSE 'false' END AS is_parent, s.subsidiary_count, coalesce(s.parent_source, '') AS parent_source, s.total_amount::DOUBLE AS total_amount, s.currency, s.transaction_count,
coalesce(strftime(s.enriched_at, '%Y-%m-%dT%H:%M:%S.%gZ'), '') AS enriched_at, CASE WHEN s.stale THEN 'true' ELSE 'false' END AS stale,
strftime(s.created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, strftime(s.updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM v_list s LEFT JOIN v_list p ON p.id = s.parent_id"""),
)
def supplier_export(t: Tables) -> DataFrame:
    return r.supplier_export(a.parent_labels(t.rows), verbose=True).drop("sic", "llm_model", "reasoning", "stale_reason")


@query("report_metadata", with_views(f"""SELECT 'Spend report' AS report, '2001-11-15T00:00:00Z' AS generated_at, 'job' AS generated_by, 'v26.0801' AS taxonomy_version, 'parent' AS rollup,
'state = low; rows per = parent' AS filters, count(*) AS total_suppliers, sum(total_amount)::DOUBLE AS total_spend, count(classification_id) AS classified, {q.round_to(PCT, 1)} AS percent_classified,
count(CASE WHEN confidence < 0.7 AND NOT reviewed THEN 1 END) AS low_confidence, {q.round_to(LOWPCT, 1)} AS percent_low_confidence FROM v_list WHERE confidence < 0.7 AND NOT reviewed"""))
def report_metadata(t: Tables) -> DataFrame:
    from spendweave.operators.filters import supplier_filter

    wanted = SupplierFilter(state="low", rollup="parent")
    rows = supplier_filter(t.rows, wanted, P)
    return r.report_metadata(a.report_summary(rows, P), "Spend report", P.as_of, "job", P.taxonomy_version, wanted.rollup, wanted.describe())


@query(
    "rate_window",
    """WITH seen AS (SELECT event_id, event_type AS model, epoch_us(ts) AS tick FROM events),
counted AS (SELECT event_id, model, tick, count(*) OVER w AS in_window, min(tick) OVER w AS oldest FROM seen WINDOW w AS (PARTITION BY model ORDER BY tick RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW))
SELECT event_id, model, in_window, in_window >= 3 AS at_limit, CASE WHEN in_window >= 3 THEN CAST(greatest(0, (oldest + 600000000 - tick) // 1000) AS BIGINT) ELSE 0 END AS next_slot_ms FROM counted""",
)
def rate_window(t: Tables) -> DataFrame:
    calls = t.base("events").select("event_id", F.col("event_type").alias("model"), "ts")
    return timing.rate_window(calls, per_minute=3, span=600).drop("ts")


@query(
    "missed_slots",
    """WITH recent AS (SELECT user_id AS schedule, max(epoch_us(ts) // 1000000) AS tick FROM events GROUP BY 1),
bounds AS (SELECT schedule, tick, (greatest(tick, epoch_us(TIMESTAMP '2024-01-23 00:00:00') // 1000000) // 86400 + 1) * 86400 AS begins FROM recent),
slots AS (SELECT schedule, tick, unnest(range(begins, epoch_us(TIMESTAMP '2024-01-30 00:00:00') // 1000000 + 1, 86400)) AS slot FROM bounds)
SELECT schedule, make_timestamp(slot * 1000000) AS slot, make_timestamp(tick * 1000000) AS last_run FROM slots""",
)
def missed_slots(t: Tables) -> DataFrame:
    runs = t.base("events").select(F.col("user_id").alias("schedule"), F.col("ts").alias("ran_at"))
    return timing.missed_slots(runs, timedelta(days=1), datetime(2024, 1, 30))


@query(
    "dq_taxonomy",
    with_views("SELECT 'size' AS check_name, count(*) > 100000 AS ok, count(*) AS measured FROM v_taxonomy UNION ALL SELECT 'segments', count(DISTINCT segment_code) > 0, count(DISTINCT segment_code) FROM v_taxonomy UNION ALL SELECT 'known_code', count(*) = 1, count(*) FROM v_taxonomy WHERE code = '43211507'"),
)
def dq_taxonomy(t: Tables) -> DataFrame:
    return quality.taxonomy_checks(t.taxonomy, P)


@query(
    "dq_unique",
    with_views("""SELECT 'suppliers.name' AS check_name, count(*) = 0 AS ok, count(*) AS bad_rows FROM (SELECT name FROM v_suppliers GROUP BY 1 HAVING count(*) > 1) a
UNION ALL SELECT 'suppliers.normalized_name', count(*) = 0, count(*) FROM (SELECT normalized_name FROM v_suppliers GROUP BY 1 HAVING count(*) > 1) b
UNION ALL SELECT 'enrichment_cache.cache_key', count(*) = 0, count(*) FROM (SELECT cache_key FROM v_cache GROUP BY 1 HAVING count(*) > 1) c
UNION ALL SELECT 'calls.model_day', count(*) = 0, count(*) FROM (SELECT model, CAST(ts AS DATE) FROM v_calls GROUP BY 1, 2 HAVING count(*) > 1) d"""),
)
def dq_unique(t: Tables) -> DataFrame:
    return quality.unique_checks(
        {
            "suppliers.name": (t.suppliers, ["name"]), "suppliers.normalized_name": (t.suppliers, ["normalized_name"]),
            "enrichment_cache.cache_key": (t.cache, ["cache_key"]), "calls.model_day": (t.calls.withColumn("day", F.to_date("ts")), ["model", "day"]),
        }
    )


@query(
    "dq_refs",
    with_views("""SELECT 'suppliers.parent_id' AS check_name, count(*) = 0 AS ok, count(*) AS bad_rows FROM v_suppliers WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM v_suppliers)
UNION ALL SELECT 'classifications.supplier_id', count(*) = 0, count(*) FROM v_classifications WHERE supplier_id NOT IN (SELECT id FROM v_suppliers)
UNION ALL SELECT 'classifications.code', count(*) = 0, count(*) FROM v_classifications WHERE coalesce(corrected_code, CASE WHEN id % 5 = 0 THEN concat('X', unspsc_code) ELSE unspsc_code END) NOT IN (SELECT code FROM v_taxonomy)"""),
)
def dq_refs(t: Tables) -> DataFrame:
    broken = t.classifications.withColumn("unspsc_code", F.expr("CASE WHEN id % 5 = 0 THEN concat('X', unspsc_code) ELSE unspsc_code END"))
    return quality.reference_checks(t.suppliers, broken, t.taxonomy)


@query(
    "dq_consistency",
    with_views("""SELECT 'unique_ids' AS check_name, count(*) = 0 AS ok, count(*) AS bad_rows FROM (SELECT id FROM v_list GROUP BY 1 HAVING count(*) > 1) a
UNION ALL SELECT 'effective_code', count(*) = 0, count(*) FROM v_list WHERE effective_code IS DISTINCT FROM coalesce(corrected_code, unspsc_code)
UNION ALL SELECT 'child_counts', count(*) = 0, count(*) FROM v_list l WHERE subsidiary_count <> (SELECT count(*) FROM v_list c WHERE c.parent_id = l.id)
UNION ALL SELECT 'parent_flags', count(*) = 0, count(*) FROM v_list WHERE subsidiary_count > 0 AND NOT is_parent"""),
)
def dq_consistency(t: Tables) -> DataFrame:
    return quality.consistency_checks(t.rows)
