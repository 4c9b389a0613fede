"""Merges, upserts, history writes, corrections, propagation and the cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.family_queries import MEMBERS, PLAN, ROOTS, SCORED
from spendweave.catalog.registry import CHECKS, query
from spendweave.catalog.report_queries import LINES
from spendweave.catalog.views import Tables, with_views
from spendweave.operators import families as fam
from spendweave.operators import history as h
from spendweave.operators import merge
from spendweave.operators.audit import audit_rows
from spendweave.params import Params
from spendweave.plans.resolve import resolve_entities
from spendweave.session import shared_dir
from spendweave.sources import history as stored

P = Params()
AS_OF = "TIMESTAMP '2001-11-15 00:00:00'"

# Incoming values for a merge, drawn from the registry itself by id.
INCOMING = """SELECT id, CASE id % 4 WHEN 0 THEN concat('https://www.', lower(country), '.com/x') WHEN 1 THEN 'not a domain' WHEN 2 THEN '  ' ELSE domain END AS domain,
  CASE id % 3 WHEN 0 THEN concat(industry, ' and more') WHEN 1 THEN 'X' ELSE NULL END AS industry, CASE WHEN id % 5 = 1 THEN concat(' sells things in ', country, ' ') ELSE '' END AS description,
  CASE WHEN id % 2 = 0 THEN total_amount ELSE CAST(id AS DECIMAL(18,2)) END AS total_amount, id % 3 AS transaction_count, CASE WHEN id % 6 = 0 THEN 'eur' ELSE 'USD' END AS currency,
  CASE WHEN id % 2 = 0 THEN created_at ELSE updated_at END AS enriched_at FROM v_suppliers"""


def _merge_sql() -> str:
    dom = q.domain("i.domain")
    text = lambda f: f"(i.{f} IS NOT NULL AND trim(i.{f}) <> '' AND trim(i.{f}) <> coalesce(s.{f}, '') AND length(coalesce(s.{f}, '')) < length(trim(i.{f})))"
    tests = {
        "domain": f"coalesce({dom} <> coalesce(s.domain, ''), FALSE)",
        "industry": text("industry"),
        "description": text("description"),
        "total_amount": "(i.total_amount IS NOT NULL AND i.total_amount IS DISTINCT FROM s.total_amount)",
        "transaction_count": "coalesce(i.transaction_count > 0, FALSE)",
        "currency": "(i.currency IS NOT NULL AND i.currency IS DISTINCT FROM s.currency)",
        "enriched_at": "(i.enriched_at IS NOT NULL AND (s.enriched_at IS NULL OR i.enriched_at > s.enriched_at))",
    }
    values = {
        "domain": dom, "industry": "trim(i.industry)", "description": "trim(i.description)", "total_amount": "i.total_amount",
        "transaction_count": "s.transaction_count + i.transaction_count", "currency": "upper(i.currency)", "enriched_at": "i.enriched_at",
    }
    merged = ", ".join(f"CASE WHEN {tests[f]} THEN {values[f]} ELSE s.{f} END AS {f}" for f in tests)
    changed = ", ".join(f"CASE WHEN {test} THEN '{f}' END" for f, test in tests.items())
    return f"""incoming AS ({INCOMING}),
merged AS (SELECT s.id, s.stale AS was_stale, {merged}, list_filter([{changed}], lambda x: x IS NOT NULL) AS changed FROM v_suppliers s LEFT JOIN incoming i ON i.id = s.id)"""


FRESH = "(list_contains(changed, 'domain') OR list_contains(changed, 'industry') OR list_contains(changed, 'description'))"


def _merged(t: Tables) -> DataFrame:
    return merge.merge_fields(t.suppliers, t.sql(INCOMING), P)


@query(
    "merge_suppliers",
    with_views(f"""SELECT id, domain, industry, description, total_amount::DOUBLE AS total_amount, transaction_count, currency, enriched_at, array_to_string(changed, ';') AS changed_fields,
CASE WHEN {FRESH} THEN FALSE ELSE was_stale END AS stale FROM merged""", _merge_sql()),
)
def merge_suppliers(t: Tables) -> DataFrame:
    return _merged(t).select("id", "domain", "industry", "description", "total_amount", "transaction_count", "currency", "enriched_at", "changed_fields", "stale")


@query("needs_reclass", with_views(f"SELECT {FRESH} AS needs_reclassification, count(*) AS suppliers, sum(total_amount)::DOUBLE AS spend FROM merged GROUP BY 1", _merge_sql()))
def needs_reclass(t: Tables) -> DataFrame:
    return _merged(t).groupBy(merge.needs_reclassification(F.col("changed_fields")).alias("needs_reclassification")).agg(F.count(F.lit(1)).alias("suppliers"), F.sum("total_amount").alias("spend"))


UPSERT = f"""known AS (SELECT f.*, s.id AS old_id, s.domain AS old_domain, s.transaction_count AS old_count, s.total_amount AS old_amount, {q.domain('f.domain')} AS new_domain
  FROM folded f LEFT JOIN v_suppliers s ON s.normalized_name = f.entity),
upserted AS (SELECT *, CASE WHEN old_id IS NULL THEN (SELECT max(id) FROM v_suppliers) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY entity) ELSE old_id END AS id FROM known)"""


def _upsert(t: Tables) -> dict[str, DataFrame]:
    return resolve_entities(t.lines, t.registry, P)


@query(
    "upsert_suppliers",
    with_views("""SELECT id, name, amount::DOUBLE AS total_amount, CASE WHEN old_id IS NULL THEN transaction_count ELSE old_count + transaction_count END AS transaction_count,
CASE WHEN old_id IS NULL OR new_domain IS NOT NULL THEN new_domain ELSE old_domain END AS domain FROM (SELECT * REPLACE (CASE WHEN old_id IS NULL THEN name ELSE (SELECT s.name FROM v_suppliers s WHERE s.id = old_id) END AS name) FROM upserted) u""", LINES, UPSERT),
)
def upsert_suppliers(t: Tables) -> DataFrame:
    return _upsert(t)["suppliers"].select("id", "name", "total_amount", "transaction_count", "domain")


@query(
    "upsert_summary",
    with_views("""SELECT count(CASE WHEN old_id IS NULL THEN 1 END) AS created, count(CASE WHEN old_id IS NOT NULL THEN 1 END) AS updated, 0 AS unchanged,
count(CASE WHEN old_id IS NOT NULL AND new_domain IS NOT NULL AND new_domain <> coalesce(old_domain, '') THEN 1 END) AS needs_reclassification, CAST(sum(line_count) AS BIGINT) AS total_rows, CAST(sum(duplicates) AS BIGINT) AS duplicate_rows FROM upserted""", LINES, UPSERT),
)
def upsert_summary(t: Tables) -> DataFrame:
    return _upsert(t)["summary"]


RESULTS = """SELECT id, CASE WHEN id % 3 = 0 THEN 'HTTP 500' END AS error, CASE WHEN id % 2 = 0 THEN 'example.org' END AS domain, CASE WHEN id % 4 = 1 THEN concat(industry, ' long name') END AS industry,
  concat('f', CAST(id AS VARCHAR(20))) AS fingerprint, CASE WHEN id % 4 = 1 THEN 'enrichment' END AS parent_source FROM v_suppliers"""


@query(
    "apply_enrichment",
    with_views(f"""SELECT s.id, CASE WHEN r.domain IS NOT NULL THEN r.domain ELSE s.domain END AS domain, coalesce(r.industry, s.industry) AS industry,
CASE WHEN r.id IS NULL THEN s.enriched_at WHEN r.error IS NULL THEN {AS_OF} ELSE s.enriched_at END AS enriched_at, CASE WHEN r.id IS NULL THEN s.last_enrich_error ELSE r.error END AS last_enrich_error,
CASE WHEN r.id IS NULL THEN s.stale ELSE r.error IS NOT NULL END AS stale, CASE WHEN r.error IS NOT NULL THEN 'enrichment_failed' END AS stale_reason, CASE WHEN r.id IS NOT NULL THEN 1 END AS enrich_attempts,
CASE WHEN r.id IS NULL THEN s.parent_source ELSE r.parent_source END AS parent_source, CASE WHEN r.id IS NULL THEN s.updated_at ELSE {AS_OF} END AS updated_at
FROM v_suppliers s LEFT JOIN results r ON r.id = s.id""", f"results AS ({RESULTS})"),
)
def apply_enrichment(t: Tables) -> DataFrame:
    out = merge.apply_enrichment(t.suppliers, t.sql(RESULTS), P)
    return out.select("id", "domain", "industry", "enriched_at", "last_enrich_error", "stale", "stale_reason", "enrich_attempts", "parent_source", "updated_at")


@query(
    "mark_stale",
    with_views(f"""SELECT id, stale OR (id % 4 = 0 AND reason IS DISTINCT FROM 'enrichment_failed') AS stale, CASE WHEN id % 4 = 0 THEN 'enrichment_failed' ELSE reason END AS stale_reason,
id % 4 = 0 AND reason IS DISTINCT FROM 'enrichment_failed' AS newly_marked FROM (SELECT id, stale, CASE WHEN id % 8 = 0 THEN 'enrichment_failed' WHEN id % 8 = 1 THEN 'manual' END AS reason FROM v_suppliers) s"""),
)
def mark_stale(t: Tables) -> DataFrame:
    rows = t.suppliers.withColumn("stale_reason", F.expr("CASE WHEN id % 8 = 0 THEN 'enrichment_failed' WHEN id % 8 = 1 THEN 'manual' END"))
    reasons = t.suppliers.where("id % 4 = 0").select("id", F.lit("enrichment_failed").alias("reason"))
    return merge.mark_stale(rows, reasons, P).select("id", "stale", "stale_reason", "newly_marked")


NEW_ROWS = """SELECT l_suppkey + 1 AS supplier_id, CAST(20000000 + l_orderkey % 1000 AS VARCHAR(8)) AS unspsc_code, CAST(l_discount * 7 AS DECIMAL(10,2)) AS confidence, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_quantity
  FROM lineitem"""


@query(
    "write_classifications",
    with_views("""SELECT id, supplier_id, unspsc_code, confidence::DOUBLE AS confidence, superseded OR id < coalesce(newest, 0) AS superseded FROM (
SELECT c.id, c.supplier_id, c.unspsc_code, c.confidence, c.superseded, m.newest FROM (SELECT id, supplier_id, unspsc_code, confidence, superseded FROM v_classifications UNION ALL SELECT id, supplier_id, unspsc_code, confidence, FALSE FROM numbered) c
LEFT JOIN (SELECT supplier_id, max(id) AS newest FROM numbered GROUP BY 1) m ON m.supplier_id = c.supplier_id) x""",
    f"fresh AS ({NEW_ROWS})",
    "numbered AS (SELECT (SELECT max(id) FROM v_classifications) + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, supplier_id, l_extendedprice, l_discount, l_quantity) AS id, supplier_id, unspsc_code, greatest(0, least(1, confidence)) AS confidence FROM fresh)"),
)
def write_classifications(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "supplier_id", "l_extendedprice", "l_discount", "l_quantity"]
    return h.write_classifications(t.classifications, t.sql(NEW_ROWS), P, order).select("id", "supplier_id", "unspsc_code", "confidence", "superseded")


@query("append_classifications", CHECKS["write_classifications"])
def append_classifications(t: Tables) -> DataFrame:
    """The same batch against a stored history, by touched partitions."""
    order, path = ["l_orderkey", "l_linenumber", "l_partkey", "supplier_id", "l_extendedprice", "l_discount", "l_quantity"], f"{shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    stored.create(t.classifications, path)
    stored.append(t.spark, path, t.sql(NEW_ROWS), P, "second", order)
    return stored.read(t.spark, path).select("id", "supplier_id", "unspsc_code", "confidence", "superseded")


@query(
    "propagate_codes",
    with_views("""SELECT p.supplier_id, coalesce(r.corrected_code, r.unspsc_code) AS unspsc_code, CAST(floor(greatest(0, least(1, r.confidence * 0.9)) * 100 + 0.5) / 100 AS DOUBLE) AS confidence, p.inherit_from AS inherited_from_supplier_id,
concat('Inherited from parent company "', p.root_name, '" (', s.name, '), classified as ', coalesce(r.corrected_code, r.unspsc_code), '.') AS reasoning
FROM plan p JOIN v_current r ON r.supplier_id = p.inherit_from JOIN v_suppliers s ON s.id = p.inherit_from LEFT JOIN v_current own ON own.supplier_id = p.supplier_id
WHERE p.mode = 'inherit' AND NOT coalesce(own.reviewed, FALSE)""", ROOTS, MEMBERS, SCORED, PLAN),
)
def propagate_codes(t: Tables) -> DataFrame:
    members = fam.family_members(t.rows)
    results = members.where("classification_id IS NOT NULL").select(F.col("id").alias("supplier_id"), "name", F.col("effective_code").alias("unspsc_code"), "confidence")
    out = h.propagate_codes(fam.classification_plan(members), results, P, t.classifications)
    return out.select("supplier_id", "unspsc_code", "confidence", "inherited_from_supplier_id", "reasoning")


ASKED = """SELECT id AS request_id, id AS supplier_id, CASE WHEN id % 20 = 1 THEN '99999999' WHEN id % 20 = 2 THEN 'bad' ELSE (SELECT min(code) FROM v_taxonomy) END AS code,
  CASE WHEN id % 3 = 0 THEN ' seen ' END AS reason, concat('user_', CAST(id % 5 AS VARCHAR(20))) AS actor, id % 10 IN (1, 4, 9) AS apply_to_subsidiaries FROM v_suppliers WHERE id % 2 = 1 OR id % 10 IN (2, 4)"""
SCOPE = """asked AS (SELECT * FROM requests WHERE regexp_matches(trim(code), '^[0-9]{8}$')),
reach AS (SELECT request_id, supplier_id AS id, [supplier_id] AS path, 0 AS level FROM asked
  UNION ALL SELECT d.request_id, s.id, list_append(d.path, s.id), d.level + 1 FROM reach d JOIN asked a ON a.request_id = d.request_id JOIN v_suppliers s ON s.parent_id = d.id WHERE a.apply_to_subsidiaries AND NOT list_contains(d.path, s.id)),
scope AS (SELECT request_id, id AS supplier_id, min(level) AS level FROM reach GROUP BY 1, 2)"""


def _corrected(t: Tables) -> dict[str, DataFrame]:
    return h.apply_corrections(t.sql(ASKED), t.registry, t.classifications, t.taxonomy, P)


@query(
    "apply_corrections",
    with_views("""SELECT a.request_id, a.supplier_id, coalesce(c.corrected_code, c.unspsc_code) AS original_code, a.code AS corrected_code, a.reason, a.actor AS corrected_by, n.affected > 1 AS applied_to_subsidiaries,
n.affected AS affected_count, a.code IN (SELECT code FROM v_taxonomy) AS code_known, n.low AS lowest_affected, n.high AS highest_affected, n.total AS written_confidence
FROM asked a LEFT JOIN v_current c ON c.supplier_id = a.supplier_id JOIN (SELECT request_id, count(*) AS affected, min(supplier_id) AS low, max(supplier_id) AS high, sum(CASE WHEN level = 0 THEN 1.00 ELSE 0.95 END)::DOUBLE AS total FROM scope GROUP BY 1) n ON n.request_id = a.request_id""",
    f"requests AS ({ASKED})", SCOPE),
)
def apply_corrections(t: Tables) -> DataFrame:
    out = _corrected(t)
    written = out["history"].where(F.col("request_id").isNotNull())
    reach = written.groupBy("request_id").agg(F.min("supplier_id").alias("lowest_affected"), F.max("supplier_id").alias("highest_affected"), F.sum("confidence").alias("written_confidence"))
    return out["corrections"].join(reach, "request_id").select(
        "request_id", "supplier_id", "original_code", "corrected_code", "reason", "corrected_by", "applied_to_subsidiaries", "affected_count", "code_known", "lowest_affected", "highest_affected", "written_confidence"
    )


@query(
    "corrections_live",
    with_views("""SELECT supplier_id, request_id, CASE WHEN level = 0 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, level > 0 AS inherited_from_parent, CASE WHEN level > 0 THEN owner END AS inherited_from_supplier_id FROM (
SELECT s.supplier_id, s.request_id, s.level, a.supplier_id AS owner, row_number() OVER (PARTITION BY s.supplier_id ORDER BY s.level, s.request_id DESC) AS n FROM scope s JOIN asked a ON a.request_id = s.request_id) x WHERE n = 1""",
    f"requests AS ({ASKED})", SCOPE),
)
def corrections_live(t: Tables) -> DataFrame:
    """The row that is live after the batch, for every supplier that it reaches."""
    live = h.current_classification(_corrected(t)["history"]).where("request_id IS NOT NULL")
    return live.select("supplier_id", "request_id", "confidence", "inherited_from_parent", "inherited_from_supplier_id")


@query(
    "correction_effects",
    with_views("""SELECT 'events' AS what, CASE WHEN level = 0 THEN 'corrected' ELSE 'propagated' END AS kind, count(*) AS n, sum(supplier_id)::BIGINT AS ids FROM scope GROUP BY 1, 2
UNION ALL SELECT 'parents', 'flagged', count(*), sum(id)::BIGINT FROM (SELECT id FROM v_suppliers WHERE is_parent OR id IN (SELECT a.supplier_id FROM asked a JOIN scope s ON s.request_id = a.request_id WHERE s.level > 0)) x
UNION ALL SELECT 'records', 'numbered', count(*), sum(n)::BIGINT FROM (SELECT row_number() OVER (ORDER BY request_id) AS n FROM asked) x""", f"requests AS ({ASKED})", SCOPE),
)
def correction_effects(t: Tables) -> DataFrame:
    """Events, flagged parents and records of the batch; each record names the row that it wrote."""
    out = _corrected(t)
    written = out["history"].where("request_id IS NOT NULL AND NOT inherited_from_parent").select(F.col("id").alias("classification_id"), "corrected_at")
    tell = lambda df, what, kind, n: df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("ids")).select(F.lit(what).alias("what"), "kind", "n", "ids")
    return (
        tell(out["audit"], "events", F.col("action"), "entity_id").unionByName(tell(out["suppliers"].where("is_parent"), "parents", F.lit("flagged"), "id"))
        .unionByName(tell(out["corrections"].join(written.where("corrected_at IS NOT NULL"), "classification_id"), "records", F.lit("numbered"), "id"))
    )


@query(
    "clear_correction",
    with_views("""SELECT id, supplier_id, CASE WHEN hit THEN NULL ELSE corrected_code END AS corrected_code, CASE WHEN hit THEN FALSE ELSE reviewed END AS reviewed FROM (
SELECT c.*, c.supplier_id % 3 = 0 AND c.id IN (SELECT id FROM v_current) AS hit FROM v_classifications c) x"""),
)
def clear_correction(t: Tables) -> DataFrame:
    return h.clear_correction(t.classifications, t.suppliers.where("id % 3 = 0")).select("id", "supplier_id", "corrected_code", "reviewed")


WRITES = """SELECT concat('generic:', lower(c_name)) AS cache_key, c_name AS supplier_name, 'generic' AS provider, concat('{"o":', CAST(o_orderkey AS VARCHAR(20)), '}') AS payload, 1 AS credits_used, 0 AS hit_count,
  o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(
    "cache_upsert",
    with_views("""SELECT cache_key, arg_max(payload, (fresh, created_at, o_orderkey)) AS payload, CAST(arg_min(hit_count, (fresh, created_at, o_orderkey)) AS BIGINT) AS hit_count, min(created_at) AS created_at, arg_max(expires_at, (fresh, created_at, o_orderkey)) AS expires_at FROM (
SELECT cache_key, payload, hit_count, created_at, expires_at, 0 AS fresh, 0 AS o_orderkey FROM v_cache UNION ALL SELECT cache_key, payload, hit_count, created_at, expires_at, 1, o_orderkey FROM writes) x GROUP BY 1""", f"writes AS ({WRITES})"),
)
def cache_upsert(t: Tables) -> DataFrame:
    writes = t.sql(WRITES).groupBy("cache_key").agg(
        F.max_by(F.struct("supplier_name", "provider", "payload", "credits_used", "hit_count", "expires_at"), F.struct("created_at", "o_orderkey")).alias("w"), F.min("created_at").alias("created_at")
    ).select("cache_key", "w.*", "created_at")
    return merge.cache_upsert(t.cache, writes).select("cache_key", "payload", "hit_count", "created_at", "expires_at")


@query("audit_emit", with_views("SELECT action, count(*) AS events, count(DISTINCT entity_id) AS suppliers, min(details) AS first_details FROM (SELECT CASE WHEN old_id IS NULL THEN 'created' ELSE 'updated' END AS action, id AS entity_id, concat('{\"name\":\"', CASE WHEN old_id IS NULL THEN name ELSE (SELECT s.name FROM v_suppliers s WHERE s.id = old_id) END, '\"}') AS details FROM upserted) a GROUP BY 1", LINES, UPSERT))
def audit_emit(t: Tables) -> DataFrame:
    actions = _upsert(t)["actions"].where("action <> 'unchanged'")
    events = audit_rows(actions, "supplier", "id", F.col("action"), ["name"], "job", P)
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("entity_id").alias("suppliers"), F.min("details").alias("first_details"))


