"""List view, filters, joins on the registry, work queues and paging."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.operators import candidates, current, filters, merge, review
from spendweave.operators.families import resolve_parent as resolve
from spendweave.operators.filters import SupplierFilter
from spendweave.params import Params

P = Params()
STALE = "enriched_at < TIMESTAMP '2001-10-16 00:00:00'"


def _filtered(t: Tables, label: str, **wanted) -> DataFrame:
    return filters.supplier_filter(t.listed, SupplierFilter(**wanted), P, registry=t.suppliers).select(F.lit(label).alias("filter"), "id", "name")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _filter_sql(**tests: str) -> str:
    return with_views(" UNION ALL ".join(f"SELECT '{label}' AS filter, id, name FROM v_list WHERE {test}" for label, test in tests.items()))


@query(
    "supplier_list",
    with_views("""SELECT id, name, CAST(total_amount AS DOUBLE) AS total_amount, classification_id, effective_code, CAST(confidence AS DOUBLE) AS confidence, reviewed,
segment_code, commodity, subsidiary_count FROM v_list"""),
)
def supplier_list(t: Tables) -> DataFrame:
    return t.rows.select("id", "name", "total_amount", "classification_id", "effective_code", "confidence", "reviewed", "segment_code", "commodity", "subsidiary_count")


@query(
    "current_classification",
    with_views("SELECT supplier_id, id, unspsc_code, corrected_code, CAST(confidence AS DOUBLE) AS confidence, reviewed FROM v_current"),
)
def current_classification(t: Tables) -> DataFrame:
    return current.current_classification(t.classifications).select("supplier_id", "id", "unspsc_code", "corrected_code", "confidence", "reviewed")


@query(
    "filter_search",
    _filter_sql(
        name="contains(lower(name), '#00000001')",
        field="contains(lower(industry), 'asia')",
        wild="contains(lower(coalesce(name,'')), '00_') OR contains(lower(coalesce(industry,'')), '00_')",
        parent="contains(lower(coalesce(parent_name, '')), 'holding am')",
        place="contains(lower(country), 'nation_1') AND contains(lower(industry), 'a')",
    ),
)
def filter_search(t: Tables) -> DataFrame:
    return _union(
        _filtered(t, "name", search="#00000001"), _filtered(t, "field", search="Asia"), _filtered(t, "wild", search="00_"),
        _filtered(t, "parent", search="HOLDING am"), _filtered(t, "place", country="nation_1", industry="A"),
    )


@query("filter_roles", _filter_sql(parents="is_parent", subsidiaries="parent_id IS NOT NULL", children="parent_id = 1", ids="id IN (3, 5, 8)"))
def filter_roles(t: Tables) -> DataFrame:
    return _union(
        _filtered(t, "parents", only_parents=True), _filtered(t, "subsidiaries", only_subsidiaries=True),
        _filtered(t, "children", parent_id=1), _filtered(t, "ids", supplier_ids=(3, 5, 8)),
    )


@query(
    "filter_parent",
    _filter_sql(
        stored="parent_name = 'Holding ASIA Inc' OR parent_id IN (SELECT id FROM v_suppliers WHERE name = 'Holding ASIA Inc')",
        linked="parent_name = 'Supplier#000000000' OR parent_id IN (SELECT id FROM v_suppliers WHERE name = 'Supplier#000000000')",
    ),
)
def filter_parent(t: Tables) -> DataFrame:
    return _union(_filtered(t, "stored", parent="Holding ASIA Inc"), _filtered(t, "linked", parent="Supplier#000000000"))


@query("filter_stale", _filter_sql(stale=f"stale OR enriched_at IS NULL OR {STALE}"))
def filter_stale(t: Tables) -> DataFrame:
    return _filtered(t, "stale", only_stale=True)


@query("filter_prefix", _filter_sql(segment="starts_with(effective_code, '10')", family="starts_with(effective_code, '1012')"))
def filter_prefix(t: Tables) -> DataFrame:
    return _union(_filtered(t, "segment", segment="10"), _filtered(t, "family", code_prefix="10-12"))


@query("filter_confidence", _filter_sql(least="confidence >= 0.6", most="classification_id IS NULL OR confidence < 0.3001", both="confidence >= 0.4 AND confidence < 0.8001"))
def filter_confidence(t: Tables) -> DataFrame:
    return _union(_filtered(t, "least", min_confidence=0.6), _filtered(t, "most", max_confidence=0.3), _filtered(t, "both", min_confidence=0.4, max_confidence=0.8))


@query(
    "filter_state",
    _filter_sql(
        low="classification_id IS NOT NULL AND confidence < 0.7 AND NOT reviewed", reviewed="reviewed",
        unreviewed="classification_id IS NOT NULL AND NOT reviewed", unclassified="classification_id IS NULL", all="TRUE",
    ),
)
def filter_state(t: Tables) -> DataFrame:
    return _union(*[_filtered(t, s, state=s) for s in ("low", "reviewed", "unreviewed", "unclassified", "all")])


@query(
    "filter_dates",
    _filter_sql(
        whole="created_at >= TIMESTAMP '1995-01-05 00:00:00' AND created_at < TIMESTAMP '1995-01-09 00:00:00'",
        exact="created_at <= TIMESTAMP '1995-01-05 00:00:00'",
    ),
)
def filter_dates(t: Tables) -> DataFrame:
    return _union(_filtered(t, "whole", date_from="1995-01-05", date_to="1995-01-08"), _filtered(t, "exact", date_to="1995-01-05T00:00:00"))


@query(
    "audit_filter",
    with_views("""SELECT id, entity, action, actor FROM v_audit WHERE entity = 'report' AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
AND created_at < TIMESTAMP '2024-01-11 00:00:00' AND contains(lower(details), '"k": 4') UNION ALL SELECT id, entity, action, actor FROM v_audit WHERE actor = 'user_7' AND action = 'click'"""),
)
def audit_filter(t: Tables) -> DataFrame:
    first = filters.audit_filter(t.audit, entity="report", start="2024-01-05", end="2024-01-10", search='"K": 4')
    return first.unionByName(filters.audit_filter(t.audit, actor="user_7", action="click")).select("id", "entity", "action", "actor")


@query(
    "audit_page",
    with_views("""SELECT id, entity, action, created_at, (SELECT count(*) FROM v_audit WHERE action = 'purchase') AS total
FROM v_audit WHERE action = 'purchase' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50"""),
)
def audit_page(t: Tables) -> DataFrame:
    rows = filters.audit_filter(t.audit, action="purchase")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = filters.page(rows, [F.col("created_at").desc(), F.col("id").desc()], 2, 50)
    # fifty rows beside one total
    return shown.select("id", "entity", "action", "created_at", F.lit(1).alias("_one")).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(
    "supplier_page",
    with_views("""SELECT 'spend' AS sort, id, name FROM (SELECT * FROM v_list ORDER BY total_amount DESC NULLS FIRST, id LIMIT 25 OFFSET 25) a
UNION ALL SELECT 'name', id, name FROM (SELECT * FROM v_list ORDER BY name, id LIMIT 10) b
UNION ALL SELECT 'confidence', id, name FROM (SELECT * FROM v_list ORDER BY confidence ASC NULLS LAST, id LIMIT 20 OFFSET 60) c
UNION ALL SELECT 'updated', id, name FROM (SELECT * FROM v_list ORDER BY updated_at DESC NULLS FIRST, id LIMIT 8) d
UNION ALL SELECT 'next', id, name FROM (SELECT * FROM v_list WHERE name > 'Supplier#000000010' ORDER BY name, id LIMIT 5) e"""),
)
def supplier_page(t: Tables) -> DataFrame:
    def shown(label: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(label).alias("sort"), "id", "name")

    return _union(
        shown("spend", filters.supplier_page(t.rows, "spend", True, 2, 25)), shown("name", filters.supplier_page(t.rows, "name", False, 1, 10)),
        shown("confidence", filters.supplier_page(t.rows, "confidence", False, 4, 20)), shown("updated", filters.supplier_page(t.rows, "updated", True, 1, 8)),
        shown("next", filters.page_after(t.rows, "name", "Supplier#000000010", 11, 5)),
    )


@query(
    "page_totals",
    with_views("""SELECT 'all' AS list, count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages FROM v_list
UNION ALL SELECT 'low', count(*), CAST(greatest(1, ceil(count(*) / 7.0)) AS BIGINT) FROM v_list WHERE confidence < 0.7 AND NOT reviewed
UNION ALL SELECT 'none', count(*), CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) FROM v_list WHERE name = '?'"""),
)
def page_totals(t: Tables) -> DataFrame:
    low, none = filters.supplier_filter(t.rows, filters.SupplierFilter(state="low"), P), filters.supplier_filter(t.rows, filters.SupplierFilter(parent="?"), P)
    lists = (("all", t.rows, 25), ("low", low, 7), ("none", none, 25))
    return _union(*[filters.page_totals(rows, size).select(F.lit(label).alias("list"), "total", "pages") for label, rows, size in lists])


@query("filter_ids", with_views("SELECT id, name FROM v_list WHERE id IN (SELECT supplier_id FROM v_classifications WHERE reviewed) AND is_parent"))
def filter_ids(t: Tables) -> DataFrame:
    """A list of ids of any length, here the suppliers with a reviewed classification."""
    reviewed = t.classifications.where("reviewed").select(F.col("supplier_id").alias("id"))
    return filters.supplier_filter(t.rows, filters.SupplierFilter(only_parents=True), P, ids=reviewed).select("id", "name")


@query(
    "supplier_relatives",
    with_views("""SELECT s.id, 'parent' AS relation, 1 AS position, p.id AS relative_id, p.name, p.total_amount::DOUBLE AS total_amount FROM v_suppliers s JOIN v_suppliers p ON p.id = s.parent_id WHERE s.is_parent
UNION ALL SELECT * FROM (SELECT s.id, 'child', row_number() OVER (PARTITION BY s.id ORDER BY c.total_amount DESC NULLS LAST, c.id) AS position, c.id, c.name, c.total_amount::DOUBLE FROM v_suppliers s JOIN v_suppliers c ON c.parent_id = s.id WHERE s.is_parent) x WHERE position <= 2"""),
)
def supplier_relatives(t: Tables) -> DataFrame:
    return current.supplier_relatives(t.suppliers, t.suppliers.where("is_parent"), 2)


@query(
    "needs_classification",
    with_views("SELECT id, name, CAST(total_amount AS DOUBLE) AS total_amount FROM v_suppliers WHERE id NOT IN (SELECT supplier_id FROM v_classifications WHERE NOT superseded) ORDER BY total_amount DESC NULLS FIRST, id LIMIT 25"),
)
def needs_classification(t: Tables) -> DataFrame:
    return current.needs_classification(t.suppliers, t.classifications, 25).select("id", "name", "total_amount")


@query("classified_suppliers", with_views("SELECT id, name FROM v_suppliers WHERE id IN (SELECT DISTINCT supplier_id FROM v_classifications)"))
def classified_suppliers(t: Tables) -> DataFrame:
    return current.classified_suppliers(t.suppliers, t.classifications).select("id", "name")


@query(
    "recent_corrections",
    with_views("""SELECT c.id, c.supplier_id, s.name AS supplier_name, c.corrected_code, c.reason FROM v_corrections c JOIN v_suppliers s ON s.id = c.supplier_id
ORDER BY c.created_at DESC, c.id DESC LIMIT 40"""),
)
def recent_corrections(t: Tables) -> DataFrame:
    return current.recent_corrections(t.corrections, t.suppliers, 40).select("id", "supplier_id", "supplier_name", "corrected_code", "reason")


RECENT_SQL = f"""recent AS (SELECT c.id, c.created_at, s.name AS supplier_name, s.domain, s.industry, s.naics, c.corrected_code, c.reason, {q.key('s.name')} AS entity
  FROM v_corrections c JOIN v_suppliers s ON s.id = c.supplier_id ORDER BY c.created_at DESC, c.id DESC LIMIT 18),
shots AS (SELECT supplier_name, domain, industry, naics, corrected_code AS unspsc_code, 0.99::DOUBLE AS confidence,
  CASE WHEN coalesce(trim(reason), '') <> '' THEN concat('Human correction: ', trim(reason)) ELSE 'Human-corrected classification.' END AS reasoning, created_at, id
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id DESC) AS n FROM recent) r WHERE n = 1 ORDER BY created_at DESC, id DESC LIMIT 6)"""


@query("few_shot_recent", with_views("SELECT supplier_name, domain, industry, naics, unspsc_code, confidence, reasoning FROM shots", RECENT_SQL))
def few_shot_recent(t: Tables) -> DataFrame:
    return current.few_shot_recent(t.corrections, t.suppliers, 6).drop("newest")


def default_examples(t: Tables) -> DataFrame:
    """Default examples for the merge: one per region-wide largest supplier, read from the data."""
    rows = t.suppliers.orderBy(F.col("total_amount").desc(), "id").limit(5)
    return rows.select(
        F.col("name").alias("supplier_name"), "domain", "industry", "naics", F.lit("43211507").alias("unspsc_code"), F.lit(0.95).alias("confidence"),
        F.lit("Default.").alias("reasoning"), F.col("id").alias("position"),
    )


MERGED_SQL = """defaults AS (SELECT name AS supplier_name, domain, industry, naics, '43211507' AS unspsc_code, 0.95::DOUBLE AS confidence, 'Default.' AS reasoning, id AS position
  FROM v_suppliers ORDER BY total_amount DESC, id LIMIT 5),
both_shots AS (SELECT supplier_name, domain, industry, naics, unspsc_code, confidence, reasoning, row_number() OVER (ORDER BY created_at DESC, id DESC) AS p FROM shots
  UNION ALL SELECT supplier_name, domain, industry, naics, unspsc_code, confidence, reasoning, 1000 + row_number() OVER (ORDER BY position) AS p FROM defaults),
merged_shots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(supplier_name)) ORDER BY p) AS n FROM both_shots) m WHERE n = 1 ORDER BY p LIMIT 8)"""


@query("few_shot_merge", with_views("SELECT supplier_name, domain, industry, naics, unspsc_code, confidence, reasoning FROM merged_shots", RECENT_SQL, MERGED_SQL))
def few_shot_merge(t: Tables) -> DataFrame:
    return current.few_shot_merge(current.few_shot_recent(t.corrections, t.suppliers, 6), default_examples(t), 8).drop("priority")


@query(
    "few_shot_verified",
    with_views("""SELECT m.supplier_name, m.reasoning, coalesce(
 (SELECT min(code) FROM v_taxonomy t WHERE t.code = m.unspsc_code), (SELECT min(code) FROM v_taxonomy t WHERE substr(t.code,1,6) = substr(m.unspsc_code,1,6)),
 (SELECT min(code) FROM v_taxonomy t WHERE substr(t.code,1,4) = substr(m.unspsc_code,1,4)), (SELECT min(code) FROM v_taxonomy t WHERE substr(t.code,1,2) = substr(m.unspsc_code,1,2))) AS unspsc_code
FROM merged_shots m WHERE EXISTS (SELECT 1 FROM v_taxonomy t WHERE substr(t.code,1,2) = substr(m.unspsc_code,1,2))""", RECENT_SQL, MERGED_SQL),
)
def few_shot_verified(t: Tables) -> DataFrame:
    merged = current.few_shot_merge(current.few_shot_recent(t.corrections, t.suppliers, 6), default_examples(t), 8)
    return candidates.few_shot_verified(merged, t.taxonomy).select("supplier_name", "reasoning", "unspsc_code")


@query(
    "supplier_history",
    with_views("""SELECT supplier_id, id, code, CAST(confidence AS DOUBLE) AS confidence, superseded, n AS position
FROM (SELECT *, coalesce(corrected_code, unspsc_code) AS code, row_number() OVER (PARTITION BY supplier_id ORDER BY id DESC) AS n FROM v_classifications) h WHERE n <= 50"""),
)
def supplier_history(t: Tables) -> DataFrame:
    return current.supplier_history(t.classifications, 50).select("supplier_id", "id", "code", "confidence", "superseded", "position")


@query("last_event", with_views("SELECT action, max(created_at) AS at, arg_max(details, (created_at, id)) AS details FROM v_audit WHERE action = 'error' GROUP BY action"))
def last_event(t: Tables) -> DataFrame:
    return current.last_event(t.audit, "error")


@query(
    "last_event_with",
    with_views("SELECT action, max(created_at) AS at, arg_max(details, (created_at, id)) AS details FROM v_audit WHERE action = 'click' AND json_extract_string(details, '$.k') = '42' GROUP BY action"),
)
def last_event_with(t: Tables) -> DataFrame:
    return current.last_event(t.audit, "click", "k", "42")


@query(
    "needs_enrichment",
    with_views(f"""SELECT 'never' AS mode, id FROM (SELECT id FROM v_suppliers WHERE enriched_at IS NULL ORDER BY total_amount DESC NULLS FIRST, id LIMIT 10) a
UNION ALL SELECT 'old', id FROM (SELECT id FROM v_suppliers WHERE enriched_at IS NULL OR {STALE} ORDER BY enriched_at ASC NULLS LAST, total_amount DESC NULLS FIRST, id LIMIT 40) b
UNION ALL SELECT 'stale', id FROM v_suppliers WHERE stale OR enriched_at IS NULL OR {STALE}"""),
)
def needs_enrichment(t: Tables) -> DataFrame:
    s = t.suppliers
    return _union(
        merge.needs_enrichment(s, P, limit=10).select(F.lit("never").alias("mode"), "id"), merge.needs_enrichment(s, P, older_than=30, limit=40).select(F.lit("old").alias("mode"), "id"),
        merge.needs_enrichment(s, P, only_stale=True).select(F.lit("stale").alias("mode"), "id"),
    )


@query(
    "stale_candidates",
    with_views("""SELECT id, reason FROM (SELECT *, CASE WHEN stale THEN 'flagged_stale' WHEN enriched_at IS NULL THEN 'never_enriched' WHEN enriched_at <= TIMESTAMP '2001-10-16 00:00:00' THEN 'enrichment_old'
WHEN last_enrich_error IS NOT NULL THEN 'previous_failure' END AS reason FROM v_suppliers) c WHERE reason IS NOT NULL ORDER BY coalesce(total_amount, 0) DESC, lower(name), name, id LIMIT 50"""),
)
def stale_candidates(t: Tables) -> DataFrame:
    return merge.stale_candidates(t.suppliers, P, 50).select("id", "reason")


LOW_SQL = """SELECT id AS supplier_id, name, effective_code AS code, CAST(confidence AS DOUBLE) AS confidence, CAST(coalesce(total_amount, 0) AS DOUBLE) AS spend FROM v_list
WHERE classification_id IS NULL OR (NOT reviewed AND confidence < 0.7) ORDER BY coalesce(confidence, -1), total_amount DESC, id LIMIT 30"""


@query("low_confidence", with_views(LOW_SQL))
def low_confidence(t: Tables) -> DataFrame:
    return review.low_confidence_rows(t.rows, P, 30).select("supplier_id", "name", "code", "confidence", "spend")


QUEUE_SQL = """queue AS (SELECT *, coalesce(confidence < 0.7, FALSE) AS weak, parent_name IS NOT NULL AS named, coalesce(parent_confidence < 0.6, FALSE) AS shaky, coalesce(parent_source = 'llm', FALSE) AS inferred FROM v_list),
queued AS (SELECT id AS supplier_id, name, parent_name, effective_code AS code, CAST(total_amount AS DOUBLE) AS total_amount, array_to_string(list_filter([
  CASE WHEN classification_id IS NULL THEN 'Not classified yet' WHEN weak THEN concat('Low confidence (', CAST(confidence AS VARCHAR), ')') END,
  CASE WHEN named AND parent_id IS NULL THEN 'Parent company not linked to a supplier record' END, CASE WHEN inferred THEN 'Parent inferred by the LLM' END,
  CASE WHEN shaky THEN concat('Uncertain parent (', CAST(parent_confidence AS VARCHAR), ')') END, CASE WHEN inherited_from_parent THEN 'Inherited from parent' END], lambda x: x IS NOT NULL), ';') AS reasons
  FROM queue WHERE ((weak OR classification_id IS NULL) AND NOT coalesce(reviewed, FALSE)) OR (named AND (parent_id IS NULL OR shaky OR inferred))
  ORDER BY total_amount DESC NULLS FIRST, id LIMIT 200)"""


@query("review_queue", with_views("SELECT * FROM queued UNION ALL SELECT supplier_id, name, parent_name, code, total_amount, concat('search: ', reasons) FROM queued WHERE contains(lower(coalesce(parent_name, '')), 'asia') OR contains(lower(name), 'asia') OR contains(coalesce(code, ''), 'asia')", QUEUE_SQL))
def review_queue(t: Tables) -> DataFrame:
    rows = review.review_queue(t.rows, P).select("supplier_id", "name", "parent_name", "code", "total_amount", F.array_join("reasons", ";").alias("reasons"))
    found = filters.review_text_filter(rows, "asia").withColumn("reasons", F.concat(F.lit("search: "), "reasons"))
    return rows.unionByName(found)


@query(
    "resolve_parent",
    with_views(f"""SELECT s.id, s.parent_name, r.id AS resolved_parent_id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN parent_name ELSE concat('SUPPLIER#', lpad(CAST(id AS VARCHAR), 9, '0'), ', Inc.') END AS parent_name FROM v_suppliers) s
LEFT JOIN (SELECT {q.key('name')} AS entity, min(id) AS id FROM v_suppliers GROUP BY 1) r ON r.entity = {q.key('s.parent_name')} WHERE s.parent_name IS NOT NULL"""),
)
def resolve_parent(t: Tables) -> DataFrame:
    spelled = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(", Inc."))
    rows = t.suppliers.withColumn("parent_name", F.when(F.col("id") % 2 == 0, F.col("parent_name")).otherwise(spelled))
    return resolve(rows).select("id", "parent_name", "resolved_parent_id")


CACHE_SQL = f"""asked AS (SELECT id, concat('generic:', {q.key('name')}) AS cache_key FROM v_suppliers),
live AS (SELECT * FROM v_cache WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2001-11-15 00:00:00')"""


@query(
    "cache_split",
    with_views("SELECT a.id, a.cache_key, l.payload, l.cache_key IS NOT NULL AS hit FROM asked a LEFT JOIN live l ON l.cache_key = a.cache_key", CACHE_SQL),
)
def cache_split(t: Tables) -> DataFrame:
    hits, misses = merge.cache_split(t.suppliers.select("id", "name"), t.cache, "generic", P)
    return hits.select("id", "cache_key", "payload", F.lit(True).alias("hit")).unionByName(misses.select("id", "cache_key", F.lit(None).cast("string").alias("payload"), F.lit(False).alias("hit")))


@query(
    "code_search",
    with_views("""SELECT 'prefix' AS term, code, commodity FROM (SELECT * FROM v_taxonomy WHERE starts_with(code, '101') ORDER BY code LIMIT 25) a
UNION ALL SELECT 'text', code, commodity FROM (SELECT * FROM v_taxonomy WHERE contains(lower(commodity), 'ring') OR contains(lower(class), 'ring') OR contains(lower(family), 'ring') OR contains(lower(segment), 'ring') ORDER BY code LIMIT 100) b
UNION ALL SELECT 'blank', code, commodity FROM (SELECT * FROM v_taxonomy ORDER BY code LIMIT 5) c"""),
)
def code_search(t: Tables) -> DataFrame:
    def found(label: str, term: str, limit: int) -> DataFrame:
        return candidates.code_search(t.taxonomy, term, limit).select(F.lit(label).alias("term"), "code", "commodity")

    return _union(found("prefix", " 101 ", 25), found("text", "Ring", 200), found("blank", " ", 5))


RULES = [("red ring", "31171500", 0.9), ("ring", "31171600", 0.8), ("BOLT", "31161600", 0.85), ("small", "24101600", 0.5)]


@query(
    "rule_classify",
    """SELECT rule, code, confidence, count(*) AS parts FROM (SELECT CASE WHEN contains(lower(p_name), 'red ring') THEN 0 WHEN contains(lower(p_name), 'ring') THEN 1 WHEN contains(lower(p_name), 'bolt') THEN 2
WHEN contains(lower(p_name), 'small') THEN 3 END AS rule FROM part) p LEFT JOIN (VALUES (0, '31171500', 0.9::DOUBLE), (1, '31171600', 0.8::DOUBLE), (2, '31161600', 0.85::DOUBLE), (3, '24101600', 0.5::DOUBLE)) r(rule, code, confidence) USING (rule) GROUP BY 1, 2, 3""",
)
def rule_classify(t: Tables) -> DataFrame:
    return candidates.rule_classify(t.base("part"), RULES, "p_name").groupBy("rule", "code", "confidence").agg(F.count(F.lit(1)).alias("parts"))


