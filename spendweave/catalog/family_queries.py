"""Families, plans and link checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.operators import families as fam
from spendweave.operators import current, filters
from spendweave.params import Params
from spendweave.sources.reports import family_edges, hierarchy_export as export

P = Params()

# Roots by walking up with the path in hand; a walk that meets itself ends on a cycle.
ROOTS = """edges AS (SELECT s.id, p.id AS up FROM v_suppliers s JOIN v_suppliers p ON p.id = s.parent_id),
walk AS (SELECT id, id AS cur, [id] AS path, FALSE AS looped FROM v_suppliers
  UNION ALL SELECT w.id, e.up, list_append(w.path, e.up), list_contains(w.path, e.up) FROM walk w JOIN edges e ON e.id = w.cur WHERE NOT w.looped),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) AS n FROM walk) x WHERE n = 1),
roots AS (SELECT e.id, CASE WHEN looped THEN list_min(list_slice(path, list_position(path, cur), len(path))) ELSE cur END AS root_id,
  CASE WHEN looped THEN len(path) - 2 ELSE len(path) - 1 END AS hops, looped AS in_cycle, s.parent_id IS NOT NULL AND s.parent_id NOT IN (SELECT id FROM v_suppliers) AS is_orphan
  FROM ends e JOIN v_suppliers s ON s.id = e.id)"""

MEMBERS = f"""named AS (SELECT l.*, r.root_id AS top, r.hops, r.in_cycle, r.is_orphan, l.parent_id IS NULL AND l.parent_name IS NOT NULL AND {q.key('l.parent_name')} <> '' AND {q.key('l.parent_name')} <> {q.key('l.name')} AS is_virtual,
  {q.key('l.parent_name')} AS parent_key FROM v_list l JOIN roots r ON r.id = l.id),
members AS (SELECT *, CASE WHEN is_virtual THEN concat('v:', parent_key) ELSE concat('s:', CAST(top AS VARCHAR)) END AS cluster_key, CASE WHEN NOT is_virtual THEN top END AS root_id,
  NOT is_virtual AND id = top AS is_root, CASE WHEN NOT is_virtual AND id = top THEN 0 WHEN is_virtual THEN 1 ELSE greatest(1, hops) END AS depth FROM named),
clusters AS (SELECT m.cluster_key, m.root_id, m.is_virtual, coalesce(any_value(s.name), arg_min(m.parent_name, (lower(m.name), m.name, m.id))) AS root_name, any_value(s.domain) AS root_domain,
  count(*) AS supplier_count, count(CASE WHEN NOT is_root THEN 1 END) AS subsidiary_count, sum(m.total_amount)::DOUBLE AS total_amount FROM members m LEFT JOIN v_suppliers s ON s.id = m.root_id GROUP BY 1, 2, 3)"""

SCORED = """scored AS (SELECT *, CASE WHEN domain IS NOT NULL THEN 3 ELSE 0 END + 5 + least(3, CAST(ceil(length(coalesce(description, '')) / 120.0) AS INT)) + CASE WHEN is_parent THEN 1 ELSE 0 END AS score FROM members),
reps AS (SELECT cluster_key, id AS rep_id, name AS rep_name, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY score DESC, coalesce(total_amount, 0) DESC, lower(name), name, id) AS n FROM scored) x WHERE n = 1),
planned AS (SELECT c.*, r.rep_id, r.rep_name, r.score, c.supplier_count > 1 OR c.is_virtual AS is_family FROM clusters c JOIN reps r ON r.cluster_key = c.cluster_key)"""

ROLLUP = """tallied AS (SELECT cluster_key, effective_code AS code, count(*) AS n, min((NOT is_root, lower(name), name, id)) AS first FROM members WHERE effective_code IS NOT NULL GROUP BY 1, 2),
popular AS (SELECT cluster_key, arg_min(code, (-n, first)) AS code FROM tallied GROUP BY 1),
rollup_rows AS (SELECT c.cluster_key, c.root_id, c.root_name, c.root_domain, c.is_virtual, c.supplier_count, c.subsidiary_count, c.total_amount, coalesce(m.root_code, p.code) AS code, m.confidence, m.stale_count, m.low_confidence_count
  FROM clusters c JOIN (SELECT cluster_key, max(CASE WHEN is_root THEN effective_code END) AS root_code, sum(confidence)::DOUBLE / count(confidence) AS confidence, count(CASE WHEN stale THEN 1 END) AS stale_count,
    count(CASE WHEN confidence < 0.7 AND NOT reviewed THEN 1 END) AS low_confidence_count FROM members GROUP BY 1) m ON m.cluster_key = c.cluster_key LEFT JOIN popular p ON p.cluster_key = c.cluster_key)"""


@query("root_of", with_views("SELECT id, root_id, in_cycle, is_orphan FROM roots", ROOTS))
def root_of(t: Tables) -> DataFrame:
    return fam.resolve_roots(t.suppliers.select("id", "parent_id")).select("id", "root_id", "in_cycle", "is_orphan")


@query("member_depth", with_views("SELECT id, cluster_key, CAST(depth AS BIGINT) AS depth, is_root FROM members", ROOTS, MEMBERS))
def member_depth(t: Tables) -> DataFrame:
    return fam.family_members(t.suppliers).select("id", "cluster_key", "depth", "is_root")


@query("families", with_views("SELECT cluster_key, root_id, is_virtual, root_name, root_domain, supplier_count, subsidiary_count, total_amount FROM clusters", ROOTS, MEMBERS))
def families(t: Tables) -> DataFrame:
    return fam.clusters(fam.family_members(t.suppliers)).select("cluster_key", "root_id", "is_virtual", "root_name", "root_domain", "supplier_count", "subsidiary_count", "total_amount")


@query("hierarchy_totals", with_views("""SELECT count(DISTINCT cluster_key) AS clusters, (SELECT count(*) FROM clusters WHERE subsidiary_count > 0) AS families, count(*) AS suppliers,
count(CASE WHEN is_orphan THEN 1 END) AS orphans, bool_or(in_cycle) AS had_cycle FROM members""", ROOTS, MEMBERS))
def hierarchy_totals(t: Tables) -> DataFrame:
    return fam.hierarchy_totals(fam.family_members(t.suppliers))


@query("hierarchy_search", with_views("""SELECT c.cluster_key, c.root_name, coalesce(m.n, 0) AS matching_members FROM clusters c LEFT JOIN (SELECT cluster_key, count(*) AS n FROM members WHERE contains(lower(name), '3') GROUP BY 1) m ON m.cluster_key = c.cluster_key
WHERE contains(lower(c.root_name), '3') OR m.n > 0""", ROOTS, MEMBERS))
def hierarchy_search(t: Tables) -> DataFrame:
    members = fam.family_members(t.suppliers)
    return filters.hierarchy_search(members, fam.clusters(members), "3").select("cluster_key", "root_name", "matching_members")


@query("representative", with_views("SELECT cluster_key, rep_id AS representative_id, rep_name AS representative_name, CAST(score AS BIGINT) AS representative_score FROM reps", ROOTS, MEMBERS, SCORED))
def representative(t: Tables) -> DataFrame:
    return fam.representatives(fam.family_members(t.suppliers))


PLAN = """plan AS (SELECT m.id AS supplier_id, m.name, m.cluster_key, CASE WHEN NOT p.is_family THEN 'direct' WHEN m.id = p.rep_id THEN 'parent' ELSE 'inherit' END AS mode,
  CASE WHEN p.is_family AND m.id <> p.rep_id THEN p.rep_id END AS inherit_from, CASE WHEN p.is_family AND m.id = p.rep_id AND p.is_virtual THEN p.root_name END AS parent_name, p.root_name
  FROM members m JOIN planned p ON p.cluster_key = m.cluster_key)"""


@query("classification_plan", with_views("SELECT * FROM plan", ROOTS, MEMBERS, SCORED, PLAN))
def classification_plan(t: Tables) -> DataFrame:
    return fam.classification_plan(fam.family_members(t.suppliers)).drop("cluster_total")


@query(
    "plan_preview",
    with_views("""SELECT kind, sum(items)::BIGINT AS items, sum(suppliers)::BIGINT AS suppliers, CAST(ceil(sum(items) / 10.0) AS BIGINT) AS requests FROM (
SELECT 'family' AS kind, count(*) AS items, sum(supplier_count) AS suppliers FROM planned WHERE is_family UNION ALL SELECT 'single', count(*), count(*) FROM planned WHERE NOT is_family) x GROUP BY 1""", ROOTS, MEMBERS, SCORED),
)
def plan_preview(t: Tables) -> DataFrame:
    return fam.estimated_requests(fam.plan_preview(fam.family_members(t.suppliers), P), P)


@query("parent_rollup", with_views("SELECT * FROM rollup_rows", ROOTS, MEMBERS, ROLLUP))
def parent_rollup(t: Tables) -> DataFrame:
    return fam.parent_rollup(fam.family_members(t.rows), P)


@query("top_parents", with_views("SELECT * FROM rollup_rows ORDER BY total_amount DESC, cluster_key LIMIT 10", ROOTS, MEMBERS, ROLLUP))
def top_parents(t: Tables) -> DataFrame:
    return fam.top_parents(fam.parent_rollup(fam.family_members(t.rows), P))


EDGES = """edge_rows AS (SELECT c.cluster_key, c.root_name AS parent_name, coalesce(r.effective_code, '') AS parent_code, 'parent' AS role, c.root_id AS supplier_id, c.root_name AS supplier_name, coalesce(r.effective_code, '') AS unspsc_code,
   NULL::DOUBLE AS confidence, CASE WHEN c.subsidiary_count = 0 THEN c.total_amount END AS amount, c.total_amount AS cluster_total_amount FROM clusters c LEFT JOIN v_list r ON r.id = c.root_id
 UNION ALL SELECT c.cluster_key, c.root_name, coalesce(r.effective_code, ''), 'subsidiary', m.id, m.name, coalesce(m.effective_code, ''), m.confidence::DOUBLE, m.total_amount::DOUBLE, c.total_amount
   FROM clusters c LEFT JOIN v_list r ON r.id = c.root_id JOIN members m ON m.cluster_key = c.cluster_key AND NOT m.is_root)"""


@query("hierarchy_export", with_views("SELECT parent_name, parent_code, role, supplier_name, unspsc_code, confidence, amount, cluster_total_amount FROM edge_rows", ROOTS, MEMBERS, EDGES))
def hierarchy_export(t: Tables) -> DataFrame:
    members = fam.family_members(t.rows)
    return export(members, fam.clusters(members))


@query(
    "family_rows",
    with_views("""SELECT e.cluster_key, e.parent_name, e.parent_code, e.role, e.supplier_id, e.supplier_name, e.unspsc_code, r.supplier_count, r.subsidiary_count, r.stale_count, r.low_confidence_count
FROM edge_rows e JOIN rollup_rows r ON r.cluster_key = e.cluster_key""", ROOTS, MEMBERS, ROLLUP, EDGES),
)
def family_rows(t: Tables) -> DataFrame:
    """Family figures beside one line per member (a line each instead of one unbounded list per family)."""
    from spendweave.session import spread_join

    members = fam.family_members(t.rows)
    figures = fam.parent_rollup(members, P).select("cluster_key", "supplier_count", F.col("subsidiary_count").alias("_subs"), "stale_count", "low_confidence_count")
    edges = family_edges(members, fam.clusters(members)).drop("subsidiary_count")
    return spread_join(edges, figures, "cluster_key", spread_by="supplier_name").select(
        "cluster_key", "parent_name", "parent_code", "role", "supplier_id", "supplier_name", "unspsc_code", "supplier_count", F.col("_subs").alias("subsidiary_count"), "stale_count", "low_confidence_count"
    )


SEEN = """seen AS (SELECT id AS seed_id, id, 0 AS level, [id] AS path FROM v_suppliers WHERE is_parent
  UNION ALL SELECT d.seed_id, s.id, d.level + 1, list_append(d.path, s.id) FROM seen d JOIN v_suppliers s ON s.parent_id = d.id WHERE NOT list_contains(d.path, s.id))"""


@query("descendants", with_views("SELECT seed_id, id, CAST(min(level) AS BIGINT) AS level FROM seen WHERE level > 0 GROUP BY 1, 2", SEEN))
def descendants(t: Tables) -> DataFrame:
    seeds = t.suppliers.where("is_parent").select(F.col("id").alias("seed_id"))
    return fam.descendants(seeds, t.registry.select("id", "parent_id"))


BELOW = """below AS (SELECT id AS seed_id, id, [id] AS path FROM v_suppliers WHERE id % 3 = 1
  UNION ALL SELECT d.seed_id, s.id, list_append(d.path, s.id) FROM below d JOIN v_suppliers s ON s.parent_id = d.id WHERE NOT list_contains(d.path, s.id))"""


@query("reclass_scope", with_views("SELECT DISTINCT id FROM below", BELOW))
def reclass_scope(t: Tables) -> DataFrame:
    seeds = t.suppliers.where("id % 3 = 1").select(F.col("id").alias("seed_id"))
    return fam.scope_below(seeds, t.registry.select("id", "parent_id"))


@query(
    "link_guard",
    with_views("""SELECT p.supplier_id, p.parent_id, CASE WHEN p.supplier_id = p.parent_id THEN 'self' WHEN t.id IS NULL THEN 'missing' WHEN s.parent_id = p.parent_id THEN 'already' WHEN b.id IS NOT NULL THEN 'cycle' ELSE 'ok' END AS verdict
FROM proposals p LEFT JOIN v_suppliers s ON s.id = p.supplier_id LEFT JOIN v_suppliers t ON t.id = p.parent_id LEFT JOIN (SELECT DISTINCT seed_id, id FROM under WHERE seed_id <> id) b ON b.seed_id = p.supplier_id AND b.id = p.parent_id""",
    "proposals AS (SELECT id AS supplier_id, CASE id % 5 WHEN 0 THEN id WHEN 1 THEN id + 4 WHEN 2 THEN id - 1 WHEN 3 THEN id + 1 ELSE id + 5000000 END AS parent_id FROM v_suppliers)",
    BELOW.replace("below", "under").replace(" WHERE id % 3 = 1", "")),
)
def link_guard(t: Tables) -> DataFrame:
    pick = F.expr("CASE id % 5 WHEN 0 THEN id WHEN 1 THEN id + 4 WHEN 2 THEN id - 1 WHEN 3 THEN id + 1 ELSE id + 5000000 END")
    proposals = t.suppliers.select(F.col("id").alias("supplier_id"), pick.alias("parent_id"))
    return fam.link_guard(proposals, t.registry.select("id", "parent_id"))


@query(
    "link_batch",
    with_views("""SELECT p.id AS supplier_id, p.parent_id, CASE WHEN v.verdict <> 'put in' THEN v.verdict WHEN p.id IN (SELECT last FROM refused) THEN 'cycle' ELSE 'ok' END AS verdict
FROM proposals p JOIN judged v ON v.id = p.id""",
    "proposals AS (SELECT id, CASE id % 10 WHEN 7 THEN id + 1 WHEN 8 THEN id - 1 WHEN 1 THEN id + 2 WHEN 6 THEN id WHEN 5 THEN id + 5000000 WHEN 4 THEN id - 1 ELSE id + 10 END AS parent_id FROM v_suppliers)",
    """judged AS (SELECT p.id, p.parent_id, CASE WHEN p.parent_id = p.id THEN 'self' WHEN t.id IS NULL THEN 'missing' WHEN s.parent_id = p.parent_id THEN 'already' ELSE 'put in' END AS verdict
FROM proposals p JOIN v_suppliers s ON s.id = p.id LEFT JOIN v_suppliers t ON t.id = p.parent_id),
linked AS (SELECT s.id, coalesce(CASE WHEN j.verdict = 'put in' THEN j.parent_id END, s.parent_id) AS up FROM v_suppliers s JOIN judged j ON j.id = s.id),
around AS (SELECT id, up AS cur, [id] AS path FROM linked
  UNION ALL SELECT a.id, l.up, list_append(a.path, a.cur) FROM around a JOIN linked l ON l.id = a.cur WHERE NOT list_contains(a.path, a.cur)),
ring AS (SELECT id, list_min(path) AS low FROM around WHERE cur = id),
refused AS (SELECT max(r.id) AS last FROM ring r JOIN judged j ON j.id = r.id WHERE j.verdict = 'put in' GROUP BY low)"""),
)
def link_batch(t: Tables) -> DataFrame:
    """Every supplier asks for a parent at once; some pairs ask for each other, and some links close a ring with stored ones."""
    pick = F.expr("CASE id % 10 WHEN 7 THEN id + 1 WHEN 8 THEN id - 1 WHEN 1 THEN id + 2 WHEN 6 THEN id WHEN 5 THEN id + 5000000 WHEN 4 THEN id - 1 ELSE id + 10 END")
    proposals = t.suppliers.select(F.col("id").alias("request_id"), F.col("id").alias("supplier_id"), pick.alias("parent_id"))
    return fam.link_batch(proposals, t.registry.select("id", "parent_id")).drop("request_id")


@query(
    "supplier_detail",
    with_views("""SELECT s.id, s.parent_id, p.name AS parent, (SELECT count(*) FROM v_suppliers c WHERE c.parent_id = s.id) AS child_count, (SELECT count(DISTINCT u.id) FROM under u WHERE u.seed_id = s.id AND u.id <> s.id) AS descendants,
(SELECT count(*) FROM v_classifications h WHERE h.supplier_id = s.id) AS classifications, coalesce(n.corrected_code, n.unspsc_code) AS code
FROM v_suppliers s LEFT JOIN v_suppliers p ON p.id = s.parent_id LEFT JOIN v_current n ON n.supplier_id = s.id""", BELOW.replace("below", "under").replace(" WHERE id % 3 = 1", "")),
)
def supplier_detail(t: Tables) -> DataFrame:
    return current.supplier_detail(t.registry, t.classifications, t.suppliers)


@query("parent_options", with_views("SELECT cluster_key, root_id, root_name, subsidiary_count FROM clusters WHERE subsidiary_count > 0", ROOTS, MEMBERS))
def parent_options(t: Tables) -> DataFrame:
    return fam.parent_options(fam.clusters(fam.family_members(t.suppliers)))


@query(
    "unlink",
    with_views("""SELECT s.id, CASE WHEN s.id % 10 NOT IN (3, 5) THEN s.parent_id END AS parent_id,
CASE WHEN s.id IN (SELECT parent_id FROM v_suppliers WHERE id % 10 IN (3, 5) AND parent_id IS NOT NULL) THEN s.id IN (SELECT parent_id FROM v_suppliers WHERE id % 10 NOT IN (3, 5) AND parent_id IS NOT NULL) ELSE s.is_parent END AS is_parent FROM v_suppliers s"""),
)
def unlink(t: Tables) -> DataFrame:
    return fam.unlink(t.suppliers, t.suppliers.where("id % 10 IN (3, 5)")).select("id", "parent_id", "is_parent")


@query(
    "resolve_links",
    with_views(f"""SELECT c.id AS supplier_id, c.status, CASE WHEN c.status = 'linked' THEN coalesce(c.rid, 100000000 + f.n) END AS parent_key_id, c.parent_name, c.rid IS NULL AND c.status = 'linked' AS parent_created
FROM judged c LEFT JOIN (SELECT parent_key, row_number() OVER (ORDER BY parent_key) AS n FROM judged WHERE status = 'linked' AND rid IS NULL GROUP BY 1) f ON f.parent_key = c.parent_key""",
    ROOTS,
    f"""registered AS (SELECT {q.key('name')} AS entity, min(id) AS rid FROM v_suppliers GROUP BY 1),
judged AS (SELECT s.id, s.parent_name, {q.key('s.parent_name')} AS parent_key, g.rid, CASE WHEN s.parent_confidence < 0.5 THEN 'low_confidence' WHEN {q.key('s.parent_name')} = s.normalized_name THEN 'self'
  WHEN r.root_id = s.id THEN 'cycle' ELSE 'linked' END AS status FROM (SELECT id, normalized_name, parent_confidence, CASE WHEN id % 10 = 1 THEN concat('Supplier#', lpad(CAST(id AS VARCHAR), 9, '0')) ELSE parent_name END AS parent_name, parent_id FROM v_suppliers) s
  LEFT JOIN registered g ON g.entity = {q.key('s.parent_name')} LEFT JOIN roots r ON r.id = g.rid WHERE s.parent_id IS NULL AND s.parent_name IS NOT NULL)"""),
)
def resolve_links(t: Tables) -> DataFrame:
    below = F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0"))
    rows = t.registry.withColumn("parent_name", F.when(F.col("id") % 10 == 1, below).otherwise(F.col("parent_name")))
    out = fam.resolve_links(rows, P)
    top = rows.agg(F.max("id").alias("_top"))
    shift = out["links"].withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one")
    number = F.when(F.col("parent_created"), F.col("parent_id") - F.col("_top") + 100_000_000).otherwise(F.col("parent_id"))
    return shift.select("supplier_id", "status", number.alias("parent_key_id"), "parent_name", "parent_created")
