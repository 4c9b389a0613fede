"""Corporate families over ``(id, parent_id)`` links: clusters, roll-ups, plans and link resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.text import entity_key, richness, title_case
from spendweave.functions.values import low_confidence, route_tier
from spendweave.functions.domains import registrable_domain
from spendweave.operators.forest import _resolve, descendant_counts, descendants, link_batch, link_guard, resolve_roots
from spendweave.params import Params
from spendweave.session import cut, ranked, spread_join

MAX_DEPTH = 33


def name_order(prefix: str = "") -> Column:
    return F.struct(F.lower(prefix + "name").alias("low"), F.col(prefix + "name").alias("name"), F.col(prefix + "id").alias("id"))


def family_members(rows: DataFrame) -> DataFrame:
    """Every row with its cluster. Rows that only name a parent meet in a virtual cluster of that name,
    even when a supplier of that name exists; all others go to the topmost row their links reach.

    The result is written once: every family operator below reads it, none recomputes the links.
    """
    parent_key = entity_key(F.col("parent_name"))
    named = F.col("parent_id").isNull() & (F.coalesce(F.col("parent_name"), F.lit("")) != "") & (parent_key != "") & (parent_key != entity_key(F.col("name")))
    rows, _ = cut(rows)
    joined = rows.join(_resolve(rows), "id").withColumn("_key", F.when(named, parent_key))
    virtual = F.col("_key").isNotNull()
    placed = (
        joined.withColumn("is_virtual", virtual)
        .withColumn("cluster_key", F.when(virtual, F.concat(F.lit("v:"), F.col("_key"))).otherwise(F.concat(F.lit("s:"), F.col("root_id").cast("string"))))
        .withColumn("root_id", F.when(~virtual, F.col("root_id")))
        .withColumn("is_root", F.coalesce(F.col("id") == F.col("root_id"), F.lit(False)))
        .withColumn("depth", F.when(F.col("is_root"), 0).otherwise(F.greatest(F.lit(1), F.least(F.when(virtual, 1).otherwise(F.col("depth")), F.lit(MAX_DEPTH)))).cast("int"))
        .drop("_key")
    )
    return cut(placed)[0]


def _optional(rows: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def clusters(members: DataFrame) -> DataFrame:
    """One row per cluster: root, name, domain, spend and sizes."""
    members = _optional(members, "parent_domain")
    grouped = members.groupBy("cluster_key", "root_id", "is_virtual").agg(
        F.count(F.lit(1)).alias("supplier_count"),
        F.count_if(~F.col("is_root")).alias("subsidiary_count"),
        F.sum(F.coalesce("total_amount", F.lit(0))).alias("total_amount"),
        F.min_by(F.when(F.col("is_virtual"), F.col("parent_name")), F.when(F.col("is_virtual"), name_order())).alias("_vname"),
        F.min_by(_filled("parent_domain"), F.when(F.col("is_virtual") & _filled("parent_domain").isNotNull(), name_order())).alias("_vdomain"),
    )
    return _named(grouped, members)


def _named(grouped: DataFrame, members: DataFrame) -> DataFrame:
    heads = _optional(members, "parent_domain").where("is_root").select(F.col("id").alias("root_id"), F.col("name").alias("_name"), F.coalesce(_filled("domain"), _filled("parent_domain")).alias("_domain"))
    return (
        grouped.join(heads, "root_id", "left")
        .withColumn("root_name", F.coalesce("_name", "_vname"))
        .withColumn("root_domain", F.when(F.col("is_virtual"), F.col("_vdomain")).otherwise(F.col("_domain")))
        .drop("_name", "_domain", "_vname", "_vdomain")
    )


def parent_rollup(members: DataFrame, params: Params) -> DataFrame:
    """Families with spend, counts, mean confidence and code: the root's own code, else the most frequent
    member code (first member in family order on ties). Rows are combined per (family, code) first, so a
    family holding a third of all suppliers is aggregated map-side."""
    members = _optional(members, "parent_domain")
    rank = F.struct((~F.col("is_root")).alias("later"), name_order().alias("by_name"))
    per_code = members.groupBy("cluster_key", "root_id", "is_virtual", "effective_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_root")).alias("subs"),
        F.sum(F.coalesce("total_amount", F.lit(0))).alias("spend"),
        F.count_if(F.col("stale")).alias("stale"),
        F.count_if(low_confidence(F.col("confidence"), F.col("reviewed"), params.confidence_threshold)).alias("low"),
        F.sum("confidence").alias("conf"),
        F.count("confidence").alias("conf_n"),
        F.min(rank).alias("first"),
        F.max(F.when(F.col("is_root"), F.col("effective_code"))).alias("root_code"),
        F.min_by(F.when(F.col("is_virtual"), F.col("parent_name")), F.when(F.col("is_virtual"), name_order())).alias("vname"),
        F.min_by(_filled("parent_domain"), F.when(F.col("is_virtual") & _filled("parent_domain").isNotNull(), name_order())).alias("vdomain"),
        F.min(F.when(F.col("is_virtual") & _filled("parent_domain").isNotNull(), name_order())).alias("vorder"),
    )
    popular = F.struct((-F.col("n")).alias("n"), F.col("first").alias("first"))
    grouped = per_code.groupBy("cluster_key", "root_id", "is_virtual").agg(
        F.sum("n").alias("supplier_count"),
        F.sum("subs").alias("subsidiary_count"),
        F.sum("spend").alias("total_amount"),
        F.coalesce(F.max("root_code"), F.min_by("effective_code", F.when(F.col("effective_code").isNotNull(), popular))).alias("code"),
        F.try_divide(F.sum("conf").cast("double"), F.sum("conf_n")).alias("confidence"),
        F.sum("stale").alias("stale_count"),
        F.sum("low").alias("low_confidence_count"),
        F.min_by("vname", F.when(F.col("is_virtual"), F.col("first"))).alias("_vname"),
        F.min_by("vdomain", "vorder").alias("_vdomain"),
    )
    return _named(grouped, members)


def top_parents(rollup: DataFrame, limit: int = 10) -> DataFrame:
    return rollup.orderBy(F.col("total_amount").desc(), "cluster_key").limit(limit)


def representatives(members: DataFrame) -> DataFrame:
    """Per cluster the richest member, then the largest spend, then the name: an aggregate, not a window."""
    members = _optional(members, "sic")
    best = members.withColumn("_score", richness(*[F.col(c) for c in ("domain", "industry", "naics", "sic", "description", "is_parent")]))
    order = F.struct((-F.col("_score")).alias("s"), (-F.coalesce("total_amount", F.lit(0))).alias("a"), name_order().alias("n"))
    return best.groupBy("cluster_key").agg(
        F.min_by(F.struct(F.col("id").alias("id"), F.col("name").alias("name"), F.col("_score").alias("score")), order).alias("r")
    ).select("cluster_key", F.col("r.id").alias("representative_id"), F.col("r.name").alias("representative_name"), F.col("r.score").alias("representative_score"))


def plan_families(members: DataFrame) -> DataFrame:
    return clusters(members).join(representatives(members), "cluster_key").withColumn("is_family", (F.col("supplier_count") > 1) | F.col("is_virtual"))


def classification_plan(members: DataFrame) -> DataFrame:
    """Exactly one assignment per supplier: ``parent`` for a family's representative, ``inherit`` for its
    other members, ``direct`` for the rest. The family row is joined back with hot families spread out."""
    families = plan_families(members).select("cluster_key", "representative_id", "is_family", "root_name", F.col("is_virtual").alias("_virtual"), F.col("total_amount").alias("cluster_total"))
    joined = spread_join(members.select("id", "name", "cluster_key"), families, "cluster_key", spread_by="id")
    is_rep = F.col("id") == F.col("representative_id")
    return joined.select(
        F.col("id").alias("supplier_id"),
        "name",
        "cluster_key",
        F.when(~F.col("is_family"), "direct").when(is_rep, "parent").otherwise("inherit").alias("mode"),
        F.when(F.col("is_family") & ~is_rep, F.col("representative_id")).alias("inherit_from"),
        F.when(F.col("is_family") & is_rep & F.col("_virtual"), F.col("root_name")).alias("parent_name"),
        "root_name",
        "cluster_total",
    )


def plan_preview(members: DataFrame, params: Params) -> DataFrame:
    """Work per kind and tier, with the request estimate of each kind."""
    plan = plan_families(members)
    families = plan.where("is_family").select(F.lit("family").alias("kind"), F.lit(params.accurate_model).alias("model"), "supplier_count", "total_amount")
    singles = members.join(plan.where(~F.col("is_family")).select("cluster_key"), "cluster_key", "left_semi").select(
        F.lit("single").alias("kind"),
        route_tier(F.lit(False), F.col("total_amount"), F.col("parent_id").isNotNull() | (F.coalesce("parent_name", F.lit("")) != ""), params).alias("model"),
        F.lit(1).cast("long").alias("supplier_count"),
        F.coalesce("total_amount", F.lit(0)).alias("total_amount"),
    )
    return families.unionByName(singles).groupBy("kind", "model").agg(
        F.count(F.lit(1)).alias("items"), F.sum("supplier_count").alias("suppliers"), F.sum("total_amount").alias("total_amount")
    )


def estimated_requests(preview: DataFrame, params: Params) -> DataFrame:
    kinds = preview.groupBy("kind").agg(F.sum("items").alias("items"), F.sum("suppliers").alias("suppliers"))
    return kinds.withColumn("requests", F.ceil(F.col("items") / F.lit(params.batch_size)).cast("long"))


def scope_below(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct ids of the seeds and everything below them, by doubling a "has a seed above" flag.

    No pairs are built: the state stays one row per supplier, and rounds grow with the logarithm of depth.
    """
    marks = seeds.select(F.col("seed_id").alias("id"), F.lit(True).alias("_seed")).distinct()
    state, _ = cut(
        links.select("id", F.col("parent_id").alias("anc")).join(marks, "id", "left").select("id", "anc", F.coalesce("_seed", F.lit(False)).alias("inside"))
    )
    while True:
        lookup = state.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("inside").alias("_inside"))
        state, seen = cut(
            state.join(lookup, "anc", "left").select(
                "id",
                F.col("_anc").alias("anc"),
                (F.col("inside") | F.coalesce("_inside", F.lit(False))).alias("inside"),
                (~F.col("inside") & F.coalesce("_inside", F.lit(False))).alias("_new"),
            ),
            new=F.count_if("_new"),
        )
        state = state.drop("_new")
        if not seen["new"]:
            return state.where("inside").select("id")


def resolve_parent(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Registered supplier behind each declared parent name, by entity key (smallest id when several)."""
    registered = (rows if registry is None else registry).groupBy(entity_key(F.col("name")).alias("parent_key")).agg(F.min("id").alias("resolved_parent_id"))
    declared = rows.where(F.coalesce("parent_name", F.lit("")) != "").select("id", "name", "parent_name", entity_key(F.col("parent_name")).alias("parent_key"))
    return spread_join(declared, registered, "parent_key", spread_by="id", how="left")


def resolve_links(rows: DataFrame, params: Params) -> dict[str, DataFrame]:
    """Link rows that name a parent to a registered or newly created supplier.

    ``links`` has a status per candidate (linked, low_confidence, self, cycle), ``created`` the new parent
    rows, ``suppliers`` the next version of the registry. Candidates are judged by the registry as it was, and then together: of
    links that close a ring with each other, the one of the largest id is refused.
    """
    known = resolve_parent(rows.where(F.col("parent_id").isNull()), registry=rows)
    roots = resolve_roots(rows).select(F.col("id").alias("resolved_parent_id"), F.col("root_id").alias("_root"))
    details = _optional(_optional(rows, "parent_domain"), "parent_source").select(
        "id", "normalized_name", "industry", "parent_domain", "parent_confidence", "parent_source"
    )
    judged = known.join(details, "id").join(roots, "resolved_parent_id", "left").withColumn(
        "status",
        F.when(F.col("parent_confidence") < F.lit(params.link_min_confidence).cast("decimal(3,2)"), "low_confidence")
        .when(F.col("parent_key") == F.col("normalized_name"), "self")
        .when(F.coalesce(F.col("_root") == F.col("id"), F.lit(False)), "cycle")
        .otherwise("linked"),
    )
    judged, seen = cut(judged, together=F.count_if((F.col("status") == "linked") & F.col("resolved_parent_id").isNotNull()))
    if seen["together"]:
        batch = judged.where("status = 'linked' AND resolved_parent_id IS NOT NULL").select(F.col("id").alias("request_id"), F.col("id").alias("supplier_id"), F.col("resolved_parent_id").alias("parent_id"))
        refused = link_batch(batch, rows).where("verdict = 'cycle'").select(F.col("supplier_id").alias("id"), F.lit("cycle").alias("_refused"))
        judged, _ = cut(judged.join(refused, "id", "left").withColumn("status", F.coalesce("_refused", "status")).drop("_refused"))
    wanted = judged.where((F.col("status") == "linked") & F.col("resolved_parent_id").isNull())
    fresh = wanted.groupBy("parent_key").agg(
        F.min_by(F.struct("parent_name", "parent_domain", "industry"), "id").alias("f"), F.count(F.lit(1)).alias("named_by")
    )
    top = rows.agg(F.max("id")).first()[0] or 0
    created = ranked(fresh, [F.col("parent_key").asc()], "_n").select(
        (F.col("_n") + top).alias("id"),
        "parent_key",
        title_case(F.col("f.parent_name")).alias("name"),
        registrable_domain(F.col("f.parent_domain")).alias("domain"),
        F.col("f.industry").alias("industry"),
        "named_by",
    )
    links = spread_join(judged, created.select("parent_key", F.col("id").alias("_new")), "parent_key", spread_by="id", how="left").select(
        F.col("id").alias("supplier_id"),
        "status",
        F.when(F.col("status") == "linked", F.coalesce("resolved_parent_id", "_new")).alias("parent_id"),
        "parent_name",
        F.when(F.col("parent_source") == "llm", "llm").otherwise("enrichment").alias("source"),
        (F.col("resolved_parent_id").isNull() & (F.col("status") == "linked")).alias("parent_created"),
    )
    done = links.where(F.col("status") == "linked")
    mine = done.select(F.col("supplier_id").alias("id"), F.col("parent_id").alias("_pid"), F.col("source").alias("_source"))
    above = done.select(F.col("parent_id").alias("id"), F.lit(True).alias("_above")).distinct()
    updated = _optional(rows, "parent_source").join(mine, "id", "left").join(above, "id", "left")
    updated = (
        updated.withColumn("parent_id", F.coalesce("parent_id", "_pid"))
        .withColumn("parent_source", F.coalesce("_source", "parent_source"))
        .withColumn("is_parent", F.coalesce("_above", "is_parent"))
        .drop("_pid", "_source", "_above")
    )
    born = created.select("id", "name", F.col("parent_key").alias("normalized_name"), "domain", "industry", F.lit(True).alias("is_parent"))
    return {"links": links, "created": created, "suppliers": updated.unionByName(born, allowMissingColumns=True)}


def unlink(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Detach the given suppliers; a former parent left without children stops being one."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    marked = rows.join(gone, "id", "left")
    lost = marked.where(F.col("_gone") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct().withColumn("_lost", F.lit(True))
    still = marked.where(F.col("_gone").isNull() & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct().withColumn("_still", F.lit(True))
    out = marked.join(lost, "id", "left").join(still, "id", "left")
    out = out.withColumn("is_parent", F.when(F.col("_lost"), F.coalesce("_still", F.lit(False))).otherwise(F.col("is_parent")))
    for column in [c for c in ("parent_id", "parent_name", "parent_domain", "parent_source", "parent_confidence") if c in rows.columns]:
        out = out.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
    return out.select(*rows.columns)


def hierarchy_totals(members: DataFrame) -> DataFrame:
    per = members.groupBy("cluster_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_root")).alias("subs"), F.count_if("is_orphan").alias("orphans"), F.max("in_cycle").alias("cyc")
    )
    return per.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("subs") > 0).alias("families"),
        F.sum("n").alias("suppliers"),
        F.sum("orphans").alias("orphans"),
        F.coalesce(F.max("cyc"), F.lit(False)).alias("had_cycle"),
    )


def parent_options(cluster_rows: DataFrame) -> DataFrame:
    return cluster_rows.where(F.col("subsidiary_count") > 0).select("cluster_key", "root_id", "root_name", "subsidiary_count").orderBy(F.lower("root_name"), "cluster_key")


def display_rows(members: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """Parent line then subsidiary lines per cluster, largest families first; a distributed sort."""
    heads = cluster_rows.select(
        "cluster_key", "root_name", "root_id", "subsidiary_count", F.col("total_amount").alias("cluster_total_amount")
    )
    parents = heads.select(
        "cluster_key", "root_name", "subsidiary_count", "cluster_total_amount", F.lit("parent").alias("role"), F.lit(0).alias("indent"),
        F.col("root_id").alias("supplier_id"), F.col("root_name").alias("supplier_name"),
    )
    subs = spread_join(
        members.where(~F.col("is_root")).select("id", "name", "cluster_key"),
        heads.drop("root_id"),
        "cluster_key",
        spread_by="id",
    ).select(
        "cluster_key", "root_name", "subsidiary_count", "cluster_total_amount", F.lit("subsidiary").alias("role"), F.lit(1).alias("indent"),
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"),
    )
    return parents.unionByName(subs)


def display_order() -> list[Column]:
    return [
        F.col("subsidiary_count").desc(), F.lower("root_name").asc(), F.col("root_name").asc(), F.col("cluster_key").asc(),
        F.col("indent").asc(), F.lower("supplier_name").asc(), F.col("supplier_name").asc(), F.col("supplier_id").asc(),
    ]
