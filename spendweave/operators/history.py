"""Classification history: superseding writes, propagation, human corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.functions.values import as_of, clamp, is_code
from spendweave.operators.audit import audit_rows
from spendweave.operators.current import current_classification, effective_code
from spendweave.operators.forest import descendants
from spendweave.params import Params
from spendweave.session import cut, ranked, spread_join

EXTRA = {
    "reasoning": "string", "llm_model": "string", "inherited_from_supplier_id": "bigint", "corrected_by": "string",
    "inherited_from_parent": "boolean", "reviewed": "boolean", "corrected_code": "string", "corrected_at": "timestamp",
}
#: Fixed output values: the reasons that are stored with a row must read the same wherever they were written.
INHERITED_FROM, AFTER_CORRECTION, CLASSIFIED_AS = 'Inherited from parent company "', '" after a manual correction by ', "), classified as "
CORRECTED_FOR, CORRECTED_BY = "Manual correction: ", "Manually corrected by "


def numbered_rows(history_schema: T.StructType, new: DataFrame, params: Params, top: int, order: list[str] | None = None) -> DataFrame:
    """``new`` as history rows, written once: ids after ``top`` in the order given, confidence within 0 and 1, not superseded."""
    numbered = ranked(new, [F.col(c).asc() for c in (order or ["supplier_id"])], "_n").withColumn("id", F.col("_n") + top).drop("_n")
    for name, kind in EXTRA.items():
        if name not in numbered.columns:
            numbered = numbered.withColumn(name, F.lit(False if kind == "boolean" else None).cast(kind))
    numbered = numbered.withColumn("confidence", clamp(F.col("confidence"), 0, 1).cast("decimal(3,2)"))
    numbered = numbered.withColumn("superseded", F.lit(False)).withColumn("created_at", as_of(params.as_of).cast(history_schema["created_at"].dataType))
    return cut(numbered)[0]


def newest_written(numbered: DataFrame) -> DataFrame:
    """``supplier_id, _last``: the newest id of each written supplier, as a table whose size the planner knows."""
    return cut(numbered.groupBy("supplier_id").agg(F.max("id").alias("_last")))[0]


def superseded_by(rows: DataFrame, last: DataFrame) -> DataFrame:
    """``rows`` with all rows of a written supplier superseded but its newest; a superseded row stays superseded.

    Each row meets one id at most. For a batch that is small enough to be broadcast, by its measured size, the history is read once
    and not shuffled; else adaptive execution splits a supplier of very many rows.
    """
    joined = rows.join(last, "supplier_id", "left")
    return joined.withColumn("superseded", F.col("superseded") | F.coalesce(F.col("id") < F.col("_last"), F.lit(False))).drop("_last")


def write_classifications(history: DataFrame, new: DataFrame, params: Params, order: list[str] | None = None) -> DataFrame:
    """Append ``new`` (``supplier_id, unspsc_code, confidence, …``) and supersede every earlier row.

    Ids continue after the highest one in the order given. Only the newest id per written supplier is live. This gives the whole
    next version as a table; :mod:`spendweave.sources.history` writes a stored history by touched partitions.
    """
    top = history.agg(F.max("id")).first()[0] or 0
    numbered = numbered_rows(history.schema, new, params, top, order)
    return superseded_by(history.unionByName(numbered, allowMissingColumns=True), newest_written(numbered))


def propagate_codes(plan: DataFrame, results: DataFrame, params: Params, history: DataFrame | None = None, protect_reviewed: bool = True) -> DataFrame:
    """Rows inherited from each family's representative: its code, with confidence scaled down.

    Suppliers whose live row was reviewed are left alone unless ``protect_reviewed`` is off.
    """
    heirs = plan.where(F.col("mode") == "inherit").select("supplier_id", "name", "cluster_key", "root_name", "inherit_from")
    if protect_reviewed and history is not None:
        settled = current_classification(history).where("reviewed").select("supplier_id")
        heirs = heirs.join(settled, "supplier_id", "left_anti")
    coded = results.where(F.col("unspsc_code").isNotNull())
    source = coded.select(
        F.col("supplier_id").alias("inherit_from"), "unspsc_code", F.col("confidence").alias("_conf"),
        (F.col("name") if "name" in coded.columns else F.lit(None).cast("string")).alias("_from"),
        (F.col("llm_model") if "llm_model" in coded.columns else F.lit(None).cast("string")).alias("llm_model"),
    )
    joined = spread_join(heirs, source, "inherit_from", spread_by="supplier_id")
    scaled = F.col("_conf").cast("decimal(10,6)") * F.lit(params.inherit_factor).cast("decimal(3,2)")
    return joined.select(
        "supplier_id",
        "unspsc_code",
        F.greatest(F.lit(0), F.least(F.lit(1), scaled)).cast("decimal(3,2)").alias("confidence"),
        F.concat(F.lit(INHERITED_FROM), "root_name", F.lit('" ('), F.coalesce("_from", F.lit("")), F.lit(CLASSIFIED_AS), "unspsc_code", F.lit(".")).alias("reasoning"),
        "llm_model",
        F.lit(True).alias("inherited_from_parent"),
        F.col("inherit_from").alias("inherited_from_supplier_id"),
        F.lit(False).alias("reviewed"),
    )


def apply_corrections(
    requests: DataFrame, suppliers: DataFrame, history: DataFrame, taxonomy: DataFrame, params: Params, after_id: int = 0
) -> dict[str, DataFrame]:
    """A batch of human corrections ``(request_id, supplier_id, code, reason, actor, apply_to_subsidiaries)``.

    Each gives a reviewed row at confidence 1, and one at 0.95 per descendant when asked to propagate. Where several corrections
    reach a supplier, its own one is live, else that of the nearest corrected parent; of equal ones the one with the largest
    request_id. Codes outside the taxonomy are kept and flagged; requests without a valid code or supplier are left out.

    ``history`` is the next version, ``corrections`` has a record per request with the row it wrote (ids follow ``after_id``),
    ``scope`` every touched supplier as a row, ``suppliers`` the registry with corrected parents flagged, ``audit`` an event per
    request and one per descendant.
    """
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    asked = requests.where(is_code(F.col("code"))).withColumn("code", F.trim("code")).join(names, "supplier_id")
    touched = history.join(asked.select("supplier_id").distinct(), "supplier_id", "left_semi")
    before = current_classification(touched).select("supplier_id", effective_code().alias("original_code"))
    known = taxonomy.select("code", F.lit(True).alias("_known")).distinct()
    asked = spread_join(asked.join(before, "supplier_id", "left"), known, "code", spread_by="request_id", how="left")
    asked, _ = cut(asked.withColumn("code_known", F.coalesce("_known", F.lit(False))).drop("_known"))
    wide = asked.where("apply_to_subsidiaries").select(F.col("supplier_id").alias("seed_id"))
    below = descendants(wide, suppliers.select("id", "parent_id")).withColumnRenamed("id", "heir_id")
    heirs = asked.where("apply_to_subsidiaries").join(below, F.col("supplier_id") == F.col("seed_id")).drop("seed_id")
    moment, given = as_of(params.as_of), F.coalesce(F.trim("reason"), F.lit(""))
    own_rows = asked.select(
        "request_id", "supplier_id", F.col("code").alias("unspsc_code"), F.lit(1).cast("decimal(3,2)").alias("confidence"),
        F.when(given != "", F.concat(F.lit(CORRECTED_FOR), given)).otherwise(F.concat(F.lit(CORRECTED_BY), "actor", F.lit("."))).alias("reasoning"),
        F.lit(False).alias("inherited_from_parent"), F.lit(None).cast("bigint").alias("inherited_from_supplier_id"),
        F.col("code").alias("corrected_code"), F.col("actor").alias("corrected_by"), moment.cast("timestamp").alias("corrected_at"), F.lit(0).cast("bigint").alias("level"),
    )
    heir_rows = heirs.select(
        "request_id", F.col("heir_id").alias("supplier_id"), F.col("code").alias("unspsc_code"),
        F.lit(params.correction_inherit_confidence).cast("decimal(3,2)").alias("confidence"),
        F.concat(F.lit(INHERITED_FROM), "supplier_name", F.lit(AFTER_CORRECTION), "actor", F.lit(".")).alias("reasoning"),
        F.lit(True).alias("inherited_from_parent"), F.col("supplier_id").alias("inherited_from_supplier_id"),
        F.lit(None).cast("string").alias("corrected_code"), F.lit(None).cast("string").alias("corrected_by"), F.lit(None).cast("timestamp").alias("corrected_at"), "level",
    )
    rows = own_rows.unionByName(heir_rows).withColumn("reviewed", F.lit(True)).withColumn("llm_model", F.lit("human"))
    top = history.agg(F.max("id")).first()[0] or 0
    numbered = numbered_rows(history.schema, rows.withColumn("_near", -F.col("level")), params, top, ["_near", "request_id", "supplier_id"]).drop("_near")
    new_history = superseded_by(history.unionByName(numbered, allowMissingColumns=True), newest_written(numbered))
    counts = numbered.groupBy("request_id").agg(F.count(F.lit(1)).alias("affected_count"), F.max(F.when(F.col("level") == 0, F.col("id"))).alias("classification_id"))
    records = ranked(asked.join(counts, "request_id"), [F.col("request_id").asc()], "_n").select(
        (F.col("_n") + after_id).alias("id"), "request_id", "supplier_id", "classification_id", F.when(is_code(F.col("original_code")), F.col("original_code")).alias("original_code"),
        F.col("code").alias("corrected_code"), "reason", F.col("actor").alias("corrected_by"), (F.col("affected_count") > 1).alias("applied_to_subsidiaries"),
        "affected_count", moment.cast("timestamp").alias("created_at"), "code_known",
    )
    records, _ = cut(records)
    scope = numbered.select("request_id", "supplier_id", "unspsc_code", "inherited_from_supplier_id", "level").join(records.select("request_id", F.col("id").alias("correction_id"), "corrected_by"), "request_id")
    parents = scope.where("level > 0").select(F.col("inherited_from_supplier_id").alias("id"), F.lit(True).alias("_above")).distinct()
    flagged = suppliers.join(parents, "id", "left")
    if "updated_at" in suppliers.columns:
        flagged = flagged.withColumn("updated_at", F.when(F.col("_above"), moment.cast(suppliers.schema["updated_at"].dataType)).otherwise(F.col("updated_at")))
    if "is_parent" in suppliers.columns:
        flagged = flagged.withColumn("is_parent", F.coalesce("_above", "is_parent"))
    renamed = scope.select(F.when(F.col("level") == 0, "corrected").otherwise("propagated").alias("action"), "supplier_id", F.col("unspsc_code").alias("code"), F.col("inherited_from_supplier_id").alias("from"), "corrected_by")
    return {
        "history": new_history, "corrections": records, "scope": scope.select("correction_id", "request_id", "supplier_id"), "suppliers": flagged.select(*suppliers.columns),
        "audit": audit_rows(renamed, "classification", "supplier_id", F.col("action"), ["code", "from", "corrected_by"], "human", params),
    }


def cleared_ids(history: DataFrame, suppliers: DataFrame) -> DataFrame:
    """``id, _clear`` of the live rows of the given suppliers; only their own rows are grouped."""
    ids = suppliers.select(F.col("id").alias("supplier_id")).distinct()
    return current_classification(history.join(ids, "supplier_id", "left_semi")).select("id", F.lit(True).alias("_clear"))


def cleared(rows: DataFrame, ids: DataFrame) -> DataFrame:
    out = rows.join(ids, "id", "left").withColumn("reviewed", F.when(F.col("_clear"), False).otherwise(F.col("reviewed")))
    for column in [c for c in ("corrected_code", "corrected_by", "corrected_at") if c in rows.columns]:
        out = out.withColumn(column, F.when(F.col("_clear").isNull(), F.col(column)))
    return out.select(*rows.columns)


def clear_correction(history: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Undo the correction on the live row of the given suppliers: no corrected code, not reviewed.

    The touched ids are written first, so the history is joined by their measured size: read once, and not shuffled for a batch.
    """
    return cleared(history, cut(cleared_ids(history, suppliers))[0])
