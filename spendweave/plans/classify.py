"""Classification run: plan, batch, score, validate, write, propagate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.values import route_tier
from spendweave.operators import batches as b
from spendweave.operators import candidates, responses
from spendweave.operators.audit import audit_rows
from spendweave.operators.candidates import candidate_codes, vocabulary
from spendweave.operators.current import few_shot_merge, few_shot_recent, supplier_list
from spendweave.operators.families import classification_plan, family_members
from spendweave.operators.history import propagate_codes, write_classifications
from spendweave.params import Params
from spendweave.session import cut, dealt

CANDIDATES = 15  # codes that a prompt lists
UNKNOWN_NOTE = " not found in the local UNSPSC taxonomy; confidence reduced)"


def work_items(members: DataFrame, plan: DataFrame, params: Params, only_missing: bool = True, preserve_reviewed: bool = True, strategy: str = "tiered") -> DataFrame:
    """Suppliers to score: family representatives and singles, with their tier."""
    own = members.withColumn("_named", F.coalesce("parent_name", F.lit("")) != "").drop("name", "cluster_key", "parent_name")
    todo = plan.where(F.col("mode") != "inherit").join(own, plan["supplier_id"] == own["id"])
    if preserve_reviewed:
        todo = todo.where(~F.coalesce("reviewed", F.lit(False)))
    if only_missing:
        todo = todo.where(F.col("classification_id").isNull())
    amount = F.when(F.col("mode") == "parent", F.col("cluster_total")).otherwise(F.coalesce("total_amount", F.lit(0)))
    return todo.withColumn("model", route_tier(F.col("is_parent"), amount, F.col("parent_id").isNotNull() | F.col("_named"), params, strategy))


def _validated(answered: DataFrame, taxonomy: DataFrame, params: Params) -> DataFrame:
    rows = answered.withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))
    rows = candidates.cap_unknown(candidates.validate_codes(rows, taxonomy, spread_by="supplier_id"), params)
    note = F.concat("reasoning", F.lit(" (code "), "unspsc_code", F.lit(UNKNOWN_NOTE))
    return rows.select(
        "supplier_id", "name", F.col("valid_code").alias("unspsc_code"), "confidence", F.when(F.col("code_unknown"), note).otherwise(F.col("reasoning")).alias("reasoning"),
        F.col("model").alias("llm_model"), "alternatives", "code_unknown",
    )


def _items(answers: DataFrame) -> DataFrame:
    """The validated items of written answers. Texts are few bytes and much work to parse, so they are dealt, and parsed once."""
    texts = responses.json_text(dealt(answers, "model", "batch_no"))
    return cut(responses.classification_items(responses.answer_items(responses.parse_json(texts), responses.CODE_WRAPPERS, ["unspsc_code", "code"])))[0]


def _subsidiaries(suppliers: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """``id, subsidiary_names``: the first names of direct children, a few per parent before anything is gathered."""
    children = suppliers.select(F.col("parent_id").alias("id"), "name").where("id is not null").join(asked.select("id"), "id", "left_semi")
    first = Window.partitionBy("id").orderBy("name")
    few = children.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return few.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("subsidiary_names"))


def classify_run(
    suppliers: DataFrame,
    history: DataFrame,
    taxonomy: DataFrame,
    params: Params,
    score: Callable,
    examples: str = "",
    only_missing: bool = True,
    protect_reviewed: bool = True,
    ids: DataFrame | None = None,
    limit: int | None = None,
    max_batches: int | None = None,
    strategy: str = "tiered",
    partitions: int | None = None,
    corrections: DataFrame | None = None,
    defaults: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Score what the family plan asks for and write the results to the history.

    A batch's prompt lists the codes that fit its suppliers together, a single one those of the supplier and its known
    subsidiaries. ``corrections`` (and ``defaults``) give the few-shot examples, unless ``examples`` is given as text.

    ``max_batches`` is a budget: it limits the rows that are batched, before any call is made. A supplier
    asked for alone that only inherits is reported as skipped. Suppliers a batch answer leaves out are asked
    again one by one.
    """
    taxonomy, _ = cut(taxonomy.repartition("code"))
    members = family_members(supplier_list(suppliers, history, taxonomy))
    plan, _ = cut(classification_plan(members))
    work = work_items(members, plan, params, only_missing, protect_reviewed, strategy)
    asked = ids.select(F.col("id").alias("supplier_id")).distinct() if ids is not None else None
    if asked is not None:
        work = work.join(asked, "supplier_id", "left_semi")
    most = min([n for n in (limit, max_batches * params.batch_size if max_batches else None) if n] or [0])
    if most:
        work = work.orderBy(F.when(F.col("mode") == "parent", 0).otherwise(1), F.lower("root_name"), "id").limit(most)
    fields = ["id", "name", "domain", "industry", "naics", "sic", "description", "country", "parent_name", "parent_domain", "model", "mode"]
    for field in ("sic", "parent_domain"):
        work = work if field in work.columns else work.withColumn(field, F.lit(None).cast("string"))
    size = params.batch_size
    batches, _ = cut(b.request_batches(work.select(*fields), size))
    if corrections is not None and not examples:
        recent = few_shot_recent(corrections, suppliers)
        examples = b.example_text(few_shot_merge(recent, defaults) if defaults is not None else recent)
    tokens, _ = cut(vocabulary(taxonomy, CANDIDATES))
    fitting = b.batch_candidates(batches, taxonomy, CANDIDATES, tokens)
    answers, _ = cut(b.score_batches(b.batch_prompts(batches, size, examples, fitting), score, partitions))
    answered, missing = b.align_results(batches, _items(answers), size)
    answered, _ = cut(answered.select("supplier_id", "name", "model", "unspsc_code", "confidence", "reasoning", "alternatives"))
    missing, left = cut(missing, rows=F.count(F.lit(1)))
    if left["rows"]:
        alone = missing.join(b.candidate_lines(candidate_codes(missing, taxonomy, CANDIDATES, tokens), taxonomy).withColumnRenamed("supplier_id", "id"), "id", "left")
        again = b.single_prompts(alone.join(_subsidiaries(suppliers, missing), "id", "left"), examples).join(missing.select("id", "model"), "id").select("model", F.col("id").alias("batch_no"), "prompt")
        second, _ = cut(b.score_batches(again, score, partitions))
        retried = _items(second).where(F.col("item_no") == 1).join(missing.select(F.col("id").alias("batch_no"), "name", "model"), ["model", "batch_no"])
        answered = answered.unionByName(retried.select(F.col("batch_no").alias("supplier_id"), "name", "model", "unspsc_code", "confidence", "reasoning", "alternatives"))
    scored, _ = cut(_validated(answered, taxonomy, params))
    # the list view knows whose live row was reviewed, so the history isn't read for it again
    open_plan = plan.join(members.where("reviewed").select(F.col("id").alias("supplier_id")), "supplier_id", "left_anti") if protect_reviewed else plan
    heirs, _ = cut(propagate_codes(open_plan, scored, params, protect_reviewed=False))
    new = scored.drop("name", "code_unknown").withColumn("kind", F.lit(0)).unionByName(heirs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    written = write_classifications(history, new.drop("alternatives") if "alternatives" not in history.columns else new, params, ["kind", "supplier_id"]).drop("kind")
    status = (
        scored.select("supplier_id", F.lit("classified").alias("status"), "confidence")
        .unionByName(heirs.select("supplier_id", F.lit("inherited").alias("status"), "confidence"))
        .unionByName(batches.select(F.col("id").alias("supplier_id")).join(scored.select("supplier_id"), "supplier_id", "left_anti").select("supplier_id", F.lit("failed").alias("status"), F.lit(None).cast("decimal(3,2)").alias("confidence")))
    )
    if asked is not None:
        quiet = asked.join(status.select("supplier_id"), "supplier_id", "left_anti")
        status = status.unionByName(quiet.select("supplier_id", F.lit("skipped").alias("status"), F.lit(None).cast("decimal(3,2)").alias("confidence")))
    summary = status.groupBy("status").agg(
        F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("confidence") < params.confidence_threshold).alias("low_confidence"), F.sum("confidence").alias("confidence_sum")
    )
    audit = audit_rows(status.where(F.col("status").isin("classified", "inherited")), "classification", "supplier_id", F.col("status"), ["confidence"], "job", params)
    return {"history": written, "items": status, "summary": summary, "audit": audit, "scored": scored}
