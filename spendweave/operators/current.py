"""Current state of suppliers: classification history reduced to one row, list view, work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.functions.text import entity_key
from spendweave.functions.values import is_code
from spendweave.operators.forest import descendant_counts
from spendweave.session import cut, spread_join


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns, adding missing ones as typed nulls."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def effective_code():
    return F.coalesce(F.col("corrected_code"), F.col("unspsc_code"))


def current_classification(history: DataFrame) -> DataFrame:
    """Newest live row per supplier in one partially aggregated pass (no join back, no window)."""
    fields = [c for c in history.columns if c != "supplier_id"]
    return (
        history.where(~F.col("superseded"))
        .groupBy("supplier_id")
        .agg(F.max_by(F.struct(*fields), "id").alias("row"))
        .select("supplier_id", "row.*")
    )


def child_counts(suppliers: DataFrame) -> DataFrame:
    return suppliers.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("child_count"))


def supplier_list(suppliers: DataFrame, history: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Suppliers with current classification, taxonomy names of the effective code, and child count.

    What grows with the data is sorted and merged: a compressed table that passes for small would be held whole by every task.
    Adaptive execution splits a code shared by many suppliers.
    """
    current = current_classification(history).select(
        F.col("supplier_id").alias("_supplier"),
        F.col("id").alias("classification_id"),
        "unspsc_code",
        "corrected_code",
        effective_code().alias("effective_code"),
        "confidence",
        "reviewed",
        "inherited_from_parent",
        *[F.col(c) if c in history.columns else F.lit(None).cast("string").alias(c) for c in ("reasoning", "llm_model")],
    )
    names = taxonomy.select(
        F.col("code").alias("taxonomy_code"), "segment", "segment_code", "family", F.col("class").alias("class_name"), "commodity"
    )
    children = child_counts(suppliers).withColumnRenamed("parent_id", "_parent")
    return (
        suppliers.join(current.hint("merge"), F.col("id") == F.col("_supplier"), "left")
        .join(children.hint("merge"), F.col("id") == F.col("_parent"), "left")
        .join(names.hint("merge"), F.col("effective_code") == F.col("taxonomy_code"), "left")
        .withColumn("subsidiary_count", F.coalesce("child_count", F.lit(0)))
        .drop("_supplier", "_parent", "child_count")
    )


def needs_classification(suppliers: DataFrame, history: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """Suppliers without a live classification, largest spend first (unknown spend leads)."""
    live = history.where(~F.col("superseded")).select(F.col("supplier_id").alias("id"))
    rows = suppliers if force else suppliers.join(live, "id", "left_anti")
    return _top(rows, limit)


def _top(rows: DataFrame, limit: int | None) -> DataFrame:
    rows = rows.orderBy(F.col("total_amount").desc_nulls_first(), F.col("id"))
    return rows.limit(limit) if limit else rows


def classified_suppliers(suppliers: DataFrame, history: DataFrame) -> DataFrame:
    return suppliers.join(history.select(F.col("supplier_id").alias("id")), "id", "left_semi")


def recent_corrections(corrections: DataFrame, suppliers: DataFrame, limit: int | None = None) -> DataFrame:
    """Corrections with their supplier, newest first. A limit is taken before the join would grow the rows."""
    named = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "domain", "industry", "naics")
    order = [F.col("created_at").desc(), F.col("id").desc()]
    rows = corrections.join(named, "supplier_id").orderBy(*order)
    return rows.limit(limit) if limit else rows


def few_shot_recent(corrections: DataFrame, suppliers: DataFrame, limit: int = 6) -> DataFrame:
    """Newest valid correction per entity key among the newest ``3 * limit``."""
    rows = recent_corrections(corrections, suppliers, limit * 3).where(is_code(F.col("corrected_code")))
    best = (
        rows.groupBy(entity_key(F.col("supplier_name")).alias("key"))
        .agg(
            F.max_by(
                F.struct("supplier_name", "domain", "industry", "naics", "corrected_code", "reason", "created_at", "id"),
                F.struct("created_at", "id"),
            ).alias("r")
        )
        .select("r.*")
    )
    return (
        best.orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
        .select(
            "supplier_name",
            "domain",
            "industry",
            "naics",
            F.col("corrected_code").alias("unspsc_code"),
            F.lit(0.99).alias("confidence"),
            F.when(F.coalesce(F.trim("reason"), F.lit("")) != "", F.concat(F.lit("Human correction: "), F.trim("reason")))
            .otherwise("Human-corrected classification.")
            .alias("reasoning"),
            F.struct("created_at", "id").alias("newest"),
        )
    )


def few_shot_merge(recent: DataFrame, defaults: DataFrame, limit: int = 8) -> DataFrame:
    """Corrections (newest first) ahead of the defaults, one example per name."""
    cols = ["supplier_name", "domain", "industry", "naics", "unspsc_code", "confidence", "reasoning"]
    first = recent.withColumn("_p", F.struct(F.lit(0).alias("a"), (-F.unix_micros(F.col("newest.created_at").cast("timestamp"))).alias("b"), (-F.col("newest.id")).alias("c")))
    second = defaults.withColumn("_p", F.struct(F.lit(1).alias("a"), F.col("position").cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
    both = first.select(*cols, "_p").unionByName(second.select(*cols, "_p"))
    both = both.where(is_code(F.col("unspsc_code")) & (F.trim("supplier_name") != ""))
    return (
        both.groupBy(F.lower(F.trim("supplier_name")).alias("_k"))
        .agg(F.min_by(F.struct(*cols, "_p"), "_p").alias("r"))
        .select("r.*")
        .orderBy("_p")
        .limit(limit)
        .select(*cols, F.col("_p").alias("priority"))
    )


def supplier_history(history: DataFrame, keep: int = 50) -> DataFrame:
    """Newest ``keep`` classification rows per supplier; the limit is applied before the shuffle too."""
    newest = Window.partitionBy("supplier_id").orderBy(F.col("id").desc())
    return (
        history.withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= keep)
        .withColumn("code", effective_code())
    )


def supplier_relatives(suppliers: DataFrame, ids: DataFrame, keep: int = 50) -> DataFrame:
    """``id, relation, position, relative_id, name, total_amount`` for each supplier of ``ids``: its parent, and its direct
    children, the largest first and at most ``keep``; the limit is applied before the shuffle too."""
    wanted = ids.select("id").distinct()
    about = suppliers.select(F.col("id").alias("relative_id"), "name", "total_amount", F.col("parent_id").alias("_up"))
    parents = suppliers.join(wanted, "id", "left_semi").select("id", F.col("parent_id").alias("relative_id")).join(about.drop("_up"), "relative_id")
    parents = parents.select("id", F.lit("parent").alias("relation"), F.lit(1).alias("position"), "relative_id", "name", "total_amount")
    largest = Window.partitionBy("id").orderBy(F.col("total_amount").desc_nulls_last(), "relative_id")
    children = about.where("_up is not null").withColumnRenamed("_up", "id").join(wanted, "id", "left_semi")
    children = children.withColumn("position", F.row_number().over(largest)).where(F.col("position") <= keep)
    return parents.unionByName(children.select("id", F.lit("child").alias("relation"), "position", "relative_id", "name", "total_amount"))


def supplier_detail(suppliers: DataFrame, history: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, parent_id, parent, child_count, descendants, classifications, code`` for each supplier of ``ids``.

    Descendants are counted for all rows at once, from the numbers of one walk, not by going down from each supplier.
    """
    wanted, _ = cut(ids.select("id").distinct())
    parents = suppliers.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    own = suppliers.select("id", "parent_id").join(wanted, "id", "left_semi")
    told = history.join(wanted.withColumnRenamed("id", "supplier_id"), "supplier_id", "left_semi").groupBy(F.col("supplier_id").alias("id")).agg(
        F.count(F.lit(1)).alias("classifications"), F.max_by(effective_code(), F.when(~F.col("superseded"), F.col("id"))).alias("code")
    )
    children = child_counts(suppliers).withColumnRenamed("parent_id", "id")
    return (
        spread_join(own, parents, "parent_id", spread_by="id", how="left").join(children, "id", "left").join(descendant_counts(suppliers), "id").join(told, "id", "left")
        .select("id", "parent_id", "parent", F.coalesce("child_count", F.lit(0)).alias("child_count"), "descendants", F.coalesce("classifications", F.lit(0)).alias("classifications"), "code")
    )


def newest_of(rows: DataFrame, key: str, ids: DataFrame, keep: int, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The newest ``keep`` rows of each id of ``ids(id)`` with their position: a supplier's corrections, or its audit events.

    The limit is applied before the shuffle too, so a supplier of very many rows sends no more than that from each task.
    """
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    asked = rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")
    return asked.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= keep)


def last_event(audit: DataFrame, action: str, member: str | None = None, value: str | None = None) -> DataFrame:
    """Latest event of one action with its payload, optionally only those whose details have ``member = value``."""
    rows = audit.where(F.col("action") == action)
    if member:
        rows = rows.where(F.get_json_object("details", f"$.{member}") == value)
    return rows.groupBy("action").agg(F.max("created_at").alias("at"), F.max_by("details", F.struct("created_at", "id")).alias("details"))
