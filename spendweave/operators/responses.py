"""Scorer answers: JSON text out of prose, items out of wrappers, validation of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.text import entity_key

CODE_WRAPPERS = ["results", "classifications", "suppliers", "data", "items"]
PARENT_WRAPPERS = ["results", "parents", "data", "items"]
NO_PARENT_WORDS = ["null", "none", "n/a", "na", "unknown", "independent"]


def _from_prose(text: Column) -> Column:
    """First balanced object or array of each text, minding strings.

    The helpers are local, so they travel with the job and the workers need not have this package.
    """

    def balanced(value):
        starts = [i for i in (value.find("{"), value.find("[")) if i >= 0] if value else []
        if not starts:
            return None
        begin = min(starts)
        opening = value[begin]
        closing = "}" if opening == "{" else "]"
        depth, quoted, escaped = 0, False, False
        for at in range(begin, len(value)):
            ch = value[at]
            if quoted:
                quoted, escaped = (ch != '"' or escaped), (ch == "\\" and not escaped)
            elif ch == '"':
                quoted = True
            elif ch in (opening, closing):
                depth += 1 if ch == opening else -1
                if depth == 0:
                    return value[begin : at + 1]
        return None

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(balanced)

    return F.pandas_udf(scan, "string")(text)


def json_text(responses: DataFrame, column: str = "response") -> DataFrame:
    """Adds ``json``: fences, BOM and prose removed. Only answers wrapped in prose go through Python; the
    rest, normally almost all, stay in native expressions."""
    # two passes, as text may be trimmed, unfenced, then lose its mark
    trim = lambda c: F.regexp_replace(c, r"^[\s\x{feff}]+|[\s\x{feff}]+$", "")
    bare = trim(F.regexp_replace(trim(F.col(column)), r"(?s)^```(?:json|JSON)?\s*(.*?)\s*```$", "$1"))
    staged = responses.withColumn("json", bare)
    direct = F.col("json").startswith("{") | F.col("json").startswith("[")
    plain = staged.where(F.coalesce(direct, F.lit(False)) | F.coalesce(F.col("json") == "", F.lit(True)))
    prose = staged.where(~direct & (F.col("json") != "")).withColumn("json", _from_prose("json"))
    return plain.unionByName(prose)


def parse_json(rows: DataFrame) -> DataFrame:
    """Adds ``parsed`` (variant, null when unreadable), repairing trailing commas once."""
    first = F.try_parse_json("json")
    repaired = F.try_parse_json(F.regexp_replace("json", r",\s*([}\]])", "$1"))
    return rows.withColumn("parsed", F.coalesce(first, repaired))


def answer_items(rows: DataFrame, wrappers: list[str], single: list[str]) -> DataFrame:
    """One row per answer item with its position: a bare array, the first wrapped array, or one object."""
    whole = F.expr("try_variant_get(parsed, '$', 'array<variant>')")
    wrapped = [F.expr(f"try_variant_get(parsed, '$.{name}', 'array<variant>')") for name in wrappers]
    lone = F.lit(False)
    for name in single:
        lone = lone | F.expr(f"try_variant_get(parsed, '$.{name}', 'variant')").isNotNull()
    items = F.coalesce(whole, *wrapped, F.when(lone, F.array("parsed")))
    keep = [c for c in rows.columns if c not in ("response", "json", "parsed")]
    return rows.select(*keep, F.posexplode(items).alias("item_no", "item")).withColumn("item_no", F.col("item_no") + 1)


def _text(path: str) -> Column:
    """String member; null for other kinds."""
    kind = F.expr(f"schema_of_variant(try_variant_get(item, '$.{path}', 'variant'))")
    return F.when(kind == "STRING", F.expr(f"try_variant_get(item, '$.{path}', 'string')"))


def _any(path: str) -> Column:
    return F.expr(f"try_variant_get(item, '$.{path}', 'string')")


def _unit(path: str) -> Column:
    """Number in 0..1: clamped; 0.5 when missing or unreadable; an explicit null counts as 0."""
    kind = F.expr(f"schema_of_variant(try_variant_get(item, '$.{path}', 'variant'))")
    number = F.expr(f"try_variant_get(item, '$.{path}', 'double')")
    value = F.when(kind == "VOID", F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def classification_items(items: DataFrame) -> DataFrame:
    """Validated items; those without an eight-digit code are dropped."""
    code = F.regexp_replace(F.coalesce(_any("unspsc_code"), _any("code"), F.lit("")), r"\D", "")
    reasoning = F.trim(_text("reasoning"))
    raw = F.expr("coalesce(try_variant_get(item, '$.alternatives', 'array<struct<code:string,confidence:double,description:string>>'), array())")
    return (
        items.withColumn("unspsc_code", code)
        .where(F.length("unspsc_code") == 8)
        .withColumn("_alts", F.filter(F.transform(raw, _alternative), lambda a: F.length(a["code"]) == 8))
        .withColumn("_alts", F.filter("_alts", lambda a: a["code"] != F.col("unspsc_code")))
        .select(
            *[c for c in items.columns if c != "item"],
            _text("supplier_name").alias("supplier_name"),
            "unspsc_code",
            _unit("confidence").alias("confidence"),
            F.when(F.coalesce(reasoning, F.lit("")) != "", F.substring(reasoning, 1, 1000)).otherwise("No reasoning provided by the model.").alias("reasoning"),
            F.slice(F.filter("_alts", lambda a, i: F.array_position(F.col("_alts.code"), a["code"]) == i + 1), 1, 5).alias("alternatives"),
        )
    )


def _alternative(a: Column) -> Column:
    return F.struct(
        F.regexp_replace(F.coalesce(a["code"], F.lit("")), r"\D", "").alias("code"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"], F.lit(0.5)))).alias("confidence"),
        a["description"].alias("description"),
    )


def _parent_name(c: Column) -> Column:
    text = F.trim(c)
    return F.when((text != "") & ~F.lower(text).isin(NO_PARENT_WORDS), F.substring(text, 1, 300))


def parent_items(items: DataFrame, supplier_name: str | None = None) -> DataFrame:
    """Validated parent answers. With ``supplier_name`` given, an answer naming the supplier itself is refused."""
    name = _parent_name(F.coalesce(_text("parent_name"), _text("parent"), _text("ultimate_parent")))
    domain = F.trim(F.coalesce(_text("parent_domain"), _text("domain")))
    flag = F.expr("try_variant_get(item, '$.is_subsidiary', 'boolean')")
    out = items.withColumn("parent_name", name).withColumn("parent_domain", F.when((domain != "") & (F.lower(domain) != "null"), domain))
    out = out.withColumn("confidence", _unit("confidence")).withColumn("is_subsidiary", F.col("parent_name").isNotNull() & F.coalesce(flag, F.lit(True)))
    out = out.withColumn("parent_domain", F.when(F.col("parent_name").isNotNull(), F.col("parent_domain")))
    if supplier_name:
        echo = F.col("is_subsidiary") & (entity_key(F.col("parent_name")) == entity_key(F.col(supplier_name)))
        out = out.withColumn("_echo", F.coalesce(echo, F.lit(False)))
        drop = F.col("_echo") | ~F.col("is_subsidiary")
        out = out.withColumn("parent_name", F.when(~drop, F.col("parent_name"))).withColumn("parent_domain", F.when(~drop, F.col("parent_domain")))
        out = out.withColumn("confidence", F.when(F.col("_echo"), 0.4).otherwise(F.col("confidence"))).withColumn("is_subsidiary", ~drop).drop("_echo")
    return out.drop("item")
