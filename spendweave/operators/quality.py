"""Data-quality checks. Each returns rows ``check_name, ok, bad_rows`` or a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.params import Params


def _row(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), (bad == 0).alias("ok"), bad.cast("long").alias("bad_rows"))


def taxonomy_checks(taxonomy: DataFrame, params: Params) -> DataFrame:
    """Size, segments, and presence of the known code, from one scan."""
    stats = taxonomy.agg(
        F.count(F.lit(1)).alias("codes"), F.count_distinct("segment_code").alias("segments"), F.count_if(F.col("code") == params.known_code).alias("known")
    )
    checks = F.array(
        F.struct(F.lit("size").alias("check_name"), (F.col("codes") > params.taxonomy_min_codes).alias("ok"), F.col("codes").alias("measured")),
        F.struct(F.lit("segments").alias("check_name"), (F.col("segments") > 0).alias("ok"), F.col("segments").alias("measured")),
        F.struct(F.lit("known_code").alias("check_name"), (F.col("known") == 1).alias("ok"), F.col("known").alias("measured")),
    )
    return stats.select(F.inline(checks))


def required_tables(spark: SparkSession, present: list[str], required: list[str]) -> DataFrame:
    return spark.createDataFrame([(name, name in present) for name in required], "table_name string, present boolean")


def unique_checks(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per named key, how many key values occur more than once."""
    out = None
    for name, (df, key) in tables.items():
        dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
        row = _row(dup, name, F.col("bad"))
        out = row if out is None else out.unionByName(row)
    return out


def _unresolved(many: DataFrame, key: str, one: DataFrame, one_key: str, name: str) -> DataFrame:
    """Rows whose key is not in ``one``; keys are counted before the join, so a hot key is one row."""
    counted = many.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    missing = counted.join(one.select(F.col(one_key).alias("k")), "k", "left_anti")
    return _row(missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad")), name, F.col("bad"))


def reference_checks(suppliers: DataFrame, history: DataFrame, taxonomy: DataFrame) -> DataFrame:
    coded = history.withColumn("code", F.coalesce("corrected_code", "unspsc_code"))
    return (
        _unresolved(suppliers, "parent_id", suppliers, "id", "suppliers.parent_id")
        .unionByName(_unresolved(history, "supplier_id", suppliers, "id", "classifications.supplier_id"))
        .unionByName(_unresolved(coded, "code", taxonomy, "code", "classifications.code"))
    )


def consistency_checks(rows: DataFrame) -> DataFrame:
    """List-view consistency: ids unique, effective code follows the correction, child counts add up."""
    wrong_code = ~F.col("effective_code").eqNullSafe(F.coalesce("corrected_code", "unspsc_code"))
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    codes = rows.agg(F.count_if(wrong_code).alias("bad"))
    seen = rows.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    children = (
        rows.join(seen, "id", "left").agg(F.count_if(F.coalesce("n", F.lit(0)) != F.col("subsidiary_count")).alias("bad"))
    )
    flags = rows.agg(F.count_if((F.col("subsidiary_count") > 0) & ~F.col("is_parent")).alias("bad"))
    return (
        _row(ids, "unique_ids", F.col("bad"))
        .unionByName(_row(codes, "effective_code", F.col("bad")))
        .unionByName(_row(children, "child_counts", F.col("bad")))
        .unionByName(_row(flags, "parent_flags", F.col("bad")))
    )


def table_profile(suppliers: DataFrame, history: DataFrame, taxonomy: DataFrame, audit: DataFrame) -> DataFrame:
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")

    classified = history.where(~F.col("superseded")).agg(F.count_distinct("supplier_id").alias("n")).select(F.lit("classified_suppliers").alias("measure"), "n")
    parents = suppliers.agg(F.count_if("is_parent").alias("n")).select(F.lit("parents").alias("measure"), "n")
    parts = [count(suppliers, "suppliers"), count(history, "classifications"), count(taxonomy, "taxonomy"), count(audit, "audit_log"), parents, classified]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


