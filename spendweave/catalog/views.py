"""The given tables shaped as lake tables: the same projections for Spark and for the checking SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.operators.current import supplier_list
from spendweave.session import cut, prepare

TX = """
SELECT l_orderkey, l_linenumber, l_suppkey + 1 AS supplier_no,
       CASE l_linenumber % 4 WHEN 0 THEN concat(upper(s_name), ', INC.')
                             WHEN 1 THEN concat(s_name, ' Co., Ltd')
                             WHEN 2 THEN concat('  ', s_name, '   GmbH ')
                             ELSE s_name END AS raw_name,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
       l_shipdate AS tx_ts
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
"""

SPEND = """
SELECT l_suppkey + 1 AS supplier_no, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_amount, COUNT(*) AS transaction_count,
       MIN(l_shipdate) AS first_ts, MAX(l_shipdate) AS last_ts
FROM lineitem GROUP BY l_suppkey + 1
"""

SUPPLIERS = """
SELECT s_suppkey + 1 AS id, s_name AS name, lower(s_name) AS normalized_name,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') END AS domain,
       r_name AS industry, CAST(330000 + s_suppkey % 1000 AS VARCHAR(8)) AS naics,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat(r_name, ' wholesale of widget, bolt and ring supplies') END AS description,
       n_name AS country,
       CAST(sp.total_amount AS DECIMAL(18,2)) AS total_amount,
       COALESCE(sp.transaction_count, 0) AS transaction_count, 'USD' AS currency,
       CASE WHEN s_suppkey % 10 IN (1,2,3) THEN s_suppkey - s_suppkey % 10 + 1
            WHEN s_suppkey % 10 = 4 THEN s_suppkey
            WHEN s_suppkey % 10 = 5 THEN 1000000 + s_suppkey
            WHEN s_suppkey % 10 = 8 THEN s_suppkey + 2
            WHEN s_suppkey % 10 = 9 THEN s_suppkey
            ELSE NULL END AS parent_id,
       CASE WHEN s_suppkey % 10 IN (6,7) THEN concat('Holding ', r_name, ' Inc') ELSE NULL END AS parent_name,
       s_suppkey % 10 IN (0,3,8,9) AS is_parent,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN sp.first_ts ELSE sp.last_ts END AS enriched_at,
       s_suppkey % 9 = 0 AS stale,
       CASE WHEN s_suppkey % 11 = 0 THEN 'timeout' ELSE NULL END AS last_enrich_error,
       CASE WHEN s_suppkey % 10 IN (6,7) THEN CAST((s_suppkey % 100) / 100.0 AS DECIMAL(3,2)) ELSE NULL END AS parent_confidence,
       CASE s_suppkey % 10 WHEN 6 THEN 'enrichment' WHEN 7 THEN 'llm' ELSE NULL END AS parent_source,
       sp.first_ts AS created_at, sp.last_ts AS updated_at
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN v_spend sp ON sp.supplier_no = s_suppkey + 1
"""

TAXONOMY = """
SELECT code, substr(code,1,2) AS segment_code, concat('Segment ', substr(code,1,2)) AS segment,
       substr(code,1,4) AS family_code, concat('Family ', substr(code,1,4)) AS family,
       substr(code,1,6) AS class_code, p_type AS class, p_name AS commodity, p_partkey
FROM (SELECT CAST(10000000 + (p_partkey * 7919) % 90000000 AS VARCHAR(8)) AS code, p_type, p_name, p_partkey FROM part) p
"""

CLASSIFICATIONS = """
SELECT o_orderkey + 1 AS id,
       o_custkey % (SELECT COUNT(*) FROM supplier) + 1 AS supplier_id,
       CAST(10000000 + ((o_orderkey % (SELECT COUNT(*) FROM part)) * 7919) % 90000000 AS VARCHAR(8)) AS unspsc_code,
       CAST((o_orderkey % 101) / 100.0 AS DECIMAL(3,2)) AS confidence,
       o_orderkey % 6 = 0 AS inherited_from_parent,
       o_orderpriority = '1-URGENT' AS reviewed,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0
            THEN CAST(10000000 + ((o_custkey % (SELECT COUNT(*) FROM part)) * 7919) % 90000000 AS VARCHAR(8)) END AS corrected_code,
       o_orderstatus <> 'P' OR o_custkey % 5 = 0 AS superseded,
       o_orderdate AS created_at
FROM orders
"""

AUDIT = """
SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'sync' WHEN 'purchase' THEN 'report' WHEN 'signup' THEN 'supplier'
       ELSE 'classification' END AS entity, user_id AS entity_id, event_type AS action, props AS details,
       concat('user_', CAST(user_id AS VARCHAR(20))) AS actor, ts AS created_at FROM events
"""

CALLS = """
SELECT event_type AS model, ts, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(floor(value * 10) AS BIGINT) AS completion_tokens,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures FROM events
"""

PAYLOADS = """
SELECT id, CASE id % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'tech' ELSE 'directory' END AS provider,
       CASE id % 3
         WHEN 0 THEN concat('{"company":{"website":"https://www.', COALESCE(domain,'none.example.org'), '/about","industry":{"name":"', industry, '","code":"33-', CAST(id AS VARCHAR(20)), '"},"country":"', country, '"}}')
         WHEN 1 THEN concat('{"data":{"domain":"', COALESCE(domain,''), '","parent":"Holding ', industry, '","technologies":["a","b","', country, '"]}}')
         ELSE concat('{"url":"https://www.linkedin.com/company/s', CAST(id AS VARCHAR(20)), '","industries":["', industry, '","Trade"],"country_code":"US,AU,CA"}') END AS payload
FROM v_suppliers
"""

CORRECTIONS = """
SELECT id, supplier_id, id AS classification_id, unspsc_code AS original_code, corrected_code,
       CASE WHEN id % 3 = 0 THEN NULL ELSE concat('checked ', CAST(id % 7 AS VARCHAR(20))) END AS reason,
       concat('user_', CAST(id % 50 AS VARCHAR(20))) AS corrected_by, created_at
FROM v_classifications WHERE corrected_code IS NOT NULL
"""

REPORTS = """
SELECT o_orderkey + 1 AS id, concat('Report ', CAST(o_orderkey AS VARCHAR(20))) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'pdf' ELSE 'csv' END AS format,
       o_orderkey % 500 AS row_count, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS created_at FROM orders
"""

CACHE = """
SELECT concat(CASE id % 3 WHEN 0 THEN 'tech:' ELSE 'generic:' END, normalized_name) AS cache_key, name AS supplier_name,
       CASE id % 3 WHEN 0 THEN 'tech' ELSE 'generic' END AS provider, concat('{"n":', CAST(id AS VARCHAR(20)), '}') AS payload,
       id % 4 AS credits_used, id % 5 AS hit_count, first_ts AS created_at,
       CASE WHEN id % 10 = 0 THEN NULL WHEN id % 2 = 0 THEN last_ts + INTERVAL 30 DAY ELSE last_ts - INTERVAL 90 DAY END AS expires_at
FROM (SELECT v.*, sp.first_ts, sp.last_ts FROM v_suppliers v JOIN v_spend sp ON sp.supplier_no = v.id) c
"""

PROJECTIONS = {
    "v_tx": TX, "v_spend": SPEND, "v_suppliers": SUPPLIERS, "v_taxonomy": TAXONOMY, "v_classifications": CLASSIFICATIONS, "v_audit": AUDIT,
    "v_calls": CALLS, "v_payloads": PAYLOADS, "v_corrections": CORRECTIONS, "v_reports": REPORTS, "v_cache": CACHE,
}

# Current classification and list view, for the checking SQL only (Spark uses the operators).
LIST = """
v_current AS (SELECT c.* FROM v_classifications c JOIN (SELECT supplier_id, max(id) AS id FROM v_classifications WHERE NOT superseded GROUP BY supplier_id) m ON m.id = c.id),
v_list AS (
  SELECT s.*, c.id AS classification_id, c.unspsc_code, c.corrected_code, coalesce(c.corrected_code, c.unspsc_code) AS effective_code, c.confidence,
         c.reviewed, c.inherited_from_parent, t.segment, t.segment_code, t.family, t.class AS class_name, t.commodity, coalesce(k.n, 0) AS subsidiary_count
  FROM v_suppliers s LEFT JOIN v_current c ON c.supplier_id = s.id
  LEFT JOIN v_taxonomy t ON t.code = coalesce(c.corrected_code, c.unspsc_code)
  LEFT JOIN (SELECT parent_id, count(*) AS n FROM v_suppliers WHERE parent_id IS NOT NULL GROUP BY parent_id) k ON k.parent_id = s.id)
"""

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]


def with_views(sql: str, *extra: str) -> str:
    """Checking SQL with the projections (and named extra CTEs) in front."""
    parts = [f"{name} AS ({text})" for name, text in PROJECTIONS.items()] + [LIST] + list(extra)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    """The projections as DataFrames over one folder of the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            path = f"{self.folder}/{name}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            self._read[name] = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        return self._read[name]

    def sql(self, text: str) -> DataFrame:
        used = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text))
        for name in used & set(BASE_TABLES):
            self.base(name).createOrReplaceTempView(name)
        for name in used & set(PROJECTIONS):
            getattr(self, name[2:]).createOrReplaceTempView(name)
        return self.spark.sql(text)

    @cached_property
    def tx(self) -> DataFrame:
        return self.sql(TX)

    @cached_property
    def spend(self) -> DataFrame:
        return self.sql(SPEND)

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.sql(SUPPLIERS)

    @cached_property
    def registry(self) -> DataFrame:
        """The suppliers as the stored table a job would read, rather than a projection computed per use."""
        return cut(self.suppliers)[0]

    @cached_property
    def taxonomy(self) -> DataFrame:
        return self.sql(TAXONOMY).withColumn("version", F.lit("v1"))

    @cached_property
    def classifications(self) -> DataFrame:
        return self.sql(CLASSIFICATIONS)

    @cached_property
    def audit(self) -> DataFrame:
        return self.sql(AUDIT)

    @cached_property
    def calls(self) -> DataFrame:
        return self.sql(CALLS)

    @cached_property
    def payloads(self) -> DataFrame:
        return self.sql(PAYLOADS)

    @cached_property
    def corrections(self) -> DataFrame:
        return self.sql(CORRECTIONS)

    @cached_property
    def reports(self) -> DataFrame:
        return self.sql(REPORTS)

    @cached_property
    def cache(self) -> DataFrame:
        return self.sql(CACHE)

    @cached_property
    def rows(self) -> DataFrame:
        return supplier_list(self.suppliers, self.classifications, self.taxonomy)

    @cached_property
    def listed(self) -> DataFrame:
        """The list view worked out once, for queries that filter it several times."""
        return cut(self.rows)[0]

    @cached_property
    def lines(self) -> DataFrame:
        """Transaction lines as an upload would deliver them, with a deterministic file order.

        Customers with their orders play the part of suppliers that are not registered yet. Lines with equal
        order and line numbers spell a supplier alike, so the order among them does not matter.
        """
        tx = self.tx.select(
            F.col("raw_name").alias("name"), "amount", F.lit(None).cast("string").alias("industry"),
            F.when(F.col("l_linenumber") == 3, F.concat(F.lit("https://www.s"), (F.col("supplier_no") - 1).cast("string"), F.lit(".example.com/a"))).alias("domain"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        )
        orders, customers = self.base("orders"), self.base("customer")
        new = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_name").alias("name"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lower("c_mktsegment").alias("industry"),
            F.lit(None).cast("string").alias("domain"),
            (F.col("o_orderkey") + 1_000_000_000_000_000).alias("row_no"),
        )
        return tx.unionByName(new)


def present(df: DataFrame) -> DataFrame:
    """Plain output types: decimals as doubles, integers as long, times without zone, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ";")
        out.append(c.alias(f.name))
    return df.select(*out)
