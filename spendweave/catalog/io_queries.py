"""Files read back, mapped and loaded, in batch and as streams; the files are written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog.registry import query
from spendweave.catalog.report_queries import LINES, USAGE
from spendweave.catalog.views import Tables, with_views
from spendweave.operators.current import conform
from spendweave.params import Params
from spendweave.schemas import SUPPLIERS, TAXONOMY
from spendweave.session import cut, shared_dir
from spendweave.sources.delimited import load_taxonomy, map_supplier_columns, read_delimited, write_taxonomy
from spendweave.streaming import counters, ingest

P = Params()


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "ingest_csv",
    with_views("SELECT count(*) AS lines, count(DISTINCT trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS spellings, sum(amount)::DOUBLE AS total, count(industry) AS with_industry, count(domain) AS with_domain, ';' AS delimiter, 0 AS rejects FROM lines", LINES),
)
def ingest_csv(t: Tables) -> DataFrame:
    path = _folder(t, "csv")
    given = t.lines.select(F.col("name").alias("Vendor"), F.col("amount").cast("string").alias("Spend"), F.col("industry").alias("Sector"), F.col("domain").alias("Website"))
    given.write.option("header", True).option("sep", ";").csv(path)
    read = read_delimited(t.spark, path)
    lines, rejects = map_supplier_columns(read.records, read.headers)
    # names are shown in title case; undo nothing, count spellings of the raw column instead
    raw = read.records.agg(F.count_distinct(F.trim(F.regexp_replace("Vendor", r"\s+", " "))).alias("spellings"), F.lit(1).alias("_one"))
    sums = lines.agg(
        F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("total"), F.count("industry").alias("with_industry"), F.count("domain").alias("with_domain"), F.lit(1).alias("_one")
    )
    lost = rejects.agg(F.count(F.lit(1)).alias("rejects"), F.lit(1).alias("_one"))
    return sums.join(raw, "_one").join(lost, "_one").withColumn("delimiter", F.lit(read.delimiter)).drop("_one")


@query(
    "shifted_rows",
    """SELECT count(*) AS records, count(CASE WHEN l_extendedprice >= 1000 AND l_linenumber % 2 = 1 THEN 1 END) AS shifted, count(CASE WHEN l_extendedprice < 1000 OR l_linenumber % 2 = 0 THEN 1 END) AS parents_kept FROM lineitem""",
)
def shifted_rows(t: Tables) -> DataFrame:
    """Odd lines carry an unquoted thousands separator, so their later columns move one place."""
    path = _folder(t, "shifted")
    price = F.format_number("l_extendedprice", 2)
    amount = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("$"), price)).otherwise(F.concat(F.lit('"$'), price, F.lit('"')))
    body = t.base("lineitem").select(
        F.pmod(F.xxhash64("l_orderkey"), F.lit(8)).cast("int").alias("part"), F.lit(1).alias("place"),
        F.concat_ws(",", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")), amount, F.lit("Maker Holding"), (F.col("l_partkey") + 100000).cast("string")).alias("value"),
    )
    heads = t.spark.range(8).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("place"), F.lit("name,amount,parent,naics").alias("value"))
    heads.unionByName(body).repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    read = read_delimited(t.spark, path)
    lines, _ = map_supplier_columns(read.records, read.headers)
    shifted = read.shifted.agg(F.count(F.lit(1)).alias("shifted"), F.lit(1).alias("_one"))
    kept = lines.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("parent_name") == "Maker Holding").alias("parents_kept"), F.lit(1).alias("_one"))
    return kept.join(shifted, "_one").drop("_one")


@query(
    "map_supplier_columns",
    """SELECT layout, count(*) AS lines, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total, count(CASE WHEN layout <> 'plain' THEN 1 END) AS with_domain, count(CASE WHEN layout = 'erp' THEN 1 END) AS with_parent, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_date
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'erp' ELSE 'web' END AS layout FROM lineitem) x WHERE l_linenumber <> 5 GROUP BY 1""",
)
def map_columns(t: Tables) -> DataFrame:
    """Three header layouts; line 5 has no name and is rejected."""
    item = t.base("lineitem")
    name = F.when(F.col("l_linenumber") != 5, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).otherwise("  ")
    amount, row_no = F.format_number("l_extendedprice", 2), F.struct("l_orderkey", "l_linenumber").alias("row_no")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    layouts = {
        "plain": (0, [name.alias("name"), amount.alias("Amount"), day.alias("date")]),
        "erp": (1, [name.alias(" Vendor_Name "), amount.alias("TOTAL"), F.lit("x.com").alias("Web"), F.lit("Maker AG").alias("Ultimate_Parent"), day.alias("Posted_Date")]),
        "web": (2, [name.alias("Company"), F.concat(F.lit("$"), amount).alias("Spend"), F.lit("y.org").alias("URL"), F.lit("9919").alias("parent"), day.alias("period")]),
    }
    out = None
    for label, (rest, columns) in layouts.items():
        lines, _ = map_supplier_columns(item.where(F.col("l_linenumber") % 3 == rest).select(*columns, row_no), [c for c in item.limit(0).select(*columns).columns])
        part = lines.agg(
            F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("total"), F.count("domain").alias("with_domain"), F.count("parent_name").alias("with_parent"), F.min("date").alias("first_date")
        ).select(F.lit(label).alias("layout"), "*")
        out = part if out is None else out.unionByName(part)
    return out


RAW_CODES = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(substr(code, 1, 4), '-', substr(code, 5, 4)) WHEN 1 THEN concat(' ', code) WHEN 2 THEN code ELSE substr(code, 1, 7) END AS code,
  CASE WHEN p_partkey % 10 = 9 THEN '  ' ELSE concat(p_name, '   ', p_type) END AS title FROM (SELECT *, CAST(10000000 + ((p_partkey - p_partkey % 3) * 7919) % 90000000 AS VARCHAR(8)) AS code FROM part) p"""


@query(
    "taxonomy_load",
    f"""SELECT code, substr(code, 1, 2) AS segment_code, substr(code, 1, 4) AS family_code, substr(code, 1, 6) AS class_code, commodity, 'v26.0801' AS version FROM (
SELECT regexp_replace(code, '\\D', '', 'g') AS code, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS commodity, row_number() OVER (PARTITION BY regexp_replace(code, '\\D', '', 'g') ORDER BY p_partkey DESC) AS n FROM ({RAW_CODES}) r
WHERE length(regexp_replace(code, '\\D', '', 'g')) = 8 AND trim(title) <> '') x WHERE n = 1""",
)
def taxonomy_load(t: Tables) -> DataFrame:
    raw = t.sql(RAW_CODES).select(F.col("code").alias("Commodity Code"), F.col("title").alias("Commodity Title"), F.col("p_partkey").alias("row_no"))
    return load_taxonomy(raw, P.taxonomy_version).select("code", "segment_code", "family_code", "class_code", "commodity", "version")


LATER = "SELECT code, concat(upper(commodity), ' 2') AS title, CAST(code AS BIGINT) AS row_no FROM v_taxonomy WHERE CAST(code AS BIGINT) % 3 = 0 UNION ALL SELECT concat('99', lpad(CAST(p_partkey AS VARCHAR(6)), 6, '0')), p_name, p_partkey + 10000000 FROM part"


@query(
    "taxonomy_upsert",
    with_views(f"""SELECT coalesce(l.code, t.code) AS code, CASE WHEN l.code IS NULL THEN t.commodity ELSE l.title END AS commodity, CASE WHEN l.code IS NULL THEN t.family END AS family, CASE WHEN l.code IS NULL THEN 'v1' ELSE 'v2' END AS version, substr(coalesce(l.code, t.code), 1, 2) AS segment_code
FROM v_taxonomy t FULL JOIN (SELECT code, arg_max(title, row_no) AS title FROM ({LATER}) x GROUP BY code) l ON l.code = t.code"""),
)
def taxonomy_upsert(t: Tables) -> DataFrame:
    """A later release over the stored taxonomy: changed and new codes from it, all others as they were."""
    path = _folder(t, "taxonomy")
    columns = ["code", "segment", "segment_code", "family", "family_code", "class", "class_code", "commodity", "description", "version"]
    write_taxonomy(conform(t.taxonomy, TAXONOMY).withColumn("version", F.lit("v1")).select(columns), path)
    loaded = load_taxonomy(t.sql(LATER).select(F.col("code").alias("Commodity Code"), F.col("title").alias("Commodity Title"), "row_no"), "v2")
    write_taxonomy(loaded.select(columns), path)
    return t.spark.read.schema(loaded.select(columns).schema).parquet(path).select("code", "commodity", "family", "version", "segment_code")


@query("stream_ingest", with_views("SELECT entity, amount::DOUBLE AS amount, transaction_count FROM folded", LINES))
def stream_ingest(t: Tables) -> DataFrame:
    """Two streams of files into one registry, the first one's last files late; totals equal those of one batch over all files."""
    drop, lake = _folder(t, "drop"), _folder(t, "lake")
    given = t.lines.select("name", F.col("amount").cast("string").alias("amount"), "industry", F.col("domain").alias("website"), F.pmod(F.xxhash64("name", "amount"), F.lit(3)).alias("part"))
    given, updates = cut(given)[0], None
    for part, (stream, columns) in enumerate((("first", ["name", "amount", "industry", "website"]), ("second", ["amount", "website", "name", "industry"]), ("first", ["name", "amount", "industry", "website"]))):
        path = f"{drop}/{stream}"
        given.where(F.col("part") == part).select(columns).repartition(8).write.mode("append").option("header", True).csv(path)
        updates = ingest.stream_ingest(t.spark, path, lake, f"{lake}/{stream}", P, files_per_batch=8)
    found = ingest.registry(conform(t.spark.range(0), SUPPLIERS), updates, P)["suppliers"]
    return found.select(F.col("normalized_name").alias("entity"), F.col("total_amount").alias("amount"), "transaction_count")


def _events_stream(t: Tables) -> DataFrame:
    schema = t.base("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("usage_stream", with_views("SELECT model, usage_day, request_count, prompt_tokens, completion_tokens, failure_count FROM usage", USAGE))
def usage_stream(t: Tables) -> DataFrame:
    calls = _events_stream(t).select(
        F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("prompt_tokens"), F.floor(F.col("value") * 10).alias("completion_tokens"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failures"),
    )
    out, keys = _folder(t, "usage"), ["window_start", "model"]
    counters.run_available(counters.usage_stream(calls), keys, out, f"{out}-state")
    rows = counters.latest(t.spark.read.parquet(out), keys)
    return rows.select("model", F.to_date("window_start").alias("usage_day"), "request_count", "prompt_tokens", "completion_tokens", "failure_count")


@query(
    "rate_stream",
    """SELECT make_timestamp((epoch_us(ts) // 60000000 - k) * 60000000) AS window_start, event_type AS model, count(*) AS in_window, count(*) >= 3 AS at_limit
FROM events, (SELECT unnest(range(10)) AS k) GROUP BY 1, 2""",
)
def rate_stream(t: Tables) -> DataFrame:
    calls = _events_stream(t).select(F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"))
    out, keys = _folder(t, "rate"), ["window_start", "model"]
    counters.run_available(counters.rate_stream(calls, 3, span="600 seconds", slide="60 seconds"), keys, out, f"{out}-state")
    return counters.latest(t.spark.read.parquet(out), keys)


@query("audit_stream", "SELECT date_trunc('hour', ts) AS window_start, event_type AS action, count(*) AS events FROM events GROUP BY 1, 2")
def audit_stream(t: Tables) -> DataFrame:
    audit = _events_stream(t).select(F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at"))
    out, keys = _folder(t, "audit"), ["window_start", "action"]
    counters.run_available(counters.audit_stream(audit), keys, out, f"{out}-state")
    return counters.latest(t.spark.read.parquet(out), keys)
