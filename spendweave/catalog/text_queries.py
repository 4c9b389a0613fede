"""Cleaning stages, each exercised through an aggregate over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.functions import domains, text, values
from spendweave.operators.aggregates import fold_lines, parent_labels
from spendweave.params import Params

P = Params()
EVENTS_AS_OF = "2024-02-01 00:00:00"
AS_OF = "2001-11-15 00:00:00"


@query(
    "entity_key",
    with_views(f"""
SELECT {q.key('raw_name')} AS entity, count(*) AS line_count, count(DISTINCT raw_name) AS spellings,
       count(DISTINCT CASE WHEN {q.suffixed('raw_name')} THEN raw_name END) AS suffix_spellings, CAST(sum(amount) AS DOUBLE) AS total_spend
FROM v_tx GROUP BY 1"""),
)
def entity_key(t: Tables) -> DataFrame:
    lines = t.tx.select(F.col("raw_name").alias("name"), "amount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    folded = fold_lines(lines)
    return folded.select(F.col("key").alias("entity"), "line_count", "spellings", "suffix_spellings", F.col("amount").alias("total_spend"))


@query(
    "title_case",
    with_views(f"""
SELECT entity, arg_min(display, (-lines, display)) AS display, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(changed) AS BIGINT) AS changed_lines FROM spelled GROUP BY 1""", f"""spelled AS (SELECT {q.key('raw_name')} AS entity, {q.title('raw_name')} AS display, count(*) AS lines,
                     sum(CASE WHEN {q.title('raw_name')} <> trim(raw_name) THEN 1 ELSE 0 END) AS changed FROM v_tx GROUP BY 1, 2)"""),
)
def title_case(t: Tables) -> DataFrame:
    spelled = t.tx.groupBy("raw_name").agg(F.count(F.lit(1)).alias("lines"))
    spelled = spelled.withColumn("entity", text.entity_key(F.col("raw_name"))).withColumn("display", text.title_case(F.col("raw_name")))
    spelled = spelled.withColumn("changed", F.when(F.col("display") != F.trim("raw_name"), F.col("lines")).otherwise(0))
    shown = spelled.groupBy("entity", "display").agg(F.sum("lines").alias("lines"), F.sum("changed").alias("changed"))
    return shown.groupBy("entity").agg(
        F.min_by("display", F.struct(-F.col("lines"), F.col("display"))).alias("display"), F.sum("lines").alias("lines"), F.sum("changed").alias("changed_lines")
    )


@query("extract_domain", f"SELECT {q.domain('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def extract_domain(t: Tables) -> DataFrame:
    return t.base("pages").groupBy(domains.registrable_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "guess_domain",
    f"""SELECT CASE WHEN regexp_matches(first, '^[a-z0-9]{{3,}}$') THEN concat(first, '.com') END AS guessed, count(*) AS names
FROM (SELECT string_split({q.key("concat(p_name, ' Co., Ltd')")}, ' ')[1] AS first FROM part) x GROUP BY 1""",
)
def guess_domain(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" Co., Ltd"))
    return t.base("part").groupBy(domains.guessed_domain(name).alias("guessed")).agg(F.count(F.lit(1)).alias("names"))


@query(
    "normalize_date",
    """
WITH raw AS (SELECT l_extendedprice, CASE l_linenumber % 5 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y')
   WHEN 2 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN 3 THEN strftime(l_shipdate, '%Y-%-m-%-dT10:00:00Z') ELSE 'n/a' END AS spelled FROM lineitem),
parts AS (SELECT *, TRY_CAST(regexp_extract(spelled, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})$', 1) AS INT) AS a,
   TRY_CAST(regexp_extract(spelled, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})$', 2) AS INT) AS b, regexp_extract(spelled, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})$', 3) AS y,
   regexp_extract(spelled, '^(\\d{4})-(\\d{1,2})-', 1) AS iy, regexp_extract(spelled, '^(\\d{4})-(\\d{1,2})-', 2) AS im FROM raw),
months AS (SELECT l_extendedprice, CASE WHEN iy <> '' THEN concat(iy, '-', lpad(im, 2, '0'))
   WHEN a IS NOT NULL THEN concat(y, '-', lpad(CAST(CASE WHEN a <= 12 THEN a ELSE b END AS VARCHAR), 2, '0')) END AS month FROM parts)
SELECT month, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM months GROUP BY 1""",
)
def normalize_date(t: Tables) -> DataFrame:
    ship, kind = F.col("l_shipdate"), F.col("l_linenumber") % 5
    spelled = (
        F.when(kind == 0, F.date_format(ship, "yyyy-MM-dd")).when(kind == 1, F.date_format(ship, "MM/dd/yyyy"))
        .when(kind == 2, F.date_format(ship, "dd.MM.yyyy")).when(kind == 3, F.date_format(ship, "yyyy-M-d'T10:00:00Z'")).otherwise("n/a")
    )
    rows = t.base("lineitem").select(values.iso_date(spelled).alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return rows.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("spend"))


@query(
    "parse_amount",
    """
SELECT l_linenumber % 6 AS format, count(*) AS lines, CAST(sum(CASE WHEN l_linenumber % 6 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS rejects,
       CAST(sum(CASE l_linenumber % 6 WHEN 5 THEN NULL WHEN 3 THEN -CAST(l_extendedprice AS DECIMAL(18,2)) WHEN 4 THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total
FROM lineitem GROUP BY 1""",
)
def parse_amount(t: Tables) -> DataFrame:
    plain = F.col("l_extendedprice").cast("decimal(18,2)")
    grouped, kind = F.format_number(plain, 2), F.col("l_linenumber") % 6
    spelled = (
        F.when(kind == 0, plain.cast("string")).when(kind == 1, F.concat(F.lit("$"), grouped)).when(kind == 2, F.concat(F.translate(grouped, ",.", ".,"), F.lit(" EUR")))
        .when(kind == 3, F.concat(F.lit("("), grouped, F.lit(")"))).when(kind == 4, F.concat(grouped, F.lit("-"))).otherwise("n/a")
    )
    rows = t.base("lineitem").select(kind.alias("format"), values.money(spelled).alias("amount"))
    return rows.groupBy("format").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("amount").isNull()).alias("rejects"), F.sum("amount").alias("total"))


@query(
    "sanitize_parent",
    """
SELECT CASE c_custkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'digits' WHEN 2 THEN 'digits' WHEN 3 THEN 'too_long' WHEN 4 THEN 'no_letter' ELSE 'blank' END AS reason,
       count(*) AS names, count(CASE WHEN c_custkey % 6 = 0 THEN 1 END) AS kept FROM customer GROUP BY 1""",
)
def sanitize_parent(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    given = (
        F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, (k + 332722).cast("string")).when(k % 6 == 2, F.concat(k.cast("string"), F.lit("-4 5.6")))
        .when(k % 6 == 3, F.rpad("c_name", 201, "x")).when(k % 6 == 4, F.lit("!!! ???")).otherwise("  ")
    )
    rows = t.base("customer").select(given.alias("given"))
    return rows.groupBy(text.parent_reject_reason(F.col("given")).alias("reason")).agg(F.count(F.lit(1)).alias("names"), F.count(text.sanitize_parent(F.col("given"))).alias("kept"))


@query(
    "coerce_code",
    with_views("""
SELECT CASE kind WHEN 3 THEN 'rejected' WHEN 2 THEN 'padded' ELSE 'accepted' END AS outcome, count(*) AS codes,
       min(CASE kind WHEN 3 THEN NULL WHEN 2 THEN concat('0', substr(code, 1, 7)) ELSE code END) AS lowest,
       max(CASE kind WHEN 3 THEN NULL WHEN 2 THEN concat('0', substr(code, 1, 7)) ELSE code END) AS highest FROM given GROUP BY 1""", """given AS (SELECT p_partkey % 4 AS kind, code FROM v_taxonomy)"""),
)
def coerce_code(t: Tables) -> DataFrame:
    kind, code = F.col("p_partkey") % 4, F.col("code")
    given = F.when(kind == 0, code).when(kind == 1, F.concat_ws("-", F.substring(code, 1, 2), F.substring(code, 3, 3), F.substring(code, 6, 3))).when(kind == 2, F.substring(code, 1, 7)).otherwise("nope")
    rows = t.taxonomy.select(given.alias("given")).withColumn("clean", values.coerce_code(F.col("given")))
    outcome = F.when(F.col("clean").isNull(), "rejected").when(F.length(F.regexp_replace("given", r"\D", "")) == 7, "padded").otherwise("accepted")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("codes"), F.min("clean").alias("lowest"), F.max("clean").alias("highest"))


def _print_sql(industry: str) -> str:
    inner = q.fnv1a("lower(coalesce(description, ''))")
    return q.fnv1a(f"concat(lower(coalesce(domain, '')), '|', lower({industry}), '|', coalesce(naics, ''), '|', '', '|', lower(coalesce(parent_name, '')), '|', {inner})")


@query(
    "fingerprint",
    with_views(f"""
SELECT before <> after AS changed, count(*) AS suppliers, min(before) AS low, max(after) AS high FROM prints GROUP BY 1""", f"""prints AS (SELECT id, {_print_sql('industry')} AS before, {_print_sql("CASE id % 3 WHEN 0 THEN concat(industry, ' II') WHEN 1 THEN upper(industry) ELSE industry END")} AS after FROM v_suppliers)"""),
)
def fingerprint(t: Tables) -> DataFrame:
    later = F.when(F.col("id") % 3 == 0, F.concat("industry", F.lit(" II"))).when(F.col("id") % 3 == 1, F.upper("industry")).otherwise(F.col("industry"))

    def of(industry):
        return text.enrichment_fingerprint(F.col("domain"), industry, F.col("naics"), F.lit(None).cast("string"), F.col("parent_name"), F.col("description"))

    rows = t.suppliers.select(of(F.col("industry")).alias("before"), of(later).alias("after"))
    return rows.groupBy((F.col("before") != F.col("after")).alias("changed")).agg(F.count(F.lit(1)).alias("suppliers"), F.min("before").alias("low"), F.max("after").alias("high"))


@query(
    "keywords",
    f"""
WITH words AS (SELECT doc_id, lang, unnest({q.word_list('text')}) AS word, generate_subscripts({q.word_list('text')}, 1) AS pos FROM documents),
firsts AS (SELECT doc_id, lang, word, min(pos) AS pos FROM words WHERE {q.keyword_filter('word')} GROUP BY 1, 2, 3),
kept AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM firsts) x WHERE n <= 8),
counted AS (SELECT lang, word, count(*) AS documents FROM kept GROUP BY 1, 2)
SELECT lang, word, documents, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY documents DESC, word) AS n FROM counted) y WHERE n <= 10""",
)
def keywords(t: Tables) -> DataFrame:
    words = t.base("documents").select("lang", F.explode(text.keywords(F.col("text"), 8)).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("documents"))
    top = Window.partitionBy("lang").orderBy(F.col("documents").desc(), "word")
    return counted.withColumn("position", F.row_number().over(top)).where(F.col("position") <= 10)


NAMED = "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ', a ', p_type, ' Works group') WHEN 1 THEN p_name ELSE upper(substr(p_name, 1, 5)) END"


@query(
    "heuristic_enrichment",
    f"""
WITH named AS (SELECT {NAMED} AS name FROM part), found AS (SELECT name, {q.key('name')} AS entity,
  nullif(regexp_extract(name, ',\\s*(?:an?|the)\\s+([A-Z][\\w&.''-]*(?:\\s+[A-Z][\\w&.''-]*){{0,4}})\\s+(?:company|group|subsidiary|brand)', 1), '') AS parent FROM named)
SELECT parent, count(*) AS names, count(CASE WHEN NOT contains(entity, ' ') AND length(entity) >= 4 THEN 1 END) AS with_domain FROM found GROUP BY 1""",
)
def heuristic_enrichment(t: Tables) -> DataFrame:
    named = t.base("part").select(F.expr(NAMED).alias("name"))
    rows = named.select(text.parent_in_name(F.col("name")).alias("parent"), domains.single_word_domain(F.col("name")).alias("domain"))
    return rows.groupBy("parent").agg(F.count(F.lit(1)).alias("names"), F.count("domain").alias("with_domain"))


@query("age_days", f"SELECT CAST(greatest(0, floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 86400000000.0::DOUBLE)) AS BIGINT) AS age, count(*) AS events FROM events GROUP BY 1")
def age_days(t: Tables) -> DataFrame:
    from datetime import datetime

    return t.base("events").groupBy(values.age_days(F.col("ts"), datetime.fromisoformat(EVENTS_AS_OF)).alias("age")).agg(F.count(F.lit(1)).alias("events"))


def _buckets(rows: DataFrame, bucket, name: str) -> DataFrame:
    return rows.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("suppliers"), F.sum("total_amount").alias("spend"))


@query(
    "confidence_band",
    with_views("""SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band,
count(*) AS suppliers, CAST(sum(total_amount) AS DOUBLE) AS spend FROM v_list GROUP BY 1"""),
)
def confidence_band(t: Tables) -> DataFrame:
    return _buckets(t.rows, values.confidence_band(F.col("confidence"), P), "band")


@query(
    "route_tier",
    with_views("""SELECT CASE WHEN is_parent OR coalesce(total_amount, 0) >= 33000000 OR NOT (parent_id IS NOT NULL OR coalesce(parent_name, '') <> '') THEN 'accurate' ELSE 'bulk' END AS tier,
count(*) AS suppliers, CAST(sum(total_amount) AS DOUBLE) AS spend FROM v_suppliers GROUP BY 1"""),
)
def route_tier(t: Tables) -> DataFrame:
    has_parent = F.col("parent_id").isNotNull() | (F.coalesce("parent_name", F.lit("")) != "")
    return _buckets(t.suppliers, values.route_tier(F.col("is_parent"), F.col("total_amount"), has_parent, Params(high_value_spend=33_000_000)), "tier")


@query(
    "richness_score",
    with_views("""SELECT CASE WHEN domain IS NOT NULL THEN 3 ELSE 0 END + 3 + 2 + least(3, CAST(ceil(length(coalesce(description, '')) / 120.0) AS INT)) + CASE WHEN is_parent THEN 1 ELSE 0 END AS score,
count(*) AS suppliers, CAST(sum(total_amount) AS DOUBLE) AS spend FROM v_suppliers GROUP BY 1"""),
)
def richness_score(t: Tables) -> DataFrame:
    c = F.col
    return _buckets(t.suppliers, text.richness(c("domain"), c("industry"), c("naics"), F.lit(None).cast("string"), c("description"), c("is_parent")), "score")


@query(
    "parent_label",
    with_views("""SELECT coalesce(p.name, nullif(s.parent_name, ''), CASE WHEN s.is_parent OR s.subsidiary_count > 0 THEN concat(s.name, ' (parent)') ELSE 'Independent' END) AS label,
count(*) AS suppliers, CAST(sum(s.total_amount) AS DOUBLE) AS spend FROM v_list s LEFT JOIN v_list p ON p.id = s.parent_id GROUP BY 1"""),
)
def parent_label(t: Tables) -> DataFrame:
    return _buckets(parent_labels(t.rows), F.col("parent_label"), "label")
