"""Candidates, validation, batches, prompts, answers and the classification run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.family_queries import MEMBERS, PLAN, ROOTS, SCORED
from spendweave.catalog.payload_queries import stub_lookup
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.operators import aggregates, batches, candidates, responses
from spendweave.params import Params
from spendweave.plans.classify import classify_run as run_classify
from spendweave.plans.refresh import refresh_run as run_refresh

P = Params()

ASKING = """SELECT id, name, industry, CASE id % 5 WHEN 0 THEN 'Family of econ ring makers' WHEN 1 THEN 'promo goods and small widget parts' WHEN 2 THEN 'Segment lists, medi polish' WHEN 3 THEN description ELSE 'unrelated consultancy' END AS description
  FROM v_suppliers"""


def _candidate_sql() -> str:
    def source(rank: int, column: str, most: int) -> str:
        w = q.word_list(column)
        return f"SELECT id, {rank} AS src, word, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM (SELECT id, word, min(pos) AS pos FROM (SELECT id, unnest({w}) AS word, generate_subscripts({w}, 1) AS pos FROM asking) a WHERE {q.keyword_filter('word')} GROUP BY 1, 2) b) c WHERE n <= {most}"

    return f"""asking AS ({ASKING}),
every_word AS ({source(1, 'industry', 4)} UNION ALL {source(2, 'name', 3)} UNION ALL {source(3, 'description', 4)}),
first_word AS (SELECT id, word, min((src, pos)) AS at_place FROM every_word GROUP BY 1, 2),
chosen AS (SELECT id, word FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_place) AS n FROM first_word) x WHERE n <= 8),
sized AS (SELECT *, greatest(15, CAST(ceil(60.0 / count(*) OVER (PARTITION BY id)) AS INT)) AS budget FROM chosen),
low_tax AS (SELECT code, commodity, lower(commodity) AS c, lower(class) AS k, lower(family) AS f, lower(segment) AS s FROM v_taxonomy),
posted AS (SELECT word, code, row_number() OVER (PARTITION BY word ORDER BY code) AS n FROM (SELECT DISTINCT word FROM chosen) w JOIN low_tax t ON contains(t.c, w.word) OR contains(t.k, w.word) OR contains(t.f, w.word)),
found AS (SELECT DISTINCT z.id, p.code FROM sized z JOIN posted p ON p.word = z.word AND p.n <= z.budget),
pointed AS (SELECT f.id, f.code, t.commodity, CASE WHEN contains(t.c, z.word) THEN 10 WHEN contains(t.k, z.word) THEN 4 WHEN contains(t.f, z.word) OR contains(t.s, z.word) THEN 1 ELSE 0 END AS points
  FROM found f JOIN low_tax t ON t.code = f.code JOIN chosen z ON z.id = f.id),
scored_codes AS (SELECT id, code, commodity, CAST(sum(points) AS BIGINT) AS score, count(CASE WHEN points > 0 THEN 1 END) AS matched, count(CASE WHEN points = 10 THEN 1 END) AS commodity_hits FROM pointed GROUP BY 1, 2, 3),
flagged AS (SELECT *, commodity_hits > 0 OR matched >= 2 AS relevant, bool_or(commodity_hits > 0 OR matched >= 2) OVER (PARTITION BY id) AS any_relevant FROM scored_codes),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, commodity_hits DESC, matched DESC, code) AS position FROM flagged WHERE relevant OR NOT any_relevant)"""


@query("candidate_codes", with_views("SELECT id AS supplier_id, position, code, commodity, score, matched, commodity_hits FROM placed WHERE position <= 20", _candidate_sql()))
def candidate_codes(t: Tables) -> DataFrame:
    return candidates.candidate_codes(t.sql(ASKING), t.taxonomy, 20)


GIVEN = "SELECT id, CASE id % 4 WHEN 0 THEN unspsc_code WHEN 1 THEN concat(substr(unspsc_code, 1, 5), 'x99') WHEN 2 THEN concat(substr(unspsc_code, 1, 4), '9999') ELSE concat('9', substr(unspsc_code, 2, 7)) END AS unspsc_code, confidence FROM v_classifications"


@query(
    "validate_codes",
    with_views("""SELECT outcome, count(*) AS n, min(valid_code) AS lowest, max(valid_code) AS highest, sum(confidence)::DOUBLE AS confidence FROM (
SELECT CASE WHEN valid_code = unspsc_code THEN CASE WHEN known THEN 'exact' ELSE 'as_given' END ELSE 'repaired' END AS outcome, valid_code, CASE WHEN known THEN confidence ELSE least(confidence, 0.4) END AS confidence FROM (
SELECT g.*, c8.code IS NOT NULL AS known, CASE WHEN NOT regexp_matches(g.unspsc_code, '^[0-9]{8}$') THEN g.unspsc_code ELSE coalesce(c8.code, c6.code, c4.code, c2.code, g.unspsc_code) END AS valid_code FROM given g
LEFT JOIN v_taxonomy c8 ON c8.code = g.unspsc_code LEFT JOIN (SELECT substr(code, 1, 6) AS p, min(code) AS code FROM v_taxonomy GROUP BY 1) c6 ON c6.p = substr(g.unspsc_code, 1, 6)
LEFT JOIN (SELECT substr(code, 1, 4) AS p, min(code) AS code FROM v_taxonomy GROUP BY 1) c4 ON c4.p = substr(g.unspsc_code, 1, 4) LEFT JOIN (SELECT substr(code, 1, 2) AS p, min(code) AS code FROM v_taxonomy GROUP BY 1) c2 ON c2.p = substr(g.unspsc_code, 1, 2)) v) o GROUP BY 1""",
    f"given AS ({GIVEN})"),
)
def validate_codes(t: Tables) -> DataFrame:
    checked = candidates.cap_unknown(candidates.validate_codes(t.sql(GIVEN), t.taxonomy, spread_by="id"), P)
    outcome = F.when(F.col("valid_code") != F.col("unspsc_code"), "repaired").when(F.col("code_unknown"), "as_given").otherwise("exact")
    return checked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("valid_code").alias("lowest"), F.max("valid_code").alias("highest"), F.sum("confidence").alias("confidence"))


TIERED = "SELECT c_custkey + 1 AS id, c_name AS name, c_mktsegment AS industry, CASE WHEN c_custkey % 3 = 0 THEN 'accurate' ELSE 'bulk' END AS model FROM customer"


@query(
    "request_batches",
    f"""SELECT id, model, position, CAST(ceil(position / 10.0) AS BIGINT) AS batch_no FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS position FROM ({TIERED}) c) x""",
)
def request_batches(t: Tables) -> DataFrame:
    return batches.request_batches(t.sql(TIERED), 10).select("id", "model", "position", "batch_no")


def _batched(t: Tables) -> DataFrame:
    rows = t.sql(TIERED)
    for column in ("domain", "naics", "sic", "description", "parent_name"):
        rows = rows.withColumn(column, F.lit(None).cast("string"))
    return batches.request_batches(rows, 10)


PROMPT_SLOTS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS position FROM ({TIERED}) c),
lined AS (SELECT model, CAST(ceil(position / 10.0) AS BIGINT) AS batch_no, position,
  concat('{{"n":', (position - 1) % 10 + 1, ',"supplier":{{"name":"', name, '","industry":"', industry, '"}}}}') AS line FROM numbered)"""


@query(
    "build_prompts",
    f"""WITH {PROMPT_SLOTS} SELECT model, batch_no, count(*) AS suppliers, concat(
'Task: procurement categorisation. Every supplier gets one commodity code of the taxonomy, eight digits written as a string, for what it mainly sells. Be as specific as the facts allow and say so in the confidence. Reply in JSON, nothing else.', chr(10),
'Solved before:', chr(10), '{{"supplier": {{"name": "Acme"}}, "answer": {{"unspsc_code": "43211507", "confidence": 0.9, "reasoning": "desktops"}}}}', chr(10),
'Codes worth a look (others are allowed if they exist):', chr(10), CASE WHEN model = 'bulk' THEN concat('fits batch ', batch_no) ELSE '(none found)' END, chr(10), 'Suppliers:', chr(10), string_agg(line, chr(10) ORDER BY position), chr(10),
'Reply with one object, its list as long as the suppliers (', count(*), ') and in their order: ', '{{"results": [{{"supplier_name": "...", "unspsc_code": "8 digits", "confidence": 0.0-1.0, "reasoning": "..."}}]}}') AS prompt
FROM lined GROUP BY 1, 2""",
)
def build_prompts(t: Tables) -> DataFrame:
    """Whole prompts: system text, an example, candidates for one tier, and supplier lines."""
    batched = _batched(t)
    example = t.spark.createDataFrame([("Acme", None, "", None, "43211507", 0.9, "desktops")], "supplier_name string, domain string, industry string, naics string, unspsc_code string, confidence double, reasoning string")
    fitting = batched.where("model = 'bulk'").select("model", "batch_no").distinct().withColumn("candidate_text", F.concat(F.lit("fits batch "), F.col("batch_no").cast("string")))
    return batches.batch_prompts(batched, 10, batches.example_text(example), fitting)


@query(
    "build_parent_prompts",
    f"""WITH {PROMPT_SLOTS} SELECT model, batch_no, count(*) AS suppliers, concat(
'Task: company ownership. For every supplier find the company at the top of its group; null stands for a company of its own. Doubt belongs in the confidence. Reply in JSON, nothing else.', chr(10),
'Suppliers:', chr(10), string_agg(line, chr(10) ORDER BY position), chr(10), 'Reply with one object, its list as long as the suppliers (', count(*), ') and in their order: ',
'{{"results": [{{"supplier_name": "...", "parent_name": "...", "parent_domain": "...", "is_subsidiary": true, "confidence": 0.0-1.0}}]}}') AS prompt FROM lined GROUP BY 1, 2""",
)
def build_parent_prompts(t: Tables) -> DataFrame:
    return batches.parent_prompts(_batched(t), 10)


def stub_score():
    """Scorer stand-in: a code and confidence made from the number in each supplier's name. Every seventh
    supplier is left out of the answer, and some answers come in fences or prose or with stray commas."""
    import re

    def one(name: str, number: int) -> str:
        return '{"supplier_name": "%s", "unspsc_code": "%d", "confidence": %.2f, "reasoning": "by number"}' % (name, 10000000 + (number * 7919) % 90000000, number % 100 / 100)

    def answer(prompt: str, batch_no: int) -> str:
        listed = re.findall(r'(?m)^\{"n":\d+,"supplier":\{"name":"([^"]*?(\d+))"', prompt)
        alone = re.findall(r'(?m)^\{"supplier":\{"name":"([^"]*?(\d+))"', prompt)
        if alone:
            return one(alone[0][0], int(alone[0][1]))
        body = '{"results": [%s]}' % ", ".join(one(name, int(n)) for name, n in listed if int(n) % 7)
        shape = batch_no % 4
        if shape == 1:
            return "```json\n" + body + "\n```"
        if shape == 2:
            return "Here is the answer: " + body + " as asked."
        return body.replace("]}", ",]}") if shape == 3 and "{" in body[2:] else body

    def score(pdf):
        out = pdf[["model", "batch_no"]].copy()
        out["response"] = [answer(p, int(n)) for p, n in zip(pdf["prompt"], pdf["batch_no"])]
        return out

    return score


ANSWERED = f"""asked AS (SELECT *, c_number % 7 <> 0 AS answered, 10000000 + (c_number * 7919) % 90000000 AS code, CAST((c_number % 100) / 100.0 AS DECIMAL(3,2)) AS conf, CAST(ceil(position / 10.0) AS BIGINT) AS batch_no
  FROM (SELECT *, id - 1 AS c_number, row_number() OVER (PARTITION BY model ORDER BY id) AS position FROM ({TIERED}) c) x)"""


@query(
    "score_batches",
    f"""WITH {ANSWERED}, bodies AS (SELECT model, batch_no, concat('{{"results": [', coalesce(string_agg(printf('{{"supplier_name": "%s", "unspsc_code": "%d", "confidence": %.2f, "reasoning": "by number"}}', name, code, (c_number % 100) / 100.0::DOUBLE), ', ' ORDER BY position) FILTER (WHERE answered), ''), ']}}') AS body FROM asked GROUP BY 1, 2)
SELECT model, batch_no, CASE batch_no % 4 WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Here is the answer: ', body, ' as asked.') WHEN 3 THEN replace(body, ']}}', ',]}}') ELSE body END AS response FROM bodies""",
)
def score_batches(t: Tables) -> DataFrame:
    return batches.score_batches(batches.batch_prompts(_batched(t), 10, "none"), stub_score())


def _items(t: Tables) -> DataFrame:
    from spendweave.session import cut

    answers, _ = cut(batches.score_batches(batches.batch_prompts(_batched(t), 10, "none"), stub_score()))
    return responses.answer_items(responses.parse_json(responses.json_text(answers)), responses.CODE_WRAPPERS, ["unspsc_code", "code"])


@query("parse_responses", f"WITH {ANSWERED} SELECT model, batch_no, count(*) AS items, max(n) AS last_item FROM (SELECT *, row_number() OVER (PARTITION BY model, batch_no ORDER BY position) AS n FROM asked WHERE answered) x GROUP BY 1, 2")
def parse_responses(t: Tables) -> DataFrame:
    return _items(t).groupBy("model", "batch_no").agg(F.count(F.lit(1)).alias("items"), F.max("item_no").alias("last_item"))


@query(
    "align_results",
    f"""WITH {ANSWERED} SELECT id AS supplier_id, model, CASE WHEN answered THEN CAST(code AS VARCHAR) END AS unspsc_code, CASE WHEN answered THEN conf::DOUBLE END AS confidence, answered FROM asked""",
)
def align_results(t: Tables) -> DataFrame:
    """A left-out supplier stays unanswered: later items are matched by name, not by position."""
    answered, missing = batches.align_results(_batched(t), responses.classification_items(_items(t)), 10)
    none = F.lit(None)
    return answered.select("supplier_id", "model", "unspsc_code", "confidence", F.lit(True).alias("answered")).unionByName(
        missing.select(F.col("id").alias("supplier_id"), "model", none.cast("string").alias("unspsc_code"), none.cast("double").alias("confidence"), F.lit(False).alias("answered"))
    )


PAYLOADS = """SELECT id, CASE id % 6
  WHEN 0 THEN concat('{"unspsc_code": "', unspsc_code, '", "confidence": 5, "reasoning": " ok ", "alternatives": [{"code": "', unspsc_code, '", "confidence": 0.9}, {"code": "11-11 1111", "confidence": -1}, {"code": "bad"}, {"code": "11111111"}]}')
  WHEN 1 THEN concat('{"code": ', unspsc_code, ', "confidence": "0.25"}')
  WHEN 2 THEN concat('{"unspsc_code": "', substr(unspsc_code, 1, 6), '", "confidence": 0.9}')
  WHEN 3 THEN concat('{"unspsc_code": "', substr(unspsc_code, 1, 2), '-', substr(unspsc_code, 3, 6), '", "reasoning": 7}')
  WHEN 4 THEN concat('{"unspsc_code": "', unspsc_code, '", "confidence": null, "reasoning": "", "alternatives": [{"code": "22222222", "confidence": 0.1}, {"code": "33333333", "confidence": 0.2}]}')
  ELSE '{"nothing": true}' END AS json FROM v_classifications"""


@query(
    "validate_payload",
    with_views("""SELECT id, unspsc_code, CASE id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE id % 6 WHEN 0 THEN 'ok' ELSE 'No reasoning provided by the model.' END AS reasoning,
CASE id % 6 WHEN 0 THEN '11111111' WHEN 4 THEN '22222222;33333333' ELSE '' END AS alternatives, CASE id % 6 WHEN 0 THEN 0.0 WHEN 4 THEN 0.1 END::DOUBLE AS first_alternative FROM v_classifications WHERE id % 6 IN (0, 1, 3, 4)"""),
)
def validate_payload(t: Tables) -> DataFrame:
    rows = t.sql(PAYLOADS).withColumn("item", F.try_parse_json("json")).drop("json")
    out = responses.classification_items(rows)
    return out.select("id", "unspsc_code", "confidence", "reasoning", F.col("alternatives.code").alias("alternatives"), F.get("alternatives.confidence", 0).alias("first_alternative"))


PARENTS = """SELECT id, name, CASE id % 6 WHEN 0 THEN concat('{"parent_name": "Holding ', industry, '", "parent_domain": "h.com", "is_subsidiary": true, "confidence": 0.88}') WHEN 1 THEN '{"parent_name": "N/A", "confidence": 0.3}'
  WHEN 2 THEN concat('{"parent": "', upper(name), ' Inc.", "confidence": 0.9}') WHEN 3 THEN '{"ultimate_parent": " Alphabet Inc ", "domain": "null"}' WHEN 4 THEN '{"parent_name": "X Corp", "is_subsidiary": false, "confidence": 2}' ELSE '{"parent_name": null}' END AS json FROM v_suppliers"""


@query(
    "parent_payload",
    with_views("""SELECT id, CASE id % 6 WHEN 0 THEN concat('Holding ', industry) WHEN 3 THEN 'Alphabet Inc' END AS parent_name, CASE id % 6 WHEN 0 THEN 'h.com' END AS parent_domain,
id % 6 IN (0, 3) AS is_subsidiary, CASE id % 6 WHEN 0 THEN 0.88 WHEN 1 THEN 0.3 WHEN 2 THEN 0.4 WHEN 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM v_suppliers"""),
)
def parent_payload(t: Tables) -> DataFrame:
    rows = t.sql(PARENTS).withColumn("item", F.try_parse_json("json")).drop("json")
    return responses.parent_items(rows, supplier_name="name").select("id", "parent_name", "parent_domain", "is_subsidiary", "confidence")


RUN = """work AS (SELECT p.supplier_id, p.mode FROM plan p JOIN v_list l ON l.id = p.supplier_id WHERE p.mode <> 'inherit' AND NOT coalesce(l.reviewed, FALSE)),
results AS (SELECT supplier_id, mode, 10000000 + ((supplier_id - 1) * 7919) % 90000000 AS code, CAST(((supplier_id - 1) % 100) / 100.0 AS DECIMAL(3,2)) AS conf FROM work),
scored_now AS (SELECT supplier_id, CASE WHEN EXISTS (SELECT 1 FROM v_taxonomy t WHERE t.code = CAST(r.code AS VARCHAR)) THEN conf ELSE least(conf, 0.4) END AS conf FROM results r),
heirs AS (SELECT p.supplier_id, CAST(floor(s.conf * 0.9 * 100 + 0.5) / 100 AS DECIMAL(3,2)) AS conf FROM plan p JOIN scored_now s ON s.supplier_id = p.inherit_from JOIN v_list l ON l.id = p.supplier_id WHERE p.mode = 'inherit' AND NOT coalesce(l.reviewed, FALSE)),
outcome AS (SELECT 'classified' AS status, conf FROM scored_now UNION ALL SELECT 'inherited', conf FROM heirs)"""


@query(
    "classify_run",
    with_views("SELECT status, count(*) AS suppliers, count(CASE WHEN conf < 0.7 THEN 1 END) AS low_confidence, sum(conf)::DOUBLE AS confidence_sum FROM outcome GROUP BY 1", ROOTS, MEMBERS, SCORED, PLAN, RUN),
)
def classify_run(t: Tables) -> DataFrame:
    return run_classify(t.registry, t.classifications, t.taxonomy, P, stub_score(), only_missing=False)["summary"]


@query("refresh_run")
def refresh_run(t: Tables) -> DataFrame:
    usage, everyone = aggregates.usage_daily(t.calls), max(1, t.registry.count())
    return run_refresh(t.registry, t.classifications, t.taxonomy, t.cache, usage, P, stub_score(), stub_lookup(), batch_size=everyone, max_batches=1)["summary"]
