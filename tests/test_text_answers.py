"""Provider payloads and scorer answers."""
import json

import pytest
from pyspark.sql import functions as F

from spendweave.functions.payloads import FIELDS, normalize_directory, normalize_generic, normalize_tech
from spendweave.operators import batches, responses


def mapped(spark, normalize, *payloads):
    df = spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string")
    return [r.asDict() for r in normalize(df).orderBy("id").collect()]


PROFILE = {"name": "Microsoft", "about": "Every company has a mission.", "industries": "Software Development", "website": "https://news.microsoft.com/", "country_code": "US,AU,CA", "url": "https://www.linkedin.com/company/microsoft"}


def test_directory_records(spark):
    got = mapped(
        spark, normalize_directory,
        {"website": "https://www.dell.com", "industry": "IT Services", "country": "United States", "description": "Makes hardware."},
        {"data": {"company_website": "emc.com", "sector": "Data Storage", "short_description": "Storage.", "location": {"country": "United States"}, "parent": {"name": "Dell Technologies", "domain": "dell.com"}}},
        {"industries": ["Software", {"name": "IT Services"}, " "]}, {"about": {"description": "Nested."}}, {"parent_company": "Siemens AG"}, {"naics": "NAICS 334111", "sic": "SIC 3571"},
        {"unmapped": "value", "another": 42}, None, "nonsense", "[1,2,3]", PROFILE, {k: v for k, v in PROFILE.items() if k != "website"},
        {"country": "Redmond, Washington, United States"}, {"url": "https://www.zoominfo.com/c/acme"}, {"website": "https://notlinkedin.com"},
    )
    assert (got[0]["domain"], got[0]["industry"], got[0]["country"]) == ("dell.com", "IT Services", "United States")
    assert (got[1]["domain"], got[1]["industry"], got[1]["country"], got[1]["parent_name"], got[1]["parent_domain"]) == ("emc.com", "Data Storage", "United States", "Dell Technologies", "dell.com")
    assert got[2]["industry"] == "Software, IT Services" and got[3]["description"] == "Nested." and got[4]["parent_name"] == "Siemens AG"
    assert (got[5]["naics"], got[5]["sic"]) == ("334111", "3571")
    for i in (6, 7, 8, 9):
        assert {got[i][f] for f in FIELDS} == {None}
    assert (got[10]["domain"], got[10]["industry"], got[10]["country"], got[10]["description"]) == ("microsoft.com", "Software Development", "US", "Every company has a mission.")
    assert got[11]["domain"] is None and got[12]["country"] is None and got[13]["domain"] is None and got[14]["domain"] == "notlinkedin.com"


def test_generic_and_tech(spark):
    got = mapped(spark, normalize_generic, {"company": {"homepage": "http://a.co.uk/x", "industry": {"label": "Steel", "code": 3311}, "parent_company": {"legal_name": "Big Co", "url": "big.com"}, "location": {"country": "UK"}}}, {"result": {"tagline": "x" * 1300}})
    assert (got[0]["domain"], got[0]["industry"], got[0]["naics"], got[0]["parent_name"], got[0]["parent_domain"], got[0]["country"]) == ("a.co.uk", "Steel", "3311", "Big Co", "big.com", "UK")
    assert len(got[1]["description"]) == 1200 and got[1]["description"].endswith("…")
    tech = mapped(spark, normalize_tech, {"data": {"parent": "Holding", "technologies": ["a", "b"]}}, {"parentCompany": "P2", "description": "kept", "technologies": ["a"]})
    assert (tech[0]["parent_name"], tech[0]["description"], tech[1]["parent_name"], tech[1]["description"]) == ("Holding", "Technologies: a, b", "P2", "kept")


ANSWERS = {
    '{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', 'Here you go: {"a":"}{"} — done.': '{"a":"}{"}', '[{"a":1}]': '[{"a":1}]', "﻿ {\"a\":1}": '{"a":1}',
    "no json here": None, 'cut { "a": 1': None, "": "",
}


def test_json_text(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "response string")
    assert {r.response: r.json for r in responses.json_text(df).collect()} == ANSWERS


def items(spark, *payloads):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "id int, json string")
    return responses.answer_items(responses.parse_json(df), responses.CODE_WRAPPERS, ["unspsc_code", "code"])


def test_wrappers_and_repair(spark):
    one = {"unspsc_code": "43211500"}
    got = items(spark, {"results": [one, one]}, [one], one, {"nonsense": True}, '{"items": [{"code": 1},],}', {"results": "x", "data": [one]})
    assert {r.id: r.n for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 1, 4: 1, 5: 1}


def test_item_validation(spark):
    got = {r.id: r for r in responses.classification_items(items(
        spark, {"unspsc_code": "43211500", "confidence": 0.95, "reasoning": "Makes computers.", "alternatives": [{"code": "43211600", "confidence": 0.4}]}, {"unspsc_code": 43211500}, {"unspsc_code": "43-211-500", "confidence": 5},
        {"unspsc_code": "not-a-code"}, {"unspsc_code": "432115"}, {"unspsc_code": "43211500", "confidence": -3},
        {"unspsc_code": "43211500", "alternatives": [{"code": "43211500"}, {"code": "43211600", "confidence": 0.5}, {"code": "bad"}, {"code": "43211600"}]},
    )).collect()}
    assert sorted(got) == [0, 1, 2, 5, 6]
    assert (got[0].confidence, got[0].reasoning, len(got[0].alternatives)) == (0.95, "Makes computers.", 1)
    assert (got[1].unspsc_code, got[1].confidence, got[2].confidence, got[5].confidence) == ("43211500", 0.5, 1.0, 0.0)
    assert [(a.code, a.confidence) for a in got[6].alternatives] == [("43211600", 0.5)]


def test_parent_answers(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate([
        {"parent_name": "Microsoft Corporation", "parent_domain": "microsoft.com", "is_subsidiary": True, "confidence": 0.88}, {"parent_name": None, "is_subsidiary": False}, {"parent_name": "null"}, {"parent_name": "Alphabet Inc"}, {"parent": "LINKEDIN, Inc."},
    ])], "id int, json string").withColumn("item", F.try_parse_json("json")).withColumn("name", F.lit("LinkedIn"))
    got = [(r.parent_name, r.is_subsidiary, r.confidence) for r in responses.parent_items(df.drop("json"), "name").orderBy("id").collect()]
    assert got == [("Microsoft Corporation", True, 0.88), (None, False, 0.5), (None, False, 0.5), ("Alphabet Inc", True, 0.5), (None, False, 0.4)]


@pytest.fixture
def two_batches(spark):
    rows = spark.createDataFrame([(i, f"Name {i}", "m") for i in range(1, 6)], "id long, name string, model string")
    for c in ("domain", "industry", "naics", "sic", "description", "parent_name"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return batches.request_batches(rows, 3)


def test_prompts_hold_a_batch(two_batches):
    prompts = {r.batch_no: r.prompt for r in batches.batch_prompts(two_batches, 3, "none").collect()}
    assert sorted(prompts) == [1, 2] and '{"n":3,"supplier":{"name":"Name 3"' in prompts[1] and "(2)" in prompts[2] and '{"n":1,"supplier":{"name":"Name 4"' in prompts[2]


def test_alignment_by_name_then_position(spark, two_batches):
    answers = spark.createDataFrame([("m", 1, 1, "NAME 2 Inc", "22222222"), ("m", 1, 2, None, "33333333"), ("m", 1, 3, "Unheard of", "44444444"), ("m", 2, 9, None, "55555555")], "model string, batch_no long, item_no int, supplier_name string, unspsc_code string")
    answered, missing = batches.align_results(two_batches, answers, 3)
    assert {(r.supplier_id, r.unspsc_code) for r in answered.collect()} == {(2, "22222222"), (3, "44444444")}
    assert sorted(r.id for r in missing.collect()) == [1, 4, 5]


def test_a_raising_scorer_loses_its_own_batch_only(two_batches):
    def score(pdf):
        if (pdf.batch_no == 2).any():
            raise RuntimeError("no answer")
        return pdf.assign(response="{}")

    answers = {r.batch_no: r.response for r in batches.score_batches(batches.batch_prompts(two_batches, 3, ""), score).collect()}
    assert answers == {1: "{}", 2: None}


def test_quotes_in_names_stay_in_their_line(two_batches):
    rows = two_batches.withColumn("name", F.lit('A "B"\nC'))
    prompts = [r.prompt for r in batches.batch_prompts(rows, 3, "").collect()]
    assert all('"name":"A \\"B\\"\\nC"' in p for p in prompts)
