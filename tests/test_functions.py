from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from spendweave.functions import domains, text, values
from spendweave.params import Params


def test_entity_keys(column):
    pairs = {
        "Dell Technologies, Inc.": "dell technologies", "ACME  CO., LTD": "acme", "Acme Co": "acme", "Barnes & Noble": "barnes and noble",
        "Barnes and Noble, Inc.": "barnes and noble", "Ernst & Young LLP": "ernst and young", "Kuehne + Nagel": "kuehne and nagel", "Siemens AG": "siemens", "SAP SE": "sap",
        "Unilever Group": "unilever", "Group": "group", "Limited": "limited", "": "", "   ": "", " Acme ": "acme", "Pty Ltd": "pty ltd",
        "Co Pty Ltd": "co", "Group Limited": "group", "Limited Partnership Group": "limited partnership group", "Pty Limited Partnership": "pty", "Foo GmbH & Co. KG": "foo gmbh and",
        "X-Ray A–B": "x-ray a b", "Proprietary Limited Liability Company": "proprietary",
    }
    assert column(text.entity_key, list(pairs)) == list(pairs.values())


def test_display_and_suffix(column):
    assert column(text.entity_display, ["  ACME   CO., LTD ", "..."]) == ["ACME CO LTD", "..."]
    assert column(text.had_legal_suffix, ["Dell Technologies, Inc.", "Dell Technologies", "Pty Ltd", "Group"]) == [True, False, True, False]


def test_title_case(column):
    given = ["DELL TECHNOLOGIES", "IBM CORPORATION", "Dell Technologies", "ACME", "AT&T WIRELESS", "THE BIG COMPANY"]
    assert column(text.title_case, given) == ["Dell Technologies", "IBM Corporation", "Dell Technologies", "ACME", "AT&T Wireless", "THE BIG Company"]


def test_domains(column):
    pairs = {
        "https://www.dell.com/en-us/shop": "dell.com", "http://grainger.com": "grainger.com", "orders@acme.co.uk": "acme.co.uk", "www.microsoft.com": "microsoft.com",
        "siemens-healthineers.com:443": "siemens-healthineers.com", "sub.domain.example.co.jp/path": "example.co.jp", "co.uk": "co.uk", "": None, "not a domain": None, "localhost": None,
        "...": None, ".a.com": None, "a..com": None, "WWW2.Foo.Com.?a": "foo.com", None: None,
    }
    assert column(domains.registrable_domain, list(pairs)) == list(pairs.values())
    assert column(domains.company_domain, ["https://www.linkedin.com/x", "https://notlinkedin.com", "x.com"]) == [None, "notlinkedin.com", None]
    assert column(domains.guessed_domain, ["Grainger", "Dell Technologies, Inc.", "3M", "AB Corp"]) == ["grainger.com", "dell.com", None, None]
    assert column(domains.single_word_domain, ["Grainger Inc", "Dell Technologies", "Abc"]) == ["grainger.com", None, None]


def test_lookup_url(spark):
    df = spark.createDataFrame([("Dell Technologies", "https://www.dell.com/"), ("X", None)], "n string, d string")
    url = lambda template: [r[0] for r in df.select(domains.lookup_url(F.col("n"), F.col("d"), template)).collect()]
    assert url("https://l.com/{slug}") == ["https://l.com/dell", "https://l.com/"]
    assert url("{domain} {name}") == ["dell.com Dell Technologies", "X"]
    assert url("   ") == ["https://dell.com", None]


def test_dates(column):
    pairs = {
        "2024-03-01": "2024-03-01", "2024-3-9": "2024-03-09", "03/18/2024": "2024-03-18", "18/03/2024": "2024-03-18", "2024-03-01T12:00:00Z": "2024-03-01", "1.2.24": "2024-01-02",
        "Mar 5, 2024": "2024-03-05", "31/31/2024": None, "junk": None, "": None, None: None,
    }
    assert column(values.iso_date, list(pairs)) == list(pairs.values())


def test_money(column):
    given = ["$1,250.00", "$1,250,000.00", "1.234,56", "(500.25)", "1250", "n/a", "", None, "12-34", "1,234", "1,234,567", "(5"]
    want = ["1250", "1250000", "1234.56", "-500.25", "1250", None, None, None, "-1234", "1.23", None, "-5"]
    assert column(values.money, given) == [None if w is None else Decimal(w).quantize(Decimal("0.01")) for w in want]
    leading = column(lambda c: values.money(c, minus="leading"), ["12-34", "-5", "(5", "(5)"])
    assert leading == [None, Decimal("-5.00"), Decimal("5.00"), Decimal("-5.00")]
    assert column(lambda c: values.money(c, style="us"), ["1,234", "1,234,567.5"]) == [Decimal("1234.00"), Decimal("1234567.50")]
    assert column(lambda c: values.money(c, style="eu"), ["1.234", "1.234,5"]) == [Decimal("1234.00"), Decimal("1234.50")]


def test_codes(column):
    assert column(values.coerce_code, ["43211500", "43-211-500", "4321150", "nope", None]) == ["43211500", "43211500", "04321150", None, None]
    assert column(values.is_code, ["43211500", "4321150", "4321150a", None]) == [True, False, False, False]
    assert [values.code_prefix(v) for v in ("43", "43-211-500", "", None)] == ["43", "43211500", None, None]


def test_parents(column):
    given = ["Dell Technologies", "3M", "332722", "  ", None, "123-456", "9" * 201, "!!! ???"]
    assert column(text.sanitize_parent, given) == ["Dell Technologies", "3M"] + [None] * 6
    assert column(text.parent_in_name, ["Acme Robotics, a Schneider Electric company", "Acme"]) == ["Schneider Electric", None]


def test_keywords(column):
    words = column(lambda c: text.keywords(c, 8), ["Industrial supplies merchant wholesalers of the company", None, "   ", "software software platform 12345 data-lake"])
    assert words == [["industrial", "supplies", "merchant", "wholesalers"], [], [], ["software", "platform", "data-lake"]]


def test_hash_and_rounding(column, spark):
    assert column(text.fnv1a, ["a", "", "abc"]) == ["e40c292c", "811c9dc5", "1a47e90b"]
    assert column(lambda c: values.round_to(c, 2), [1.005, 2.675, 0.0], "double") == [1.01, 2.68, 0.0]

    def mark(domain=None, industry=None, parent=None):
        cells = [F.lit(v).cast("string") for v in (domain, industry, None, None, parent, None)]
        return spark.range(1).select(text.enrichment_fingerprint(*cells)).first()[0]

    assert mark("DELL.com") == mark("dell.com") and mark("dell.com") != mark("dell.com", "IT") and mark("dell.com") != mark("dell.com", parent="Dell")


def test_bands_and_ages(spark, column):
    params = Params()
    assert column(lambda c: values.confidence_band(c, params), [0.9, 0.85, 0.7, 0.69, None], "double") == ["high", "high", "medium", "low", "none"]
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:00:00' t UNION ALL SELECT TIMESTAMP_NTZ '2025-01-01 00:00:00' t")
    assert sorted(r[0] for r in rows.select(values.age_days(F.col("t"), datetime(2024, 1, 3, 1))).collect()) == [0, 1]


def test_long_words_stay_whole(column):
    word = "A" + "B" * 20_000
    assert column(text.title_case, [word]) == ["A" + "b" * 20_000]


def test_money_reads_a_cell_once(spark):
    """One replacement by pattern a cell, whatever the branches are (F7)."""
    cells = spark.createDataFrame([("1.234,50 EUR",), ("($1,234.50)",), ("12-",), (".",), ("n/a",), (None,)], "v string")
    read = cells.select(values.money(cells.v).alias("a"))
    assert [None if r.a is None else str(r.a) for r in read.collect()] == ["1234.50", "-1234.50", "-12.00", None, None, None]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
