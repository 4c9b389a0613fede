"""Files, tables, reports, streams and whole runs."""
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendweave.catalog.classify_queries import stub_score
from spendweave.operators import aggregates, review
from spendweave.operators.families import clusters, parent_options
from spendweave.operators.current import conform, supplier_list
from spendweave.operators.quality import required_tables
from spendweave.operators.filters import SupplierFilter, supplier_filter
from spendweave.params import Params
from spendweave.plans.classify import classify_run
from spendweave.plans.enrich import enrich_run
from spendweave.plans.refresh import refresh_run
from spendweave.plans.report import build_report
from spendweave.plans.resolve import ingest_files
from spendweave.session import cut
from spendweave.schemas import CLASSIFICATIONS, ENRICHMENT_CACHE, MODEL_USAGE, SUPPLIERS, TAXONOMY
from spendweave.sources import delimited
from spendweave.sources.tables import Lake
from spendweave.streaming import counters, ingest

P = Params(as_of=datetime(2024, 6, 1))


@pytest.mark.parametrize("line,want", [("a,b,c", ","), ("a;b;c", ";"), ("a\tb", "\t"), ("a|b|c,d", "|"), ("single", ",")])
def test_sniff(line, want):
    assert delimited.sniff_delimiter(line) == want


SAMPLE = """# a comment line
# another
Supplier Name;Spend;Date;Parent
DELL TECHNOLOGIES, INC.;$1,250.00;03/18/2024;
;;;
EMC Corporation;(500.25);2024-3-9;Dell Technologies
  ;9;;
"ACME; CO";n/a;;332722
Shifted;1;2;3;extra
Trailing;1;2;Maker;;
Short;5
"""


def test_read_and_map(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿" + SAMPLE.split("\n", 2)[2], encoding="utf-8")
    read = delimited.read_delimited(spark, str(path))
    assert (read.delimiter, read.headers) == (";", ["Supplier Name", "Spend", "Date", "Parent"])
    lines, rejects = delimited.map_supplier_columns(read.records, read.headers)
    got = [(r.name, r.amount and str(r.amount), r.date, r.parent_name) for r in lines.orderBy("row_no").collect()]
    assert got == [
        ("Dell Technologies, INC.", "1250.00", "2024-03-18", None), ("EMC Corporation", "-500.25", "2024-03-09", "Dell Technologies"), ("Acme; CO", None, None, None),
        ("Shifted", "1.00", None, None), ("Trailing", "1.00", None, "Maker"), ("Short", "5.00", None, None),
    ]
    assert rejects.count() == 1 and [r["Supplier Name"] for r in read.shifted.collect()] == ["Shifted"]
    assert sorted(r._fields for r in read.errors.collect()) == [2, 5, 6]


def test_ingest_with_comments(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(SAMPLE, encoding="utf-8")
    out = ingest_files(spark, str(path), conform(spark.range(0), SUPPLIERS), P, comment="#")
    assert out["summary"].first().created == 6 and out["audit"].count() == 6
    assert {r.normalized_name for r in out["suppliers"].collect()} >= {"dell technologies", "emc", "acme"}


def test_taxonomy_spellings(spark):
    rows = [("43-21-15-07", " Desktop   computer ", "IT", 1), ("4321150", "short", None, 2), ("43211508", " ", None, 3), ("43211507", "Desktop", "IT2", 4)]
    df = spark.createDataFrame(rows, "commodity_code string, title_en string, segment_en string, row_no long")
    got = delimited.load_taxonomy(df, "v1").collect()
    assert [(r.code, r.commodity, r.segment, r.segment_code, r.class_code) for r in got] == [("43211507", "Desktop", "IT2", "43", "432115")]


def test_a_later_taxonomy_goes_over_the_stored_one(spark, tmp_path):
    path = str(tmp_path / "taxonomy")
    release = lambda version, *rows: delimited.load_taxonomy(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "code string, title string, family string, row_no long"), version)
    delimited.write_taxonomy(release("v1", ("10101501", "Cats", "Animals"), ("10101502", "Dogs", "Animals"), ("20101501", "Drills", "Tools")), path)
    before = {f.name for f in (tmp_path / "taxonomy" / "segment_code=20").glob("*.parquet")}
    delimited.write_taxonomy(release("v2", ("10101502", "Hounds", None), ("30101501", "Pipes", "Metal")), path)
    got = sorted((r.code, r.commodity, r.family, r.version) for r in spark.read.parquet(path).collect())
    assert got == [("10101501", "Cats", "Animals", "v1"), ("10101502", "Hounds", None, "v2"), ("20101501", "Drills", "Tools", "v1"), ("30101501", "Pipes", "Metal", "v2")]
    assert {f.name for f in (tmp_path / "taxonomy" / "segment_code=20").glob("*.parquet")} == before  # not touched
    delimited.write_taxonomy(release("v3"), path)  # an empty load changes nothing
    assert spark.read.parquet(path).count() == 4


def test_named_versions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    table = lake.table("suppliers")
    assert table.read().count() == 0 and lake.present("monday") == []
    rows = conform(spark.range(3).withColumn("name", F.lit("a")).withColumn("normalized_name", F.lit("a")), SUPPLIERS)
    table.write(table.read().unionByName(rows), "monday")
    table.write(rows, "monday")  # a repeated run changes nothing
    table.write(table.read("monday").unionByName(rows), "tuesday")
    assert (table.read("monday").count(), table.read("tuesday").count()) == (3, 6)
    checked = {r.table_name: r.present for r in required_tables(spark, lake.present("monday"), ["suppliers", "reports"]).collect()}
    assert checked == {"suppliers": True, "reports": False}


def test_two_streams_late_files_and_a_replay(spark, tmp_path):
    """Entities' totals are state: files of two streams add up, late ones too, and a batch that comes twice counts once."""
    lake = str(tmp_path / "lake")
    base = conform(spark.createDataFrame([(7, "Supplier X", "supplier x", 100.0)], "id long, name string, normalized_name string, total_amount double"), SUPPLIERS)

    def arrive(stream, name, text):
        (tmp_path / stream).mkdir(exist_ok=True)
        (tmp_path / stream / name).write_text(text)
        return ingest.stream_ingest(spark, str(tmp_path / stream), lake, f"{lake}/{stream}", P)

    def totals(updates):
        return {r.key: (r.name, None if r.amount is None else str(r.amount), r.transaction_count, r.duplicates, r.industry) for r in ingest.folded(updates).collect()}

    first = totals(arrive("x", "a.csv", "name,amount\nSupplier x,1\n,2\nNameless amount,\n"))
    assert first == {"supplier x": ("Supplier x", "1.00", 1, 0, None), "nameless amount": ("Nameless amount", None, 1, 0, None)}
    second = totals(arrive("y", "a.csv", "Spend;Vendor;Sector\n3;Supplier y;Mining\n4;Supplier x;Steel;9\n5;Supplier y;Oil\n"))
    assert second["supplier x"] == ("Supplier x", "5.00", 2, 1, "Steel") and second["supplier y"] == ("Supplier y", "8.00", 2, 1, "Mining")
    added = spark.read.schema(ingest.ADDED).parquet(f"{lake}/added")
    cut(added)[0].write.mode("append").parquet(f"{lake}/added")  # as if every batch so far had been written twice
    late = arrive("x", "b.csv", "name,amount\nNameless amount,\nSUPPLIER X,0.25\n")
    assert totals(late) == second | {"supplier x": ("Supplier x", "5.25", 3, 2, "Steel"), "nameless amount": ("Nameless amount", "0.00", 2, 1, None)}
    out = ingest.registry(base, late, P)
    assert {(r.id, r.name, str(r.total_amount), r.transaction_count) for r in out["suppliers"].collect()} == {(7, "Supplier X", "105.25", 3), (8, "Nameless amount", "0.00", 2), (9, "Supplier y", "8.00", 2)}
    assert spark.read.parquet(f"{lake}/x-aside/rejects").count() == 1 and spark.read.parquet(f"{lake}/y-aside/shifted").count() == 1


def test_files_with_other_headers_keep_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount,country\nAcme,10,US\n")
    (tmp_path / "b.csv").write_text("country,name,amount\nDE,Borg,20\n")
    (tmp_path / "c.csv").write_text('name;"Amount; USD";country;Spend\n"Cern; Co";7;CH;30\n')
    lines, rejects = delimited.map_layouts(delimited.read_delimited(spark, str(tmp_path)))
    assert {(r.name, str(r.amount), r.country) for r in lines.collect()} == {("Acme", "10.00", "US"), ("Borg", "20.00", "DE"), ("Cern; Co", "30.00", "CH")}
    assert rejects.count() == 0


def test_quoted_headers():
    assert delimited.split_header('\ufeffname,"Amount, USD",,name', ",") == ["name", "Amount, USD", "column_3", "name_4"]
    assert delimited.sniff_delimiter('"a,b,c";d;e') == ";"


def test_rows_of_many_files_have_numbers_of_their_own(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.csv").write_text(f"name,amount\na{k},1\nb{k},2\n")
    read = delimited.read_delimited(spark, str(tmp_path))
    assert read.records.select("_row").distinct().count() == read.records.count() == 1200


def test_an_empty_file_set(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n")
    read = delimited.read_delimited(spark, str(tmp_path))
    assert (read.records.count(), read.errors.count(), read.shifted.count()) == (0, 0, 0)
    assert [x.count() for x in delimited.map_layouts(read)] == [0, 0]


LIST = [
    (1, "Dell", "1000", None, "43211500", "0.95", False, True, False, datetime(2024, 5, 30)), (2, "EMC", "500", 1, "43211500", "0.85", True, False, False, datetime(2024, 5, 30)),
    (3, "Grainger", "250", None, "40141600", "0.50", False, False, False, datetime(2024, 5, 30)), (4, "Unclassified Co", "100", None, None, None, None, False, True, None),
]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame(
        [(i, n, Decimal(a), p, c, None if x is None else Decimal(x), h, ip, s, e) for i, n, a, p, c, x, h, ip, s, e in LIST],
        "id long, name string, total_amount decimal(18,2), parent_id long, effective_code string, confidence decimal(3,2), inherited_from_parent boolean, is_parent boolean, stale boolean, enriched_at timestamp_ntz",
    )
    df = df.withColumn("classification_id", F.when(F.col("effective_code").isNotNull(), F.col("id"))).withColumn("reviewed", F.when(F.col("effective_code").isNotNull(), False))
    return df.withColumn("segment", F.when(F.substring("effective_code", 1, 2) == "43", "IT")).select("*", *[F.lit(None).cast("string").alias(c) for c in ("commodity", "reasoning", "llm_model", "parent_name")])


def test_summary(rows):
    s = aggregates.report_summary(rows, P).first().asDict()
    assert s == {
        "total_suppliers": 4, "total_spend": Decimal("1850.00"), "classified": 3, "unclassified": 1, "percent_classified": 75.0, "low_confidence": 1, "percent_low_confidence": 25.0,
        "reviewed": 0, "inherited": 1, "stale": 1, "parents": 1, "subsidiaries": 1, "average_confidence": 0.767,
    }
    empty = aggregates.report_summary(rows.limit(0), P).first()
    assert (empty.total_suppliers, empty.total_spend, empty.percent_classified, empty.average_confidence) == (0, 0, 0.0, None)


def test_segments_and_appendix(rows):
    got = [(r.segment_code, r.segment, r.suppliers, r.spend_share) for r in aggregates.segment_breakdown(rows).collect()]
    assert got == [("43", "IT", 2, 81.1), ("40", "Unmapped segment", 1, 13.5), ("--", "Not classified", 1, 5.4)]
    assert [r.supplier_id for r in review.low_confidence_rows(rows, P).collect()] == [4, 3]


def test_filter_parsing():
    assert SupplierFilter.parse({"min_confidence": "0.5", "only_stale": "true", "state": "bogus", "supplier_ids": "1,2"}) == SupplierFilter(min_confidence=0.5, only_stale=True, supplier_ids=(1, 2))
    assert SupplierFilter.parse({"min_confidence": "7"}) == SupplierFilter() == SupplierFilter.parse({"parent_id": "x"})
    assert SupplierFilter(segment="43", only_parents=True, date_from="2024-01-01", rollup="parent").describe() == ["heads of families = yes", "segment code = 43", "enriched from = 2024-01-01", "rows per = parent"]


@pytest.fixture
def registry(spark):
    names = ["Maker 1", "Maker 2", "Maker 3", "Maker 14", "Maker 5"]
    df = spark.createDataFrame([(i, n, n.lower(), Decimal(100 * i), {2: 1, 3: 1}.get(i)) for i, n in enumerate(names, 1)], "id long, name string, normalized_name string, total_amount decimal(18,2), parent_id long")
    moment = F.lit("2024-01-01").cast("timestamp")
    return conform(df.withColumn("is_parent", F.col("id") == 1).withColumn("stale", F.lit(False)).withColumn("created_at", moment).withColumn("updated_at", moment).withColumn("enriched_at", moment), SUPPLIERS)


@pytest.fixture
def taxonomy(spark):
    df = spark.createDataFrame([(str(10000000 + n * 7919),) for n in (1, 2, 3, 14)], "code string")
    return df.select("code", F.substring("code", 1, 2).alias("segment_code"), *[F.lit(c).alias(c) for c in ("segment", "family", "class", "commodity")])


def test_filtered_parent_leaves_child_alone(spark, registry, taxonomy):
    history = conform(spark.range(0), CLASSIFICATIONS)
    report = build_report(registry, history, taxonomy, P, SupplierFilter(only_subsidiaries=True))
    assert {r.cluster_key for r in report.rollup.collect()} == {"s:2", "s:3"}
    whole = build_report(registry, history, taxonomy, P)
    assert [(r.cluster_key, r.subsidiary_count) for r in parent_options(clusters(whole.members)).collect()] == [("s:1", 2)]
    listed = supplier_list(registry, history, taxonomy)
    assert [r.id for r in supplier_filter(listed, SupplierFilter(parent="Maker 1"), P).orderBy("id").collect()] == [2, 3]


def test_classify_run_retries_and_propagates(spark, registry, taxonomy):
    history = conform(spark.range(0), CLASSIFICATIONS)
    out = classify_run(registry, history, taxonomy, P, stub_score())
    status = {r.status: r.suppliers for r in out["summary"].collect()}
    assert status == {"classified": 3, "inherited": 2}  # Maker 14 is left out of the batch answer and asked again
    live = {r.supplier_id: (r.unspsc_code, str(r.confidence), r.inherited_from_supplier_id) for r in out["history"].where("not superseded").collect()}
    one = str(10000000 + 7919)
    # Maker 1 is flagged as a parent, so it tells most and speaks for its family
    assert live[1] == (one, "0.01", None) and live[2] == (one, "0.01", 1) and live[3][2] == 1
    assert live[4] == (str(10000000 + 14 * 7919), "0.14", None) and live[5] == (one, "0.05", None)
    again = classify_run(registry, out["history"], taxonomy, P, stub_score())
    assert again["summary"].count() == 0
    alone = classify_run(registry, history, taxonomy, P, stub_score(), ids=spark.createDataFrame([(2,)], "id long"))
    assert [(r.status, r.suppliers) for r in alone["summary"].collect()] == [("skipped", 1)]


def test_classify_run_reads_its_tables_once(spark, registry, taxonomy, monkeypatch):
    """The taxonomy is worked out once and read back, and heirs need no second look at the history (F9)."""
    from spendweave.plans import classify

    written = []
    monkeypatch.setattr(classify, "cut", lambda df, **k: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, **k))
    named = taxonomy.withColumn("segment", F.lit("only here"))
    classify_run(registry, conform(spark.range(0), CLASSIFICATIONS), named, P, stub_score())
    assert sum("only here" in plan for plan in written) == 1
    assert not any("superseded" in plan for plan in written)


def test_enrich_run_keeps_data_and_caches(spark, registry):
    def lookup(pdf):
        out = pdf[["id"]].copy()
        out["payload"] = ['{"domain": "m%d.com", "parent_name": "Big Holding"}' % i if i != 5 else None for i in pdf["id"]]
        out["error"] = [None if i != 5 else "HTTP 500" for i in pdf["id"]]
        out["credits"] = 1
        return out

    def detect(pdf):
        out = pdf[["model", "batch_no"]].copy()
        out["response"] = '{"results": [{"parent_name": "Found Inc", "is_subsidiary": true, "confidence": 0.7}]}'
        return out

    cache = conform(spark.range(0), ENRICHMENT_CACHE)
    first = enrich_run(registry, cache, P, lookup=lookup, detect=detect, targets=registry)
    assert {r.status: r.suppliers for r in first["summary"].collect()} == {"enriched": 4, "failed": 1}
    got = {r.id: r for r in first["suppliers"].collect()}
    assert (got[1].domain, got[1].parent_name, got[1].parent_source, got[1].stale) == ("m1.com", "Big Holding", "enrichment", False)
    assert got[5].last_enrich_error is None and (got[5].parent_name, got[5].parent_source) == ("Found Inc", "llm")
    second = enrich_run(registry, first["cache"], P, lookup=lookup, targets=registry)
    assert {r.status: r.suppliers for r in second["summary"].collect()} == {"cached": 4, "failed": 1}
    assert {r.id: (r.stale, r.stale_reason) for r in second["suppliers"].collect()}[5] == (True, "enrichment_failed")


def test_report_files(spark, registry, taxonomy, tmp_path):
    history = conform(spark.range(0), CLASSIFICATIONS)
    report = build_report(registry, history, taxonomy, P)
    assert report.write(str(tmp_path / "r")) == ["suppliers", "segments", "rollup", "review", "hierarchy"]
    back = spark.read.option("header", True).csv(str(tmp_path / "r" / "hierarchy"))
    assert back.where("role = 'parent'").count() == 3 and back.where("role = 'subsidiary'").count() == 2
    assert len(spark.read.option("header", True).csv(str(tmp_path / "r" / "suppliers")).columns) == 25
    assert report.metadata.first().total_suppliers == 5


def test_stream_ingest_equals_batch(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    run = lambda: ingest.stream_ingest(spark, str(folder), str(tmp_path / "lake"), str(tmp_path / "cp"), P, files_per_batch=1)
    assert run().count() == 0  # nothing has arrived yet
    for n in range(3):
        (folder / f"f{n}.csv").write_text(f"supplier,amount\nAcme Inc,{n + 1}\nACME,10\nBeta {n},5\n")
    for _ in range(2):  # the second run finds nothing new
        updates = run()
    got = {r.normalized_name: (r.total_amount, r.transaction_count) for r in ingest.registry(conform(spark.range(0), SUPPLIERS), updates, P)["suppliers"].collect()}
    assert got == {"acme": (Decimal("36.00"), 6), "beta 0": (Decimal("5.00"), 1), "beta 1": (Decimal("5.00"), 1), "beta 2": (Decimal("5.00"), 1)}
    assert spark.read.parquet(str(tmp_path / "lake" / "added")).select("batch").distinct().count() == 3


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "model string, ts timestamp, prompt_tokens long, completion_tokens long, failures int"
    batches = [[("m", "2024-01-01 10:00:00"), ("m", "2024-01-03 10:00:00")], [("m", "2024-01-01 11:00:00"), ("m", "2024-01-03 11:00:00")]]
    source = str(tmp_path / "calls")
    for n, rows_ in enumerate(batches):
        df = spark.createDataFrame([(m, datetime.fromisoformat(t), 1, 1, 0) for m, t in rows_], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        calls = spark.readStream.schema(schema).parquet(source)
        counters.run_available(counters.usage_stream(calls), ["window_start", "model"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = {str(r.window_start.date()): r.request_count for r in counters.latest(spark.read.parquet(str(tmp_path / "out")), ["window_start", "model"]).collect()}
    assert got == {"2024-01-01": 1, "2024-01-03": 2}


def test_refresh_counts_its_steps_and_tells_why_it_stopped(spark):
    rows = [(1, "Alpha", "alpha", True), (2, "Beta", "beta", True), (3, "Gamma", "gamma", False)]
    moment = P.as_of
    suppliers = conform(spark.createDataFrame(rows, "id long, name string, normalized_name string, stale boolean").withColumn("enriched_at", F.lit(moment)).withColumn("is_parent", F.lit(False)), SUPPLIERS)
    empty = lambda schema: spark.createDataFrame([], schema)

    def lookup(frame):
        good = frame["name"] == "Alpha"
        frame["payload"] = ['{"domain": "alpha.com", "industry": "Mining", "parent_name": "Gamma"}' if g else None for g in good]
        frame["error"] = [None if g else "not found" for g in good]
        return frame.assign(credits=1)

    out = refresh_run(suppliers, empty(CLASSIFICATIONS), empty(TAXONOMY), empty(ENRICHMENT_CACHE), empty(MODEL_USAGE), P, None, lookup, mode="enrich", batch_size=1, max_batches=5)
    got = out["summary"].first()
    assert (got.stopped, got.candidates, got.enriched, got.enrichment_failed, got.stale_marked, got.batches, got.links) == ("completed", 2, 1, 1, 1, 2, 1)
    events = {(r.entity, r.entity_id, r.action) for r in out["audit"].collect()}
    assert events == {("sync", None, "synced"), ("supplier", 1, "enriched"), ("supplier", 2, "enrich_failed"), ("supplier", 1, "parent_linked")}
    assert {(r.id, r.parent_id) for r in out["suppliers"].collect()} == {(1, 3), (2, None), (3, None)}
    calm = refresh_run(suppliers.withColumn("stale", F.lit(False)), empty(CLASSIFICATIONS), empty(TAXONOMY), empty(ENRICHMENT_CACHE), empty(MODEL_USAGE), P, None, lookup, mode="enrich")["summary"].first()
    assert (calm.stopped, calm.candidates, calm.batches) == ("no_work", 0, 0)


def test_header_lines_hold_places_only(spark, tmp_path):
    """The first line of each file, without an aggregate that sorts the lines (F8)."""
    (tmp_path / "a.csv").write_text("\n  \n# note\nname,amount\nA,1\n")
    (tmp_path / "b.csv").write_text("name;amount\nB;2\n")
    heads = delimited.header_lines(spark, str(tmp_path), "#")
    assert sorted(r.header for r in heads.collect()) == ["name,amount", "name;amount"]
    assert "min_by(value" not in heads._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_worked_out_once(spark, tmp_path):
    """Amounts of named rows need one replacement by pattern a row: no test of a row rewrites its cells (F4)."""
    (tmp_path / "a.csv").write_text("Vendor;Spend;Sector\nAcme;1.5;x\n ;2;\n   ;;\n")
    read = delimited.read_delimited(spark, str(tmp_path))
    lines, rejects = delimited.map_supplier_columns(read.records, read.headers)
    assert ([str(r.amount) for r in lines.collect()], rejects.count(), read.records.count()) == (["1.50"], 1, 2)
    assert lines.select("amount")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_entities_share_a_call(spark):
    """One call brings all entities of a shard forward (F1)."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    given = pd.DataFrame([(k, k.upper(), 2, Decimal("1.50"), 2, Decimal(n), "{}", "s", 0) for n, k in enumerate("ab")], columns="key name line_count amount transaction_count row_no texts source batch".split())
    out = pd.concat(list(ingest._advance((7,), iter([given, given]), state)))
    assert {(r.key, r.name, r.amount, r.line_count) for r in out.itertuples(index=False)} == {("a", "A", Decimal("1.50"), 2), ("b", "B", Decimal("1.50"), 2)}
    assert list(ingest._advance((7,), iter([given]), state)) == []
