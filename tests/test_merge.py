from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from spendweave.operators import history as h
from spendweave.operators import merge
from spendweave.operators.aggregates import fold_lines
from spendweave.operators.current import conform, current_classification
from spendweave.params import Params
from spendweave.plans.resolve import resolve_entities
from spendweave.schemas import CLASSIFICATIONS, SUPPLIERS

P = Params(as_of=datetime(2024, 6, 1))
KNOWN = dict(
    id=1, name="Dell Technologies", normalized_name="dell technologies", domain="dell.com", industry="Computer manufacturing", naics="334111", description="Computers", total_amount=Decimal("1000.00"),
    transaction_count=3, currency="USD", is_parent=False, stale=True, stale_reason="old", enriched_at=datetime(2024, 1, 1), created_at=datetime(2024, 1, 1), updated_at=datetime(2024, 1, 1),
)


def table(spark, schema, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema_nullable(schema))


def schema_nullable(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def merged(spark, incoming, overwrite=False, **existing):
    old = table(spark, SUPPLIERS, KNOWN | existing)
    kinds = {f.name: f.dataType.simpleString() for f in SUPPLIERS.fields}
    cells = {"id": 1} | incoming
    new = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {kinds[k]}" for k in cells))
    return merge.merge_fields(old, new, P, overwrite=overwrite).first()


def test_blank_never_erases(spark):
    row = merged(spark, {"domain": None, "industry": "", "naics": None, "description": "   "})
    assert row.changed_fields == [] and row.industry == "Computer manufacturing" and row.stale


def test_gaps_are_filled_and_stale_cleared(spark):
    row = merged(spark, {"country": "US", "sic": "3571"})
    assert sorted(row.changed_fields) == ["country", "sic"] and not row.stale and row.updated_at == P.as_of


def test_domain_is_normalised_and_replaced(spark):
    assert merged(spark, {"domain": "https://www.emc.com/en"}).domain == "emc.com"
    assert merged(spark, {"domain": "nonsense"}).changed_fields == []


def test_longer_text_wins_shorter_never(spark):
    assert merged(spark, {"description": "Personal computers and servers"}).description == "Personal computers and servers"
    assert merged(spark, {"description": "Short."}).changed_fields == []
    assert merged(spark, {"industry": "IT"}, overwrite=True).industry == "IT"


def test_amount_set_count_added(spark):
    row = merged(spark, {"total_amount": Decimal("500.00"), "transaction_count": 2})
    assert (row.total_amount, row.transaction_count, row.changed_fields) == (Decimal("500.00"), 5, ["total_amount", "transaction_count"]) and row.stale


def test_enriched_at_only_forward(spark):
    assert merged(spark, {"enriched_at": datetime(2023, 1, 1)}).changed_fields == []
    assert merged(spark, {"enriched_at": datetime(2024, 5, 1)}).enriched_at == datetime(2024, 5, 1)


def test_reclassification_triggers(spark):
    df = spark.createDataFrame([(["industry"],), (["parent_name"],), (["total_amount", "country"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(merge.needs_reclassification(F.col("c"))).collect()] == [True, True, False, False]


LINES = [(0, "ACME  CO., LTD", "10.00", None), (1, "Acme Co", None, "acme.com"), (2, "acme", "5.50", "other.com"), (3, "Beta", None, None), (4, " ", "9.00", None)]


def lines(spark, rows=LINES):
    df = spark.createDataFrame(rows, "row_no long, name string, amount string, domain string")
    return df.withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_fold_sums_and_first_text(spark):
    got = {r.key: (r.name, r.line_count, r.amount, r.domain) for r in fold_lines(lines(spark)).collect()}
    assert got == {"acme": ("Acme CO., LTD", 3, Decimal("15.50"), "acme.com"), "beta": ("Beta", 1, None, None)}


def test_upsert_creates_updates_and_is_idempotent(spark):
    start = table(spark, SUPPLIERS, KNOWN)
    given = lines(spark, LINES + [(5, "DELL TECHNOLOGIES INC", "70.00", None)])
    once = resolve_entities(given, start, P)
    assert once["summary"].first().asDict() == {"created": 2, "updated": 1, "unchanged": 0, "needs_reclassification": 0, "total_rows": 5, "duplicate_rows": 2}
    ids = {r.normalized_name: r.id for r in once["suppliers"].collect()}
    assert ids == {"dell technologies": 1, "acme": 2, "beta": 3}
    twice = resolve_entities(given, once["suppliers"], P)
    amounts = {r.normalized_name: r.total_amount for r in twice["suppliers"].collect()}
    assert amounts == {"dell technologies": Decimal("70.00"), "acme": Decimal("15.50"), "beta": None}
    assert twice["suppliers"].count() == 3
    added = resolve_entities(given, once["suppliers"], P, amount_mode="add")["suppliers"]
    assert {r.normalized_name: r.total_amount for r in added.collect()}["acme"] == Decimal("31.00")


def test_mark_stale_is_null_safe(spark):
    df = table(spark, SUPPLIERS, KNOWN | {"stale": False, "stale_reason": None}, KNOWN | {"id": 2, "stale_reason": "x"})
    out = merge.mark_stale(df, spark.createDataFrame([(1, "x"), (2, "x")], "id long, reason string"), P)
    assert {(r.id, r.stale, r.newly_marked) for r in out.collect()} == {(1, True, True), (2, True, False)}


def row(i, supplier, code="43211507", superseded=False, **more):
    return dict(id=i, supplier_id=supplier, unspsc_code=code, confidence=Decimal("0.80"), inherited_from_parent=False, reviewed=False, superseded=superseded, created_at=datetime(2024, 1, 1)) | more


def test_history_has_one_live_row_and_stays_superseded(spark):
    old = table(spark, CLASSIFICATIONS, row(1, 1, superseded=True), row(2, 1), row(3, 2), row(4, 3, superseded=True))
    new = spark.createDataFrame([(1, "11111111", 0.5), (1, "22222222", 7.0), (5, "33333333", 0.1)], "supplier_id long, unspsc_code string, confidence double")
    out = h.write_classifications(old, new, P, ["supplier_id", "unspsc_code"])
    live = {r.supplier_id: (r.unspsc_code, r.confidence) for r in out.where("not superseded").collect()}
    assert live == {1: ("22222222", Decimal("1.00")), 2: ("43211507", Decimal("0.80")), 5: ("33333333", Decimal("0.10"))}
    assert out.count() == 7 and current_classification(out).count() == 3


def test_corrections_propagate_and_clear(spark):
    suppliers = table(spark, SUPPLIERS, KNOWN | {"id": 1, "parent_id": None}, KNOWN | {"id": 2, "name": "B", "parent_id": 1}, KNOWN | {"id": 3, "name": "C", "parent_id": 2}, KNOWN | {"id": 4, "name": "D", "parent_id": None})
    old = table(spark, CLASSIFICATIONS, row(1, 1), row(2, 3), row(3, 4, corrected_code="55555555", reviewed=True))
    taxonomy = spark.createDataFrame([("11111111",)], "code string")
    asked = spark.createDataFrame([(1, 1, " 11111111 ", "wrong", "ann", True), (2, 4, "99999999", None, "bob", True), (3, 4, "bad", None, "bob", False)], "request_id long, supplier_id long, code string, reason string, actor string, apply_to_subsidiaries boolean")
    out = h.apply_corrections(asked, suppliers, old, taxonomy, P)
    corrections = {r.request_id: (r.original_code, r.affected_count, r.applied_to_subsidiaries, r.code_known) for r in out["corrections"].collect()}
    assert corrections == {1: ("43211507", 3, True, True), 2: ("55555555", 1, False, False)}
    live = {r.supplier_id: (r.unspsc_code, str(r.confidence), r.reviewed, r.inherited_from_parent) for r in current_classification(out["history"]).collect()}
    assert live == {1: ("11111111", "1.00", True, False), 2: ("11111111", "0.95", True, True), 3: ("11111111", "0.95", True, True), 4: ("99999999", "1.00", True, False)}
    cleared = h.clear_correction(out["history"], suppliers.where("id = 1"))
    assert {r.supplier_id: (r.corrected_code, r.reviewed) for r in current_classification(cleared).collect()}[1] == (None, False)


def test_propagation_protects_reviewed_rows(spark):
    plan = spark.createDataFrame([(1, "A", "s:1", "parent", None, "A"), (2, "B", "s:1", "inherit", 1, "A"), (3, "C", "s:1", "inherit", 1, "A")], "supplier_id long, name string, cluster_key string, mode string, inherit_from long, root_name string")
    results = spark.createDataFrame([(1, "43211507", Decimal("0.95"), "A")], "supplier_id long, unspsc_code string, confidence decimal(3,2), name string")
    old = table(spark, CLASSIFICATIONS, row(1, 3, reviewed=True))
    got = h.propagate_codes(plan, results, P, old).collect()
    assert [(r.supplier_id, r.confidence, r.inherited_from_supplier_id) for r in got] == [(2, Decimal("0.86"), 1)]
    assert h.propagate_codes(plan, results, P, old, protect_reviewed=False).count() == 2


def test_cache_upsert_and_split(spark):
    kind = "cache_key string, payload string, provider string, hit_count int, created_at timestamp_ntz, expires_at timestamp_ntz"
    old = spark.createDataFrame([("p:acme", "old", "p", 4, datetime(2024, 1, 1), datetime(2024, 2, 1)), ("p:beta", "b", "p", 0, datetime(2024, 1, 1), None)], kind)
    new = spark.createDataFrame([("p:acme", "new", "p", 0, datetime(2024, 5, 1), datetime(2024, 7, 1))], kind)
    out = merge.cache_upsert(old, new)
    assert {(r.cache_key, r.payload, r.hit_count) for r in out.collect()} == {("p:acme", "new", 4), ("p:beta", "b", 0)}
    asked = spark.createDataFrame([(1, "Acme Inc"), (2, "Beta"), (3, "Gamma")], "id long, name string")
    hits, misses = merge.cache_split(asked, old, "p", P)
    assert [r.id for r in hits.collect()] == [2] and sorted(r.id for r in misses.collect()) == [1, 3]
    assert {r.cache_key: r.hit_count for r in merge.count_hits(old, hits).collect()} == {"p:acme": 4, "p:beta": 1}


def test_conform_adds_typed_nulls(spark):
    assert conform(spark.range(1), SUPPLIERS).schema.simpleString() == SUPPLIERS.simpleString()
