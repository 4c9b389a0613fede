"""Corrections that overlap, and a stored history that is written by touched partitions."""

import json
from datetime import datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from spendweave.operators import history as h
from spendweave.operators.current import conform, current_classification, newest_of, supplier_detail
from spendweave.params import Params
from spendweave.plans.enrich import enrich_run
from spendweave.schemas import CLASSIFICATIONS, CORRECTIONS, ENRICHMENT_CACHE, SUPPLIERS
from spendweave.sources import history as stored

P = Params()


def _history(spark, *rows):
    full = [dict.fromkeys(CLASSIFICATIONS.fieldNames()) | {"confidence": Decimal("0.80"), "inherited_from_parent": False, "reviewed": False, "superseded": False, "created_at": datetime(2024, 1, 1)} | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in CLASSIFICATIONS.fieldNames()) for r in full], CLASSIFICATIONS)


def _suppliers(spark, rows):
    narrow = spark.createDataFrame(rows, "id long, name string, parent_id long")
    return conform(narrow.withColumn("is_parent", F.lit(False)).withColumn("normalized_name", F.lower("name")).withColumn("transaction_count", F.lit(0)), SUPPLIERS)


def test_the_nearer_corrected_parent_wins(spark):
    # 1 > 2 > 3 > 4, 2 > 5; both 1 and 2 are corrected with all below, 5 by itself; the farther correction comes last
    suppliers = _suppliers(spark, [(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "D", 3), (5, "E", 2), (6, "F", 1)])
    taxonomy = spark.createDataFrame([("11111111",)], "code string")
    asked = spark.createDataFrame([(7, 5, "55555555", None, "cy", False), (8, 2, "22222222", " r ", "bo", True), (9, 1, "11111111", "", "al", True)], "request_id long, supplier_id long, code string, reason string, actor string, apply_to_subsidiaries boolean")
    out = h.apply_corrections(asked, suppliers, _history(spark, {"id": 40, "supplier_id": 3, "unspsc_code": "99999999"}), taxonomy, P, after_id=100)
    live = {r.supplier_id: (r.unspsc_code, r.inherited_from_supplier_id) for r in current_classification(out["history"]).collect()}
    assert live == {1: ("11111111", None), 2: ("22222222", None), 3: ("22222222", 2), 4: ("22222222", 2), 5: ("55555555", None), 6: ("11111111", 1)}
    records = {r.request_id: r for r in out["corrections"].collect()}
    assert [(records[k].id, records[k].affected_count, records[k].code_known) for k in (7, 8, 9)] == [(101, 1, False), (102, 4, False), (103, 6, True)]
    assert conform(out["corrections"], CORRECTIONS).where("id IS NULL OR classification_id IS NULL OR created_at IS NULL").count() == 0
    own = {r.id: (r.supplier_id, r.corrected_at) for r in out["history"].where("corrected_code IS NOT NULL").collect()}
    assert {own[r.classification_id][0] for r in records.values()} == {1, 2, 5} and all(at for _, at in own.values())
    assert {r.id for r in out["suppliers"].where("is_parent").collect()} == {1, 2}
    events = out["audit"].collect()
    assert sorted((e.action, e.entity_id) for e in events if e.action == "corrected") == [("corrected", 1), ("corrected", 2), ("corrected", 5)]
    assert sum(e.action == "propagated" for e in events) == 8 and json.loads(next(e.details for e in events if e.entity_id == 6))["from"] == 1


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_stored_history_is_rewritten_where_touched(spark, tmp_path):
    path = str(tmp_path / "history")
    old = _history(spark, *[{"id": k, "supplier_id": k % 40, "unspsc_code": str(10_000_000 + k), "superseded": k <= 40, "reviewed": k == 45, "corrected_code": "77777777" if k == 45 else None} for k in range(1, 81)])
    stored.create(old, path, buckets=16)
    before = _files(path)
    new = spark.createDataFrame([(5, "11111111", 0.5), (5, "22222222", 7.0), (90, "33333333", 0.1)], "supplier_id long, unspsc_code string, confidence double")
    expected = sorted(tuple(r) for r in h.write_classifications(old, new, P, ["supplier_id", "unspsc_code"]).select("id", "supplier_id", "unspsc_code", "superseded").collect())
    stored.append(spark, path, new, P, "b1", ["supplier_id", "unspsc_code"], top=80, buckets=16)
    got = stored.read(spark, path)
    assert sorted(tuple(r) for r in got.select("id", "supplier_id", "unspsc_code", "superseded").collect()) == expected
    after = _files(path)
    gone = {f for f in before if f not in after}
    assert gone and all("live=true" in f for f in gone) and len({f.split("/")[1] for f in gone}) <= 2
    assert all(after[f] == before[f] for f in before if f in after)
    stored.clear(spark, path, spark.createDataFrame([(5,)], "id long"), buckets=16)
    assert stored.read(spark, path).where("corrected_code IS NOT NULL OR reviewed").count() == 1  # the closed row of supplier 5
    assert current_classification(stored.read(spark, path)).count() == 41
    plan = h.write_classifications(stored.read(spark, path), new, P)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_one_lookup_for_suppliers_of_one_key(spark):
    suppliers = _suppliers(spark, [(3, "Acme Inc", None), (1, "ACME GmbH", None), (2, "Beta", None)])
    cache = spark.createDataFrame([], ENRICHMENT_CACHE)

    def lookup(frame):
        assert 3 not in frame["id"].tolist()  # the supplier with the smallest id asks for its key
        return frame.assign(payload=['{"industry": "answer to %d"}' % i for i in frame["id"]], error=None, credits=1)

    out = enrich_run(suppliers, cache, P, lookup=lookup)
    assert {r.id: r.industry for r in out["suppliers"].collect()} == {1: "answer to 1", 3: "answer to 1", 2: "answer to 2"}
    assert {(r.cache_key, r.supplier_name, r.credits_used) for r in out["cache"].collect()} == {("generic:acme", "ACME GmbH", 1), ("generic:beta", "Beta", 1)}


def test_details_of_a_set(spark):
    suppliers = _suppliers(spark, [(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "D", 2), (5, "E", 77)])
    history = _history(spark, {"id": 1, "supplier_id": 2, "unspsc_code": "11111111", "superseded": True}, {"id": 2, "supplier_id": 2, "unspsc_code": "22222222"})
    out = supplier_detail(suppliers, history, spark.createDataFrame([(1,), (2,), (2,), (5,)], "id long"))
    assert sorted(map(tuple, out.collect())) == [(1, None, None, 1, 3, 0, None), (2, 1, "A", 2, 2, 2, "22222222"), (5, 77, None, 0, 0, 0, None)]
    newest = newest_of(history, "supplier_id", spark.createDataFrame([(2,)], "id long"), 1)
    assert [(r.id, r.position) for r in newest.collect()] == [(2, 1)]
