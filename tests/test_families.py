import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendweave import session
from spendweave.operators import families as fam
from spendweave.params import Params

SCHEMA = "id long, name string, parent_id long, parent_name string, is_parent boolean, domain string, industry string, total_amount decimal(18,2)"
BASE = [
    (1, "Dell Technologies", None, None, True, "dell.com", "Computer manufacturing", Decimal("1250000.00")),
    (2, "EMC Corporation", 1, "Dell Technologies", False, "emc.com", "Computer storage", Decimal("184500.50")),
    (3, "VMware", 1, "Dell Technologies", False, "vmware.com", None, Decimal("96500.00")),
    (4, "Grainger", None, None, False, "grainger.com", "Industrial supplies", Decimal("52300.00")),
    (5, "Microsoft", None, None, True, "microsoft.com", "Software publishing", Decimal("875000.00")),
    (6, "LinkedIn", 5, "Microsoft", False, None, None, Decimal("42000.00")),
    (7, "Independent Traders", None, None, False, None, None, Decimal("1000.00")),
]


def rows_of(spark, rows):
    padded = [tuple(list(r) + [None] * (8 - len(r))) for r in rows]
    df = spark.createDataFrame(padded, SCHEMA).withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))
    for name in ("naics", "sic", "description", "parent_domain"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def brute(edges):
    """Root, depth and cycle flag by walking, one row at a time."""
    out = {}
    for start in edges:
        path, cur = [start], start
        while True:
            up = edges[cur]
            if up is None or up not in edges:
                out[start] = (cur, len(path) - 1, False)
                break
            if up in path:
                out[start] = (min(path[path.index(up):]), len(path) - 1, True)
                break
            path.append(up)
            cur = up
    return out


def resolved(spark, edges):
    df = spark.createDataFrame(list(edges.items()), "id long, parent_id long")
    return {r.id: (r.root_id, r.depth, r.in_cycle) for r in fam.resolve_roots(df).collect()}


GRAPHS = {
    "chain": {10: None, 11: 10, 12: 11},
    "deep chain": {i: (i - 1 if i else None) for i in range(100)},
    "two-cycle": {20: 21, 21: 20, 22: None},
    "self-loop": {1: 1, 2: 1, 3: 2},
    "tail into three-cycle": {i: i + 1 for i in range(1, 41)} | {41: 42, 42: 43, 43: 41, 99: 41},
    "falling tail into cycle": {i: i - 1 for i in range(200, 150, -1)} | {150: 160, 160: 161, 161: 160},
    "dangling": {40: 999, 41: 40},
    "star": {0: None} | {i: 0 for i in range(1, 300)},
}


@pytest.mark.parametrize("name", GRAPHS)
def test_roots(spark, name):
    assert resolved(spark, GRAPHS[name]) == brute(GRAPHS[name])


def test_random_roots_with_salting(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 5)
    rng = random.Random(5)
    edges = {i: rng.choice([None, 0, 0, rng.randrange(0, 260), rng.randrange(0, 260)]) for i in range(250)}
    assert resolved(spark, edges) == brute(edges)


def test_family_of_three(spark):
    members = fam.family_members(rows_of(spark, BASE))
    dell = {r.cluster_key: r for r in fam.clusters(members).collect()}["s:1"]
    assert (dell.supplier_count, dell.subsidiary_count, dell.total_amount) == (3, 2, Decimal("1531000.50"))
    assert members.count() == len(BASE)


def test_virtual_dangling_and_their_children(spark):
    rows = [(30, "Siemens Healthineers", None, "Siemens AG"), (31, "Mentor Graphics", None, "siemens"), (32, "Siemens", None, None), (33, "Sub", 31, None), (40, "Ghost child", 999, "Ghost Co"), (41, "Echo Inc", None, "ECHO")]
    got = {r.id: (r.cluster_key, r.is_root, r.is_orphan) for r in fam.family_members(rows_of(spark, rows)).collect()}
    assert got == {
        30: ("v:siemens", False, False), 31: ("v:siemens", False, False), 32: ("s:32", True, False), 33: ("s:31", False, False), 40: ("s:40", True, True), 41: ("s:41", True, False),
    }


def test_plan_assigns_everyone_once(spark):
    plan = {r.supplier_id: (r.mode, r.inherit_from) for r in fam.classification_plan(fam.family_members(rows_of(spark, BASE))).collect()}
    assert plan == {1: ("parent", None), 2: ("inherit", 1), 3: ("inherit", 1), 4: ("direct", None), 5: ("parent", None), 6: ("inherit", 5), 7: ("direct", None)}


def test_single_virtual_member_is_a_family(spark):
    plan = fam.classification_plan(fam.family_members(rows_of(spark, [(30, "A", None, "Siemens AG")]))).first()
    assert (plan.mode, plan.parent_name) == ("parent", "Siemens AG")


def test_rollup_code_and_counts(spark):
    rows = rows_of(spark, BASE[:4])
    extra = spark.createDataFrame(
        [(1, None, None, None, True), (2, "43211500", Decimal("0.40"), False, False), (3, "43211500", Decimal("0.30"), True, False), (4, "11111111", Decimal("0.90"), False, False)],
        "id long, effective_code string, confidence decimal(3,2), reviewed boolean, stale boolean",
    )
    got = {r.cluster_key: r for r in fam.parent_rollup(fam.family_members(rows.join(extra, "id")), Params()).collect()}
    assert (got["s:1"].code, got["s:1"].low_confidence_count, got["s:1"].stale_count) == ("43211500", 1, 1)
    assert got["s:1"].confidence == pytest.approx(0.35)


def test_root_code_wins_over_majority(spark):
    rows = rows_of(spark, BASE[:3])
    extra = spark.createDataFrame(
        [(1, "99999999"), (2, "43211500"), (3, "43211500")], "id long, effective_code string"
    ).select("*", F.lit(0.9).cast("decimal(3,2)").alias("confidence"), F.lit(False).alias("reviewed"), F.lit(False).alias("stale"))
    assert fam.parent_rollup(fam.family_members(rows.join(extra, "id")), Params()).first().code == "99999999"


def test_descendants_and_scope(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (9, None), (20, 21), (21, 20)], "id long, parent_id long")
    seeds = spark.createDataFrame([(1,), (3,), (20,)], "seed_id long")
    assert {(r.seed_id, r.id, r.level) for r in fam.descendants(seeds, links).collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (20, 21, 1)}
    assert {r.id for r in fam.scope_below(seeds, links).collect()} == {1, 2, 3, 4, 20, 21}


def test_link_guard_matches_walking(spark):
    rng = random.Random(3)
    edges = {i: rng.choice([None, rng.randrange(0, 45)]) for i in range(40)}
    proposals = [(s, p) for s in range(40) for p in rng.sample(range(42), 6)]

    def verdict(s, p):
        if s == p:
            return "self"
        if p not in edges:
            return "missing"
        if edges[s] == p:
            return "already"
        seen, cur = set(), p
        while cur in edges and cur not in seen:
            seen.add(cur)
            cur = edges[cur]
            if cur == s:
                return "cycle"
        return "ok"

    got = fam.link_guard(spark.createDataFrame(proposals, "supplier_id long, parent_id long"), spark.createDataFrame(list(edges.items()), "id long, parent_id long"))
    assert {(r.supplier_id, r.parent_id): r.verdict for r in got.collect()} == {(s, p): verdict(s, p) for s, p in proposals}


def test_resolve_links_creates_each_parent_once(spark):
    rows = rows_of(spark, [(1, "Acme", None, "Holding Inc"), (2, "Beta", None, "HOLDING"), (3, "Gamma", None, "acme ltd"), (4, "Delta", None, "Delta Inc")])
    rows = rows.withColumn("normalized_name", F.lower("name")).withColumn("parent_confidence", F.when(F.col("id") == 9, 0.1).cast("decimal(3,2)"))
    out = fam.resolve_links(rows, Params())
    assert {(r.supplier_id, r.status, r.parent_id) for r in out["links"].collect()} == {(1, "linked", 5), (2, "linked", 5), (3, "linked", 1), (4, "self", None)}
    registry = {r.id: (r.name, r.parent_id, r.is_parent) for r in out["suppliers"].collect()}
    assert registry[5] == ("Holding Inc", None, True) and registry[3][1] == 1 and registry[1][2]


def test_unlink(spark):
    rows = rows_of(spark, BASE)
    out = {r.id: (r.parent_id, r.is_parent) for r in fam.unlink(rows, spark.createDataFrame([(6,), (2,)], "id long")).collect()}
    assert out[6] == (None, False) and out[5] == (None, False) and out[1] == (None, True) and out[3] == (1, False)
