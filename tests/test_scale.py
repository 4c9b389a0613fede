"""Helpers that keep hot keys apart, checked against plain computations on skewed fixtures."""
import random

from pyspark.sql import functions as F

from spendweave import session
from spendweave.operators import candidates, timing
from spendweave.session import cut, ranked, spread_join

WORDS = ["valve", "valves", "industrial", "computer", "repair", "cleaning", "steel", "pipe", "office", "paper", "medical", "device", "bolt", "ring"]


def test_spread_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 30)
    many = spark.range(3000).select("id", F.when(F.col("id") < 1000, 7).when(F.col("id") < 1100, None).otherwise(F.col("id") % 50).alias("k"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(one, "k", how).select("id", "k", "v").collect()))
        assert sorted(map(tuple, spread_join(many, one, "k", spread_by="id", how=how).select("id", "k", "v").collect())) == want


def test_hot_keys_are_spread_over_partitions(spark):
    many = spark.range(20000).select("id", F.lit(1).cast("long").alias("k"))
    one = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used = spread_join(many, one, "k", spread_by="id").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used == 4


def test_ranked_equals_a_window(spark):
    df = spark.range(997).select(F.col("id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), (F.hash("id") % 1000).alias("x"))
    got = ranked(df, [F.col("x").desc(), F.col("id").asc()], "n", group="g").collect()
    for g in ("rare", "hot"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.id for r in mine] == [r.id for r in sorted(mine, key=lambda r: (-r.x, r.id))]
    alone = ranked(df, [F.col("id").asc()], "n").collect()
    assert {r.id: r.n for r in alone} == {i: i + 1 for i in range(997)}
    assert ranked(df.limit(0), [F.col("id").asc()], "n").count() == 0


def test_cut_uses_the_shared_folder(spark):
    back, seen = cut(spark.range(10), rows=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"rows": 10, "top": 9} and back.inputFiles()[0].startswith("file://" + session.shared_dir(spark))


def test_rate_window_matches_scanning(spark):
    rng = random.Random(1)
    calls = [(i, "hot" if rng.random() < 0.8 else "cold", 1_700_000_000_000_000 + rng.randrange(0, 400_000_000)) for i in range(400)]
    df = spark.createDataFrame(calls, "n int, model string, at long").select("n", "model", F.timestamp_micros("at").alias("ts"), "at")
    got = {r.n: (r.in_window, r.at_limit, r.next_slot_ms) for r in timing.rate_window(df, per_minute=5).collect()}
    for n, model, at in calls:
        inside = [a for _, m, a in calls if m == model and at - 60_000_000 < a <= at]
        full = len(inside) >= 5
        assert got[n] == (len(inside), full, max(0, (min(inside) + 60_000_000 - at) // 1000) if full else 0)


def brute_candidates(words, taxonomy, limit):
    budget = max(15, -(-limit * 3 // len(words)))
    found = set()
    for w in words:
        found |= set([code for code, (c, k, f, s) in sorted(taxonomy.items()) if w in c.lower() or w in k.lower() or w in f.lower()][:budget])
    scored = []
    for code in found:
        c, k, f, s = (x.lower() for x in taxonomy[code])
        points = [10 if w in c else 4 if w in k else 1 if w in f or w in s else 0 for w in words]
        scored.append((sum(points), sum(p == 10 for p in points), sum(p > 0 for p in points), code))
    good = [x for x in scored if x[1] > 0 or x[2] >= 2] or scored
    return [x[3] for x in sorted(good, key=lambda x: (-x[0], -x[1], -x[2], x[3]))[:limit]]


def test_candidates_match_substring_search(spark):
    rng = random.Random(2)
    pick = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "-grade", "work"]) for _ in range(n))
    taxonomy = {f"{10000000 + i * 37}": (pick(2), pick(1), pick(1), pick(1)) for i in range(700)}
    tax = spark.createDataFrame([(code, *names) for code, names in taxonomy.items()], "code string, commodity string, class string, family string, segment string")
    asked = [(1, "Valve Works", "industrial valves", "steel pipe"), (2, "Paper", "office", None), (3, "Nothing Relevant", None, None), (4, "valv", None, "compute repai medical-grade bolts")]
    suppliers = spark.createDataFrame(asked, "id long, name string, industry string, description string")
    words = {r[0]: r[1] for r in suppliers.select("id", candidates.query_keywords(F.col("industry"), F.col("name"), F.col("description"))).collect()}
    for limit in (5, 20):
        got = {}
        for r in sorted(candidates.candidate_codes(suppliers, tax, limit).collect(), key=lambda r: r.position):
            got.setdefault(r.supplier_id, []).append(r.code)
        want = {i: brute_candidates(w, taxonomy, limit) for i, w in words.items() if w}
        assert got == {i: w for i, w in want.items() if w}


def test_validation_walks_up(spark):
    tax = spark.createDataFrame([("43211507",), ("43211601",), ("43990000",)], "code string")
    given = [(1, "43211507"), (2, "43211599"), (3, "43219999"), (4, "43000000"), (5, "99000000"), (6, "bad"), (7, "43211599")]
    got = {r.id: (r.valid_code, r.code_unknown) for r in candidates.validate_codes(spark.createDataFrame(given, "id long, unspsc_code string"), tax, "id").collect()}
    assert got == {
        1: ("43211507", False), 2: ("43211507", True), 3: ("43211507", True), 4: ("43211507", True), 5: ("99000000", True), 6: ("bad", True), 7: ("43211507", True),
    }


def test_filters_read_one_list(spark):
    """The list is worked out once, whatever is asked of it; it is sorted and merged with what grows (F3, F5, F6, F10)."""
    from spendweave import catalog

    for name in ("filter_state", "filter_search", "filter_confidence", "filter_dates"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_taxonomy_rows_are_dealt_before_they_are_multiplied(spark, tmp_path):
    """A taxonomy is a small file: its names and codes are split by as many tasks as a shuffle has, not by its one reader (F9)."""
    names = spark.range(40).select((F.col("id") + 10000000).cast("string").alias("code"), *[F.concat(F.lit(c), "id").alias(c) for c in ("commodity", "class", "family", "segment")])
    names.coalesce(1).write.parquet(f"{tmp_path}/taxonomy")
    tax = spark.read.parquet(f"{tmp_path}/taxonomy")
    suppliers = spark.createDataFrame([(1, "class7", None, None)], "id long, name string, industry string, description string")
    for made in (candidates.candidate_codes(suppliers, tax), candidates.prefix_index(tax)):
        lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for at in [k for k, line in enumerate(lines) if "Generate explode" in line and ("token" in line or "digits" in line) and "gram" not in line]:
            below = [line for line in lines[at + 1:] if "RepartitionByExpression" in line or "Relation" in line]
            assert "RepartitionByExpression" in below[0]
