"""Numbers of a walk, descendants and batches of links against walking by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendweave.operators import forest


def _below(parents):
    under = defaultdict(list)
    for i, p in parents.items():
        if p in parents:
            under[p].append(i)
    out = {}
    for seed in parents:
        level, seen, now = 0, {seed}, [seed]
        while now:
            level += 1
            now = [c for i in now for c in under[i] if c not in seen and not seen.add(c)]
            out |= {(seed, c): level for c in now}
    return out


def _shapes():
    rng = random.Random(11)
    rings = {1: 3, 2: 1, 3: 2, 4: 3, 5: 4, 6: 6, 7: 6, 8: 1, 9: None, 10: 99, 11: 10}
    trees = {k: None if k % 17 == 0 else rng.randrange(max(0, k - 9), k) for k in range(100, 220)} | {k: rng.choice([None, rng.randrange(300, 340), 5000]) for k in range(300, 340)}
    return rings | trees | {k: 1000 for k in range(1001, 1300)} | {1000: 107} | {k: k - 1 for k in range(2001, 2100)} | {2000: None}


def test_descendants_of_every_row(spark):
    parents = _shapes()
    links = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    expected = _below(parents)
    numbers, _ = forest.cut(forest.numbered(links))
    got = forest.descendants(links.select(F.col("id").alias("seed_id")), links, numbers).collect()
    assert {(r.seed_id, r.id): r.level for r in got} == expected and len(got) == len(expected)
    counts = {r.id: r.descendants for r in forest.descendant_counts(links, numbers).collect()}
    assert counts == {i: sum(s == i for s, _ in expected) for i in parents}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    writes = []
    cut = forest.cut
    monkeypatch.setattr(forest, "cut", lambda df, **k: writes.append(1) or cut(df, **k))
    chain = spark.range(2000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    star = spark.range(10_000, 210_000).select("id", F.when(F.col("id") > 10_000, F.lit(10_000)).cast("long").alias("parent_id"))
    links = chain.unionByName(star)
    seeds = spark.createDataFrame([(0,), (1000,), (10_000,)], "seed_id long")
    got = {r.seed_id: (r.n, r.deep) for r in forest.descendants(seeds, links).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deep")).collect()}
    assert got == {0: (1999, 1999), 1000: (999, 999), 10_000: (199_999, 1)}
    assert len(writes) < 40


def _batch(parents, asked):
    told, live = {}, {}
    for r, s, p in asked:
        if s == p:
            told[r] = "self"
        elif s not in parents or p not in parents:
            told[r] = "missing"
        elif parents[s] == p:
            told[r] = "already"
        else:
            live[r] = (s, p)
    while True:
        now, last = dict(parents), {}
        for r, (s, p) in sorted(live.items()):
            now[s], last[s] = p, r
        out = set()
        for i in now:
            path, at = [], i
            while at in now and at not in path:
                path.append(at)
                at = now[at]
            if at == i and (made := [last[x] for x in path if x in last]):
                out.add(max(made))
        if not out:
            return told | dict.fromkeys(live, "ok")
        for r in out:
            told[r] = "cycle"
            del live[r]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_links_hold_together(spark, seed):
    rng = random.Random(seed)
    parents = {i: rng.choice([None, None, rng.randrange(0, 34)]) for i in range(30)} | {40: 41, 41: 40, 50: None, 51: None}
    asked = [(k, rng.randrange(0, 31), rng.randrange(0, 31)) for k in range(45)] + [(90, 50, 51), (91, 51, 50), (92, 40, 50)]
    got = forest.link_batch(spark.createDataFrame(asked, "request_id long, supplier_id long, parent_id long"), spark.createDataFrame(list(parents.items()), "id long, parent_id long"))
    told = {r.request_id: r.verdict for r in got.collect()}
    assert told == _batch(parents, asked)
    assert (told[90], told[91]) == ("ok", "cycle")


def test_a_long_chain_above_rings_is_climbed_once(spark, monkeypatch):
    """Rings that stay open after their link is refused need no second climb of what leads into them, and a round reads few tables (F11)."""
    writes, tables, cut = [], [], forest.cut

    def seen(df, **metrics):
        writes.append(1)
        tables.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return cut(df, **metrics)

    monkeypatch.setattr(forest, "cut", seen)
    parents = {0: None, 1: None} | {i: i - 1 for i in range(2, 1500)}
    asked = [(5, 0, 1), (6, 1, 0)]
    batch, rows = spark.createDataFrame(asked, "request_id long, supplier_id long, parent_id long"), spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    assert {r.request_id: r.verdict for r in forest.link_batch(batch, rows).collect()} == {5: "ok", 6: "cycle"}
    assert len(writes) < 24
    tables.clear()
    state, left = forest._climb(rows.select("id", F.col("parent_id").alias("parent")))
    assert left == 0 and state.where("done").count() == 1500 and max(tables) < 4 * (forest.TABLES + 2)


@pytest.mark.parametrize("seed", [3])
def test_links_that_fall_back_into_rings(spark, seed):
    """Suppliers ask several times, so opened rings close again, round after round, also through rows that only led into them."""
    rng = random.Random(seed)
    parents = {i: rng.choice([None, i - 1 if i else None, rng.randrange(0, 12)]) for i in range(12)}
    asked = [(k, rng.randrange(0, 12), rng.randrange(0, 12)) for k in range(22)]
    got = forest.link_batch(spark.createDataFrame(asked, "request_id long, supplier_id long, parent_id long"), spark.createDataFrame(list(parents.items()), "id long, parent_id long"))
    assert {r.request_id: r.verdict for r in got.collect()} == _batch(parents, asked)


def test_empty_tables(spark):
    links = spark.createDataFrame([], "id long, parent_id long")
    assert forest.numbered(links).count() == 0 and forest.descendants(links.select(F.col("id").alias("seed_id")), links).count() == 0
    assert forest.link_batch(spark.createDataFrame([], "request_id long, supplier_id long, parent_id long"), links).count() == 0
