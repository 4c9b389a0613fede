"""The mixture's classifier with rare words and large vocabularies, and the totals that its stage meets."""

import random

import pytest
from pyspark.sql import functions as F

from spendweave.llm import mixing


def held_rows(rng, marker_docs, words):
    rows, labels = [], []
    for k in range(400):
        body = [f"w{rng.randint(0, words)}" for _ in range(40)]
        kind = "toxic" if k % 20 == 0 or k >= 400 - marker_docs else "good"
        body += ["vile"] if kind == "toxic" and k < 400 - marker_docs else ["garstig"] if kind == "toxic" else []
        rows.append((k, " ".join(body)))
        labels.append((k, kind))
    return rows, labels


def test_words_of_a_small_language_speak(llm, documents):
    rng = random.Random(3)
    rows, labels = held_rows(rng, 12, 300)
    unseen = [(1000 + k, " ".join(f"w{rng.randint(0, 300)}" for _ in range(40)) + " garstig") for k in range(20)]
    model = mixing.fit(documents(rows), llm.createDataFrame(labels, "doc_id long, domain string"))
    found = mixing.posteriors(documents(unseen), model).collect()
    assert all(r.p[r.domains.index("toxic")] > 0.5 for r in found)


def test_no_other_word_speaks(llm, documents):
    rng = random.Random(4)
    rows, labels = held_rows(rng, 60, 300)
    model = mixing.fit(documents(rows), llm.createDataFrame(labels, "doc_id long, domain string"))
    long = [(k, " ".join(f"u{k}x{j}" for j in range(100_000))) for k in range(3)]
    none, *others = mixing.posteriors(documents([(9, "unheard"), *long]), model).collect()
    assert all(r.p == none.p for r in others)


def test_stage_meets_its_targets_by_repeating(llm, documents):
    rng = random.Random(5)
    kinds = ["good"] * 700 + ["poor"] * 100 + ["toxic"] * 100
    rows = [(k, " ".join([f"{kind}{rng.randint(0, 3)}" for _ in range(6)] + [f"w{rng.randint(0, 200)}" for _ in range(14)])) for k, kind in enumerate(kinds)]
    labels = llm.createDataFrame(list(enumerate(kinds)), "doc_id long, domain string")
    targets = {"good": 0.6, "poor": 0.35, "toxic": 0.05}
    out = mixing.thin(documents(rows), labels, targets, plenty=1.1)
    named = out.join(labels, "doc_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in named)
    assert all(abs(r.n / total - targets[r.domain]) < 0.03 for r in named)
    assert out.columns == documents(rows).columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] >= 3


def test_each_target_is_met_within_its_own_share(llm):
    rows = [(1000, ["a", "b"], [0.99, 0.01])] * 50 + [(1000, ["a", "b"], [0.4, 0.6])] * 3
    soft = llm.createDataFrame(rows, "tokens long, domains array<string>, p array<double>")
    _, told = mixing.solve(soft, {"a": 0.98, "b": 0.02})
    assert told["met"] and all(abs(g - t) <= mixing.CLOSE * g for g, t in zip(told["targets"], told["totals"]))
    with pytest.warns(UserWarning, match="not met"):
        _, told = mixing.solve(soft, {"a": 0.5, "b": 0.5}, rounds=1)
    assert not told["met"]


def test_rows_without_an_id_are_drawn_apart(llm, documents):
    """Half of one domain is asked for: rows without an id, or of one id, go one by one, not all or none."""
    named = [(k, f"fine{k % 7} words{k}") for k in range(400)]
    rows = [*named, *((None, f"fine{k % 7} nameless{k}") for k in range(400)), *((1000, f"fine{k % 7} shared{k}") for k in range(400))]
    labels = llm.createDataFrame([(k, "good") for k in range(400)], "doc_id long, domain string")
    out = mixing.mix(documents(rows), labels, {"good": 1.0}, tokens=1200.0).collect()
    kept = lambda told: sum(r.copies for r in out if told(r.doc_id))
    for told in (lambda i: i is None, lambda i: i == 1000, lambda i: i is not None and i < 400):
        assert 140 < kept(told) < 260


def test_a_carried_name_that_clashes_is_refused(llm, documents):
    model = mixing.fit(documents([(1, "a")]), llm.createDataFrame([(1, "good")], "doc_id long, domain string"))
    with pytest.raises(ValueError, match="tokens"):
        mixing.posteriors(documents([(1, "a")]).selectExpr("*", "1 AS tokens_", "2 AS tokens"), model, carry=("tokens",))
