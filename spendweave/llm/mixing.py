"""Mixing to target weights with soft domain membership. DataFrame and SQL functions only."""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import fresh, store

#: Labelled documents that the classifier is fitted on at most: those whose id hashes lowest.
SAMPLE_DOCS = 20_000
#: For a word to speak, its count in some domain must exceed its share of all by so many standard deviations and so many times;
#: small differences of common words, which come together, would else add up. Lower bars let more good text be called toxic.
SIGNIFICANT, TIMES = 3.0, 2.0
#: Cells that the speaking words' weights are filed in; a word is known by its whole hash, so a cell may hold several.
CELLS = 65_536
#: What stands for a text without small letters, among the hashes of words.
SHOUT = -1
#: Rounds of projected gradient, and the miss of every target, as a share of that target, at which they end.
ROUNDS, CLOSE = 40, 1e-2


#: Where a text is parted: at white space, and between a letter or digit and a sign after it.
PARTS = "[\\x20\\x09-\\x0D]+|(?=[!-/:-@\\[-`{-~])(?<=[\\p{L}\\p{N}])"


def _pieces(text: Column) -> Column:
    """Words of a text and runs of signs; an empty piece may stand at either end."""
    return F.split(text, PARTS, -1)


def _heard(pieces: Column, text: Column) -> Column:
    """64-bit hashes of a text's pieces, and one more for a text without small letters."""
    shout = F.when(~text.rlike("[a-z]"), F.array(F.lit(SHOUT).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.concat(F.transform(pieces, lambda w: F.xxhash64(w)), shout)


def _count(pieces: Column) -> Column:
    ends = (F.get(pieces, F.lit(0)) == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - ends).cast("long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row ``domains, prior array<double>, words array<long>, cells array<array<struct<word, w>>>``: naive Bayes over words.

    A weight compares a word's share of documents in the domain with its share of all, for words that some domain has
    ``SIGNIFICANT`` standard deviations and ``TIMES`` times more often, else it is zero: chance words of a large vocabulary have
    no say. Shares are smoothed by one document that has the word as often as all have. ``prior`` is the score of a text that
    has none of these words. ``labels(doc_id, domain)`` may hold nulls (left out) and repeats (the smallest domain counts). Each
    text counts a word once. Words are known by their whole hashes, so no other word speaks for them. The labelled sample is
    bounded by ``sample_docs``, and so are the words; counts are summed before they are shuffled.
    """
    narrow = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain")).dropna()
    sample = narrow.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    labelled = texts.join(F.broadcast(store(sample)), "doc_id")  # sample_docs rows of two short columns at most
    words = labelled.select("domain", F.array_distinct(_heard(_pieces(F.col("text")), F.col("text"))).alias("words"))
    every = store(labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("docs")))
    kinds = {r[0]: float(r[1]) for r in every.orderBy("domain").collect()}  # as many as domains
    if not kinds:
        return every.agg(*[F.array().cast(kind).alias(c) for c, kind in (("domains", "array<string>"), ("prior", "array<double>"), ("words", "array<long>"), ("cells", "array<array<struct<word:long,w:array<double>>>>"))])
    total, names = sum(kinds.values()), list(kinds)
    counts = [F.sum((F.col("domain") == n).cast("double")).alias(f"n{k}") for k, n in enumerate(names)]
    counted = words.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *counts)
    share = (F.col("n") + 0.5) / (total + 1.0)
    own = [(F.col(f"n{k}") + share) / (kinds[n] + 1.0) for k, n in enumerate(names)]
    apart = [(own[k] >= TIMES * share) & ((F.col(f"n{k}") - kinds[n] * share) / F.sqrt(kinds[n] * share * (1 - share) + 1) >= SIGNIFICANT) for k, n in enumerate(names)]
    absent = [F.log((1 - o) / (1 - share)) for o in own]
    spoken = counted.where(reduce(lambda a, b: a | b, apart)).select(
        "word", F.array(*[F.log(o / share) - x for o, x in zip(own, absent)]).alias("w"), F.array(*absent).alias("absent"),
    )
    spoken = store(spoken.orderBy("word"))
    prior = [F.lit(math.log(kinds[n] / total)) + F.coalesce(F.sum(F.get("absent", F.lit(k))), F.lit(0.0)) for k, n in enumerate(names)]
    filed = spoken.groupBy(F.col("word").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("word", "w"))).alias("held"))
    places = docs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(filed, "cell", "left")
    cells = places.agg(F.sort_array(F.collect_list(F.struct("cell", "held")))["held"].alias("cells"))  # CELLS items and the sample's words
    whole = spoken.agg(F.array(*[F.lit(n) for n in names]).alias("domains"), F.array(*prior).alias("prior"), F.sort_array(F.collect_list("word")).alias("words"))
    return whole.crossJoin(cells).select("domains", "prior", "words", "cells")


def posteriors(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, tokens, domains, p``: words and runs of signs of the whole text, and the probability of each domain given its distinct words.

    The columns ``carry`` follow; a name that these columns have is refused. A null or empty text has no tokens and the prior. Without labels there are no domains and ``p`` is empty.
    """
    if clash := {"doc_id", "text", "pieces", "tokens", "domains", "p"} & {c.lower() for c in carry}:
        raise ValueError(f"columns {sorted(clash)} can't be carried under these names")
    one, domains, prior, cells, words, scores, spoken = (fresh(n) for n in ("one", "domains", "prior", "cells", "words", "scores", "spoken"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry)
    pieces = texts.withColumn("pieces", _pieces(F.col("text")))
    read = pieces.select(*carry, F.lit(1).alias(one), "doc_id", _count(F.col("pieces")).alias("tokens"), _heard(F.col("pieces"), F.col("text")).alias(words))
    model = model.select(
        F.lit(1).alias(one), F.col("domains").alias(domains), F.col("prior").alias(prior), F.col("cells").alias(cells), F.col("words").alias(spoken),
    )
    joined = read.join(F.broadcast(store(model)), one, "left")  # one row of the sample's speaking words
    heard = F.array_intersect(words, spoken)
    weight = lambda k: F.get(F.filter(F.get(cells, k.bitwiseAND(CELLS - 1).cast("int")), lambda e: e["word"] == k), F.lit(0))["w"]
    score = F.aggregate(heard, F.col(prior), lambda sums, k: F.zip_with(sums, weight(k), lambda a, w: a + w))
    joined = joined.withColumn(scores, F.coalesce(score, F.array().cast("array<double>"))).select(*carry, "doc_id", "tokens", F.coalesce(domains, F.array().cast("array<string>")).alias("domains"), scores)
    odds = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    whole = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return joined.select("doc_id", "tokens", "domains", F.transform(odds, lambda o: o / whole).alias("p"), *carry)


def _total(k: int, weight: Column) -> Column:
    return F.coalesce(F.sum(weight * F.get("p", F.lit(k))), F.lit(0.0))


def solve(soft: DataFrame, targets: dict[str, float], tokens: float | None = None, rounds: int = ROUNDS, plenty: float = 1.0) -> tuple[DataFrame, dict]:
    """``soft`` with ``rate``: nonnegative rates of documents whose expected domain totals come to the targets.

    Least squares of the domain totals against ``targets`` (weights by domain name; a domain that isn't named has weight zero),
    by projected gradient from rate one: each round adds to every rate the misses of its domains, in proportion to its
    membership and relative to the domains' totals, and cuts at zero. That scaling keeps the step stable at any size. A round
    is one sum over the documents; the rates of a round follow from the misses of the rounds before, a few numbers.
    Rounds end when every target is met within ``CLOSE`` of itself (a target of zero, of all tokens); else there is a warning.
    ``tokens`` is the total to reach; without it, so much that the domain with the largest weight is used once, times ``plenty``.
    """
    first = soft.select("domains").limit(1).collect()
    names: list[str] = list(first[0][0]) if first else []
    if not names:
        return soft.withColumn("rate", F.lit(1.0)), {"domains": [], "targets": [], "totals": [], "rounds": 0, "met": True}
    kinds = range(len(names))
    base = soft.agg(*[_total(k, F.col("tokens")).alias(f"t{k}") for k in kinds]).first()
    have = [max(float(base[k]), 1e-9) for k in kinds]
    weight = [max(0.0, float(targets.get(n, 0.0))) for n in names]
    scale = sum(weight) or 1.0
    weight = [w / scale for w in weight]
    if tokens is None:
        tokens = max(((weight[k], float(base[k]) / weight[k]) for k in kinds if weight[k] > 0 and base[k] > 0), default=(0.0, 0.0))[1] * plenty
    goal = [w * tokens for w in weight]
    misses: list[list[float]] = []
    totals = [float(base[k]) for k in kinds]
    met = lambda: all(abs(g - t) <= CLOSE * max(g or tokens, 1.0) for g, t in zip(goal, totals))
    for _ in range(rounds):
        if met():
            break
        misses.append([(goal[k] - totals[k]) / have[k] for k in kinds])
        used = soft.select("p", (F.col("tokens") * _rate(misses)).alias("used"))
        got = used.agg(*[_total(k, F.col("used")).alias(f"t{k}") for k in kinds]).first()
        totals = [float(got[k]) for k in kinds]
    if not met():
        warnings.warn(f"targets {dict(zip(names, goal))} not met: {dict(zip(names, totals))} after {len(misses)} rounds", stacklevel=2)
    return soft.withColumn("rate", _rate(misses)), {"domains": names, "targets": goal, "totals": totals, "rounds": len(misses), "met": met()}


def _rate(misses: list[list[float]]) -> Column:
    steps = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in m) + ")" for m in misses) + ")") if misses else F.array().cast("array<array<double>>")
    moved = lambda r, m: r + F.aggregate(F.zip_with("p", m, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), moved(r, m)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", tokens: float | None = None) -> DataFrame:
    """``doc_id, tokens, domain, p, rate, copies`` of every row of ``docs``; ``domain`` is the likeliest one.

    ``copies`` is the rate rounded up or down by a hash of id and text, so its expected value is the rate and a repeated run draws
    the same. Rows that repeat a doc_id with other texts, and rows without an id, are drawn apart; rows that repeat both are drawn alike. An empty table gives no rows; without labels every rate is one.
    """
    model = store(fit(docs, labels, id_col, text_col, domain_col))
    key = fresh("key")
    soft = store(posteriors(docs.withColumn(key, _row(id_col, text_col)), model, id_col, text_col, (key,)))
    rated, _ = solve(soft, targets, tokens)
    return rated.select("doc_id", "tokens", F.get("domains", (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("domain"), "domains", "p", "rate", drawn(F.col("rate"), F.col(key)).alias("copies"))


def thin(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", plenty: float = 1.0) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as it is drawn when mixing to ``targets``: left out, once, or repeated.

    The total is ``plenty`` times what uses the domain with the largest weight once. The text is written once with its
    probabilities and not shuffled.
    """
    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    ids, texts = (named.columns[docs.columns.index(c)] for c in (id_col, text_col))
    model = store(fit(docs, labels, id_col, text_col, domain_col))
    soft = store(posteriors(named, model, ids, texts, tuple(named.columns)))
    rated, _ = solve(soft, targets, plenty=plenty)
    copies = drawn(F.col("rate"), _row(ids, texts))
    drawn_rows = rated.where(copies >= 1).select(*named.columns, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return drawn_rows.select(named.columns).toDF(*docs.columns)


def _row(id_col: str, text_col: str) -> Column:
    """What a row is drawn by: rows of one id, or of none, with different texts are different documents."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def drawn(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the row's key."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")
