"""Taxonomy lookups: candidate codes for a supplier, code validation, search, rules, few-shot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.text import keywords
from spendweave.functions.values import is_code
from spendweave.operators.filters import contains_any
from spendweave.params import Params
from spendweave.session import spread_join

MAX_KEYWORDS = 8
GRAM = 4  # keywords have at least four characters, so each has a first gram of this length


def query_keywords(industry: Column, name: Column, description: Column) -> Column:
    """Up to eight keywords: four of the industry, three of the name, four of the description, in that order."""
    joined = F.concat(keywords(industry, 4), keywords(name, 3), keywords(description, 4))
    return F.slice(F.array_distinct(joined), 1, MAX_KEYWORDS)


def keyword_budget(count: Column, limit: int) -> Column:
    return F.greatest(F.lit(15), F.ceil(F.lit(3.0 * limit) / count)).cast("int")


def _most(limit: int) -> int:
    return max(15, 3 * limit)


def vocabulary(taxonomy: DataFrame, limit: int) -> DataFrame:
    """``token, code``: the words of commodity, class and family names, each with its first codes, as many as ``limit`` candidates can need.

    A word keeps so few only: no later code of it can be among the first of a keyword. Names are a small file and many words, so
    they are dealt by code before they are split.
    """
    names = F.concat_ws(" ", F.lower("commodity"), F.lower("class"), F.lower("family")).alias("names")
    tokens = taxonomy.select("code", names).repartition("code").select("code", F.explode(F.array_distinct(F.split("names", r"\s+"))).alias("token"))
    first = Window.partitionBy("token").orderBy("code")
    return tokens.where(F.length("token") >= GRAM).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= _most(limit)).select("token", "code")


def _postings(words: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """First ``most`` codes (by code) whose commodity, class or family contains each keyword.

    A keyword has no spaces, so it can only lie inside one word of a name. Keywords meet vocabulary words
    through the keyword's first four characters (an equi-join on grams, checked with ``contains``), so the
    result is exactly that of a substring search without comparing every keyword to every name.
    """
    starts = F.transform(F.sequence(F.lit(1), F.length("token") - (GRAM - 1)), lambda i: F.substr("token", i, F.lit(GRAM)))
    grams = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(starts)).alias("gram"))
    pairs = words.withColumn("gram", F.substring("keyword", 1, GRAM)).join(grams, "gram").where(F.col("token").contains(F.col("keyword")))
    hits = pairs.select("keyword", "token").join(tokens, "token").select("keyword", "code").distinct()
    by_code = Window.partitionBy("keyword").orderBy("code")
    hits = hits.withColumn("_rank", F.row_number().over(by_code)).where(F.col("_rank") <= most)
    # at most ``most`` codes per keyword
    return hits.groupBy("keyword").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def candidate_codes(suppliers: DataFrame, taxonomy: DataFrame, limit: int = 20, tokens: DataFrame | None = None) -> DataFrame:
    """Ranked candidate codes per supplier.

    Suppliers with the same keywords have the same candidates, so the search runs once per distinct
    keyword list and the (at most ``limit``) results are joined back. A keyword scores by its best field:
    commodity 10, class 4, family or segment 1. Codes with no commodity hit and a single keyword are
    dropped when any better one exists. ``tokens`` is what :func:`vocabulary` gives for the limit, for several searches.
    """
    asked = suppliers.select(F.col("id").alias("supplier_id"), query_keywords(F.col("industry"), F.col("name"), F.col("description")).alias("words"))
    asked = asked.where(F.size("words") > 0).select("supplier_id", F.array_join("words", " ").alias("query"))
    queries = asked.select("query").distinct().withColumn("words", F.split("query", " "))
    words = queries.select(F.explode("words").alias("keyword")).distinct()
    postings = _postings(words, vocabulary(taxonomy, limit) if tokens is None else tokens, _most(limit))
    budget = keyword_budget(F.size("words"), limit)
    found = (
        queries.select("query", "words", F.explode("words").alias("keyword"))
        .join(postings, "keyword")
        .select("query", "words", F.explode(F.slice("codes", F.lit(1), budget)).alias("code"))
        .distinct()
    )
    names = taxonomy.select("code", "commodity", *[F.lower(c).alias(f"_{c}") for c in ("commodity", "class", "family", "segment")])
    in_field = lambda c, w: F.coalesce(F.col(c).contains(w), F.lit(False))
    points = F.transform(
        F.col("words"),
        lambda w: F.when(in_field("_commodity", w), 10).when(in_field("_class", w), 4).when(in_field("_family", w) | in_field("_segment", w), 1).otherwise(0),
    )
    total = lambda a, f: F.aggregate(a, F.lit(0), lambda s, x: s + f(x))
    scored = (
        found.join(names, "code")
        .withColumn("_points", points)
        .select(
            "query", "code", "commodity",
            total("_points", lambda x: x).alias("score"),
            total("_points", lambda x: F.when(x > 0, 1).otherwise(0)).alias("matched"),
            total("_points", lambda x: F.when(x == 10, 1).otherwise(0)).alias("commodity_hits"),
        )
        .withColumn("relevant", (F.col("commodity_hits") > 0) | (F.col("matched") >= 2))
    )
    # a query has at most eight keywords times ``most`` codes, so these windows are small
    ordered = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("commodity_hits").desc(), F.col("matched").desc(), "code")
    pool = scored.withColumn("_any", F.max("relevant").over(Window.partitionBy("query"))).where(F.col("relevant") | ~F.col("_any"))
    best = pool.withColumn("position", F.row_number().over(ordered)).where(F.col("position") <= limit)
    answers = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "code", "commodity", "score", "matched", "commodity_hits"))).alias("found"))
    return spread_join(asked.select("supplier_id", "query"), answers, "query", spread_by="supplier_id").select("supplier_id", F.inline("found"))


def prefix_index(taxonomy: DataFrame) -> DataFrame:
    """Smallest code under every 8, 6, 4 and 2 digit prefix. Codes are a small file, dealt before they are multiplied."""
    lengths = F.array(*[F.lit(n) for n in (8, 6, 4, 2)])
    return taxonomy.select("code").repartition("code").select("code", F.explode(lengths).alias("digits")).groupBy(F.expr("substring(code, 1, digits)").alias("prefix")).agg(F.min("code").alias("found"))


def validate_codes(rows: DataFrame, taxonomy: DataFrame, spread_by: str, code: str = "unspsc_code") -> DataFrame:
    """Adds ``valid_code`` (exact, else the first code under the longest known prefix, else as given) and
    ``code_unknown``. Each distinct code is looked up once, whatever number of rows carries it."""
    wanted = rows.where(F.col(code).isNotNull()).select(F.col(code).alias("_code")).distinct()
    tries = wanted.where(is_code(F.col("_code"))).select("_code", F.explode(F.array(*[F.lit(n) for n in (8, 6, 4, 2)])).alias("digits"))
    tries = tries.withColumn("prefix", F.expr("substring(_code, 1, digits)"))
    hits = tries.join(prefix_index(taxonomy), "prefix").groupBy("_code").agg(F.max("digits").alias("digits"), F.max_by("found", "digits").alias("found"))
    resolved = hits.select(F.col("_code").alias(code), F.col("found").alias("_found"), (F.col("digits") == 8).alias("_exact"))
    return (
        spread_join(rows, resolved, code, spread_by=spread_by, how="left")
        .withColumn("valid_code", F.coalesce("_found", code))
        .withColumn("code_unknown", ~F.coalesce("_exact", F.lit(False)))
        .drop("_found", "_exact")
    )


def cap_unknown(rows: DataFrame, params: Params) -> DataFrame:
    """Validated rows with the confidence of unknown codes capped."""
    cap = F.lit(params.unknown_code_cap).cast("decimal(3,2)")
    return rows.withColumn("confidence", F.when(F.col("code_unknown"), F.least("confidence", cap)).otherwise(F.col("confidence")))


def few_shot_verified(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Examples with codes replaced by a real one of the same class, family or segment; hopeless ones dropped.
    The check is skipped on an empty taxonomy."""
    if not taxonomy.select("code").limit(1).count():
        return examples
    checked = validate_codes(examples, taxonomy, spread_by="supplier_name")
    exists = taxonomy.select(F.col("code").alias("valid_code"))
    return checked.join(exists, "valid_code", "left_semi").withColumn("unspsc_code", F.col("valid_code")).drop("valid_code", "code_unknown")


def code_search(taxonomy: DataFrame, term: str, limit: int = 25) -> DataFrame:
    text = term.strip()
    rows = taxonomy
    if text.isdigit() and 2 <= len(text) <= 8:
        rows = rows.where(F.col("code").startswith(text))
    elif text:
        rows = rows.where(contains_any(text, "commodity", "class", "family", "segment"))
    return rows.orderBy("code").limit(min(100, limit)).select("code", "commodity", "segment", F.col("class").alias("class_name"))


def rule_classify(rows: DataFrame, rules: list[tuple[str, str, float]], text: str = "name") -> DataFrame:
    """First rule (in the given order) whose text occurs in the name. The rule list is written by hand, so
    it becomes one expression evaluated in place: no join at all."""
    wanted = F.lower(F.col(text))
    pick = None
    for position, (match, code, confidence) in enumerate(rules):
        hit = F.struct(F.lit(position).alias("rule"), F.lit(code).alias("code"), F.lit(confidence).alias("confidence"))
        test = wanted.contains(match.lower())
        pick = F.when(test, hit) if pick is None else pick.when(test, hit)
    return rows.withColumn("_rule", pick).select("*", "_rule.*").drop("_rule")
