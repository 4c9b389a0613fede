"""Scoring batches: fixed-size request batches per tier, prompts, the scorer hook and answer alignment."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.text import entity_key
from spendweave.operators.candidates import candidate_codes
from spendweave.session import ranked

SYSTEM_TEXT = (
    "Task: procurement categorisation. Every supplier gets one commodity code of the taxonomy, eight digits written as a "
    "string, for what it mainly sells. Be as specific as the facts allow and say so in the confidence. Reply in JSON, nothing else."
)
PARENT_SYSTEM_TEXT = (
    "Task: company ownership. For every supplier find the company at the top of its group; null stands for a company of its "
    "own. Doubt belongs in the confidence. Reply in JSON, nothing else."
)
NO_CANDIDATES = "(none found)"
# The members of an answer.
ONE_ANSWER = '{"unspsc_code": "8 digits", "confidence": 0.0-1.0, "reasoning": "short", "alternatives": [{"code": "8 digits", "confidence": 0.0-1.0}]}'
BATCH_ANSWER = '{"results": [{"supplier_name": "...", "unspsc_code": "8 digits", "confidence": 0.0-1.0, "reasoning": "..."}]}'
PARENT_ANSWER = '{"results": [{"supplier_name": "...", "parent_name": "...", "parent_domain": "...", "is_subsidiary": true, "confidence": 0.0-1.0}]}'


def request_batches(items: DataFrame, size: int, group: str = "model", key: str = "id") -> DataFrame:
    """Adds ``position`` within the tier and ``batch_no``; a batch never mixes tiers. Two tiers would mean
    two window tasks, so positions come from a distributed sort."""
    numbered = ranked(items, [F.col(key).asc()], "position", group=group)
    return numbered.withColumn("batch_no", F.ceil(F.col("position") / F.lit(size)).cast("long"))


def example_text(examples: DataFrame) -> str:
    """Few-shot lines, a supplier and its answer in one JSON object each. The examples are the short few-shot list."""
    order = ["priority"] if "priority" in examples.columns else ["supplier_name", "unspsc_code"]
    rows = examples.orderBy(*order).limit(10).collect()
    facts = lambda r: {k: r[c] for k, c in (("name", "supplier_name"), ("domain", "domain"), ("industry", "industry"), ("naics", "naics")) if r[c]}
    return "\n".join(
        json.dumps({"supplier": facts(r), "answer": {"unspsc_code": r.unspsc_code, "confidence": float(r.confidence), "reasoning": r.reasoning}}, ensure_ascii=False) for r in rows
    )


def candidate_lines(candidates: DataFrame, taxonomy: DataFrame, key: str = "supplier_id") -> DataFrame:
    """Candidate list per supplier (or batch) as prompt text, at most the candidate limit for each."""
    path = F.concat_ws(" / ", "segment", "family", "class", "commodity")
    lines = candidates.select(key, "position", "code").join(taxonomy.select("code", "segment", "family", "class", "commodity"), "code")
    line = F.concat_ws(" ", "code", path)
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l")).select(
        key, F.array_join(F.col("l.line"), "\n").alias("candidate_text")
    )


def batch_candidates(batches: DataFrame, taxonomy: DataFrame, limit: int = 15, tokens: DataFrame | None = None) -> DataFrame:
    """``model, batch_no, candidate_text``: codes that fit the industries and descriptions of a batch's suppliers together."""
    words = lambda c: F.concat_ws(" ", F.array_sort(F.collect_set(c)))  # noqa: E731  a batch's few rows
    joint = batches.groupBy("model", "batch_no").agg(words("industry").alias("industry"), words("description").alias("description"))
    joint = joint.select("model", "batch_no", F.concat_ws("#", "model", F.col("batch_no").cast("string")).alias("id"), "industry", F.lit(None).cast("string").alias("name"), "description")
    found = candidate_lines(candidate_codes(joint, taxonomy, limit, tokens), taxonomy)
    return joint.select("model", "batch_no", F.col("id").alias("supplier_id")).join(found, "supplier_id").select("model", "batch_no", "candidate_text")


def _facts(columns: list[str], have: list[str]) -> Column:
    """The known facts of a supplier as one JSON object; what isn't known is left out."""
    value = lambda c: F.substring(c, 1, 200) if c == "description" else F.array_join(F.slice(c, 1, 8), ", ") if c == "subsidiary_names" else F.col(c)
    return F.struct(*[F.nullif(value(c), F.lit("")).alias("subsidiaries" if c == "subsidiary_names" else c) for c in columns if c in have])


def single_prompts(subjects: DataFrame, examples: str) -> DataFrame:
    """One prompt per supplier, with its candidates and known subsidiaries when present."""
    fields = ["name", "domain", "industry", "naics", "sic", "description", "country", "parent_name", "parent_domain", "subsidiary_names"]
    candidates = F.coalesce("candidate_text", F.lit(NO_CANDIDATES)) if "candidate_text" in subjects.columns else F.lit(NO_CANDIDATES)
    prompt = F.concat_ws(
        "\n",
        F.lit(SYSTEM_TEXT), F.lit("Solved before:"), F.lit(examples or NO_CANDIDATES),
        F.lit("Codes worth a look (others are allowed if they exist):"), candidates,
        F.lit("Supplier:"), F.to_json(F.struct(_facts(fields, subjects.columns).alias("supplier"))),
        F.lit("Reply with: " + ONE_ANSWER),
    )
    return subjects.select("id", prompt.alias("prompt"))


def _slots(batches: DataFrame, size: int) -> DataFrame:
    return batches.withColumn("slot", (F.pmod(F.col("position") - 1, F.lit(size)) + 1).cast("int"))


def _gathered(batches: DataFrame, size: int, fields: list[str]) -> DataFrame:
    """Supplier lines of each batch, numbered; only a batch's few rows are gathered together."""
    line = F.to_json(F.struct(F.col("slot").alias("n"), _facts(fields, batches.columns).alias("supplier")))
    return _slots(batches, size).groupBy("model", "batch_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("suppliers")
    )


def _asked(answer: str) -> Column:
    return F.concat(F.lit("Reply with one object, its list as long as the suppliers ("), F.col("suppliers").cast("string"), F.lit(") and in their order: " + answer))


def batch_prompts(batches: DataFrame, size: int, examples: str, candidates: DataFrame | None = None) -> DataFrame:
    """One prompt per batch of at most ``size`` suppliers. ``candidates`` is what :func:`batch_candidates` gives."""
    gathered = _gathered(batches, size, ["name", "domain", "industry", "naics", "sic", "description", "parent_name"])
    gathered = gathered.join(candidates, ["model", "batch_no"], "left") if candidates is not None else gathered.withColumn("candidate_text", F.lit(None).cast("string"))
    prompt = F.concat_ws(
        "\n",
        F.lit(SYSTEM_TEXT), F.lit("Solved before:"), F.lit(examples or NO_CANDIDATES),
        F.lit("Codes worth a look (others are allowed if they exist):"), F.coalesce("candidate_text", F.lit(NO_CANDIDATES)),
        F.lit("Suppliers:"), "lines", _asked(BATCH_ANSWER),
    )
    return gathered.select("model", "batch_no", "suppliers", prompt.alias("prompt"))


def parent_prompts(batches: DataFrame, size: int) -> DataFrame:
    gathered = _gathered(batches, size, ["name", "domain", "industry"])
    prompt = F.concat_ws("\n", F.lit(PARENT_SYSTEM_TEXT), F.lit("Suppliers:"), "lines", _asked(PARENT_ANSWER))
    return gathered.select("model", "batch_no", "suppliers", prompt.alias("prompt"))


def score_batches(prompts: DataFrame, score: Callable, partitions: int | None = None) -> DataFrame:
    """Call ``score(pdf) -> pdf`` with columns model, batch_no, prompt -> model, batch_no, response.

    ``partitions`` bounds how many calls run at once. When a call raises, its batches are asked one by one, and one that raises
    alone has a null response; the others are not lost. A retried task repeats its batches, so answers are
    keyed by batch and the smallest is kept.
    """
    wanted = prompts.select("model", "batch_no", "prompt")
    wanted = wanted.repartition(partitions, "model", "batch_no") if partitions else wanted

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            try:
                yield score(frame)[["model", "batch_no", "response"]]
            except Exception:  # noqa: BLE001  whatever a client raises
                for k in range(len(frame)):
                    one = frame.iloc[[k]]
                    try:
                        yield score(one)[["model", "batch_no", "response"]]
                    except Exception:  # noqa: BLE001
                        yield one.assign(response=None)[["model", "batch_no", "response"]]

    answers = wanted.mapInPandas(run, "model string, batch_no bigint, response string")
    return answers.groupBy("model", "batch_no").agg(F.min("response").alias("response"))


def align_results(batches: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Match answer items ``(model, batch_no, item_no, supplier_name, …)`` to the batch's suppliers: by
    entity key, else by position; the first item claiming a supplier wins. Also returns the unanswered."""
    slots = _slots(batches, size)
    keyed = slots.groupBy("model", "batch_no", entity_key(F.col("name")).alias("_key")).agg(F.min("slot").alias("_by_name"))
    named = items.withColumn("_key", F.when(F.col("supplier_name").isNotNull(), entity_key(F.col("supplier_name"))))
    placed = named.join(keyed, ["model", "batch_no", "_key"], "left").withColumn("slot", F.coalesce("_by_name", F.col("item_no").cast("int"))).drop("_key", "_by_name")
    payload = [c for c in placed.columns if c not in ("model", "batch_no", "slot")]
    first = placed.groupBy("model", "batch_no", "slot").agg(F.min_by(F.struct(*payload), "item_no").alias("r")).select("model", "batch_no", "slot", "r.*")
    answered = slots.select("model", "batch_no", "slot", F.col("id").alias("supplier_id"), "name").join(first, ["model", "batch_no", "slot"])
    missing = slots.join(first.select("model", "batch_no", "slot"), ["model", "batch_no", "slot"], "left_anti")
    return answered, missing
