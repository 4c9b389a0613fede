"""Quality rules whose thresholds follow from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import coded_words, fresh, lean, store

SYMBOLS, SPACE, WINDOW = "[#*$%&|<>]", " \t\n\x0b\x0c\r", 8
#: Bits of a value that a sketch keeps: a bucket is at most a thirty-second of its value wide.
KEPT_BITS = 6
#: Documents a language and source must have for thresholds of their own; else the language's, else those of all.
LEAST_DOCS = 100
#: How many quartile distances beyond a quartile a measure may lie, and the slack added to that, by measure. The measures are
#: integers: symbols, repeated lines and repeated words in thousandths of characters or words, mean word length in hundredths.
REACH = 4
SLACK = {"symbols": 30, "length": 250, "dup_lines": 20, "repeats": 250}
TWO_SIDED = ("length",)


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of eight that are found twice or more, the first included.

    Windows of two, four and eight words are numbered in turn from the numbers of their halves, so equal numbers are equal
    windows, and memory stays at a few numbers a word.
    """
    rank, step = codes, 1
    while step < WINDOW:
        if len(rank) <= step:
            return 0
        found, rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)
        if len(found) == len(rank):
            return 0
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:-WINDOW][twice] += 1
    np.subtract.at(edge, np.flatnonzero(twice) + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return again


def measures(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each whole text."""
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            offsets, codes, words = coded_words(texts)
            sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            chars = np.concatenate([[0], np.cumsum(sizes[codes])])[offsets]
            columns = [
                np.diff(offsets),
                np.diff(chars),
                pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
                np.array([repeated_lines(t) if "\n" in t else 0 for t in texts.to_pylist()], np.int64),
                np.array([repeated_words(codes[a:b]) for a, b in zip(offsets, offsets[1:])], np.int64),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, columns)], names=[*carry, *told])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{n} long" for n in told)])
    return docs.select(F.col(text_col).cast("string").alias(fresh("text")), *carry).mapInArrow(lean(scan), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _values() -> Column:
    """The measures that thresholds are set for, as an array of (measure, value)."""
    per = lambda n, of, times: F.floor(times * F.col(n) / F.greatest(F.col(of), F.lit(1))).cast("long")
    values = {
        "symbols": per("n_symbols", "word_chars", 1000), "length": per("word_chars", "n_words", 100),
        "dup_lines": per("n_dup_lines", "n_words", 1000), "repeats": per("n_repeat_words", "n_words", 1000),
    }
    return F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketches ``by..., measure, bucket, n``: counts of values in buckets of bounded relative width.

    Sketches of parts are merged by adding counts, in any order and to the same result, so the hottest group leaves each task
    as a few hundred rows.
    """
    value = F.col("v.value")
    width = F.expr("shiftleft(1L, greatest(length(bin(v.value)) - %d, 0))" % KEPT_BITS)
    return measured.select(*by, F.explode(_values()).alias("v")).groupBy(*by, F.col("v.measure").alias("measure"), (value - value % width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by..., docs, bounds``: per measure the least and the most that a document of the group may have."""
    keys = ", ".join([*by, "measure"])
    summed = sketches.selectExpr(*by, "measure", "bucket", "n", f"sum(n) over (partition by {keys} order by bucket) as upto", f"sum(n) over (partition by {keys}) as docs")
    quartiles = summed.groupBy(*by, "measure").agg(
        F.max("docs").alias("docs"), F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= 3 * F.col("docs"), F.col("bucket"))).alias("q3")
    )
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])[F.col("measure")]
    room = REACH * (F.col("q3") - F.col("q1")) + slack
    bounds = F.struct(F.when(F.col("measure").isin(*TWO_SIDED), F.col("q1") - room).otherwise(F.lit(0)).alias("low"), (F.col("q3") + room).alias("high"))
    return quartiles.groupBy(*by).agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("measure", bounds.alias("b")))).alias("bounds"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """Measures of every row of ``docs`` with ``base_failed`` and ``kept``.

    Thresholds come from the documents that pass the base rules. A null language or source is a group like any other; a null
    text has no words and fails. Rows that repeat a doc_id count each. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    measured = store(measures(named, ["doc_id", "lang", "source"]))
    fine = store(sketch(measured.where(~base_failed()), ["lang", "source"]))
    by_lang = merge(fine, ["lang"])
    one, two, three = fences(fine, ["lang", "source"]), fences(by_lang, ["lang"]), fences(merge(by_lang, []), [])
    single = lambda df, name: df.withColumn("k", F.lit(1)).alias(name)
    joined = single(one, "a").join(two.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(F.broadcast(single(three, "c")), F.col("a.k") == F.col("c.k"))  # c is one row
    chosen = joined.select(
        F.col("a.lang").alias("g_lang"), F.col("a.source").alias("g_source"),
        F.when(F.col("a.docs") >= least_docs, F.col("a.bounds")).when(F.col("b.docs") >= least_docs, F.col("b.bounds")).otherwise(F.col("c.bounds")).alias("bounds"),
    )
    told = measured.join(store(chosen), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.forall(_values(), lambda v: v["value"].between(F.col("bounds")[v["measure"]]["low"], F.col("bounds")[v["measure"]]["high"]))
    return told.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"),
    )
