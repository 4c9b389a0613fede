"""Phrase collocations by set-oriented mining: occurrence relations joined with themselves, counted, and thinned length by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.llm.common import by_bytes, lean, store
from spendweave.llm.lm import _pack, _unpack
from spendweave.session import cut, ranked

#: Occurrences of a candidate, words of the longest, and how many of each language are returned.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer candidate around it has this share of its occurrences.
COVERED = (80, 100)
#: Bytes of text whose occurrences are one block of the relation.
BLOCK_BYTES = 6 << 20
#: Frequent groups (32 MB of keys) and bytes of frequent words up to which they are sent to the tasks; beyond, occurrences are
#: joined with them by shuffling.
BROADCAST_GROUPS, BROADCAST_BYTES = 1 << 22, 64 << 20
#: Ends a piece, in place of any sign that does; no word has it.
STOP = "."
_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")

RELATION = "block long, at binary, ids binary"


class Words:
    """Words of a batch: each one's place, language and number among the batch's distinct words of its language.

    Places count words through the batch, with one left free between pieces and between texts, so two words adjoin in a piece
    exactly when their places differ by one.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data = texts.buffers()[2].to_pybytes().translate(_SIGNS) if texts.buffers()[2] else b""
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(data)], offset=texts.offset)
        texts = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", STOP)))  # a text ends with a stop
        texts = pc.ascii_trim_whitespace(pc.replace_substring(texts, STOP, f" {STOP} "))
        lists = pc.ascii_split_whitespace(texts)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        kind = np.repeat(kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        self.at = np.flatnonzero(word != (pc.index(words, pa.scalar(STOP, pa.large_string())).as_py()))
        found, self.code = np.unique((kind * max(len(words), 1) + word)[self.at], return_inverse=True)
        self.lang, self.word = kinds.dictionary.take(pa.array(found // max(len(words), 1))), words.take(pa.array(found % max(len(words), 1)))


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, word, n``: occurrences of every word, summed in each block before they are shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BLOCK_BYTES):
            own = Words(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([own.lang, own.word.cast(pa.string()), pa.array(np.bincount(own.code, minlength=len(own.word)))], names=["lang", "word", "n"])

    return docs.mapInArrow(lean(scan), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _written(values: np.ndarray) -> bytes:
    return _pack(values.astype(np.uint64)) if len(values) else b""


def _read(data: bytes) -> np.ndarray:
    return _unpack(data, np.uint64).astype(np.int64) if data else np.zeros(0, np.int64)


def _block(made: int) -> int:
    return (TaskContext.get().partitionId() << 32) + made


def _relation(made: int, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows = [_block(made)], [_written(np.diff(at, prepend=0))], [_written(ids)]
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["block", "at", "ids"])


def _opened(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_read(row[0].as_py())), _read(row[1].as_py())


def _flat(made: int, at: np.ndarray, names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), _block(made))), pa.array(at), *columns], names=["block", "at", *names])


def _gathered(flat: DataFrame) -> DataFrame:
    """The relation of ``block, at, id`` rows: each block's occurrences, no more than the block has, in order of their places."""

    def collect(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        at, ids = part["at"].to_numpy(), part["id"].to_numpy()
        return pa.table({"block": part["block"].slice(0, 1), "at": pa.array([_written(np.diff(at, prepend=0))]), "ids": pa.array([_written(ids)])})

    return flat.groupBy("block").applyInArrow(collect, RELATION)


def occurrences(docs: DataFrame, words: DataFrame, n: int, size: int) -> DataFrame:
    """The relation of frequent words: per block, places and word ids, sorted by place. ``words(lang, word, id)`` are ``n`` of ``size`` bytes."""
    spark = docs.sparkSession
    if n <= BROADCAST_GROUPS and size <= BROADCAST_BYTES:
        held = words.select("lang", "word").orderBy("id").toArrow()  # bounded by the test above; the id is the row's number
        sent = spark.sparkContext.broadcast(pc.binary_join_element_wise(held["lang"], held["word"], "\t").combine_chunks())

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for made, batch in enumerate(by_bytes(batches, BLOCK_BYTES)):
                own = Words(batch.column(0), batch.column(1))
                place = pc.index_in(pc.binary_join_element_wise(own.lang, own.word.cast(pa.string()), "\t"), value_set=sent.value)
                ids = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)[own.code]
                yield _relation(made, own.at[ids >= 0], ids[ids >= 0])

        return docs.mapInArrow(lean(thinned), RELATION)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, batch in enumerate(by_bytes(batches, BLOCK_BYTES)):
            own = Words(batch.column(0), batch.column(1))
            code = pa.array(own.code)
            yield _flat(made, own.at, ["lang", "word"], [own.lang.take(code), own.word.take(code).cast(pa.string())])

    flat = docs.mapInArrow(lean(spelled), "block long, at long, lang string, word string")
    return _gathered(flat.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "at", "id"))


def _joined(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's relation merge-joined with itself: where one occurrence's place is followed by another's, the place and both ids."""
    at, ids = _opened(row)
    meets = np.flatnonzero(np.diff(at) == 1)
    return at[meets], ids[meets], ids[meets + 1]


def _grouped(relation: DataFrame) -> DataFrame:
    """``left, right, n``: occurrences of every pair of groups that adjoin, summed in each block before they are shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1)):
                _, left, right = _joined(row)
                lefts, a = np.unique(left, return_inverse=True)
                rights, b = np.unique(right, return_inverse=True)
                found, n = np.unique(a * max(len(rights), 1) + b, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lefts[found // max(len(rights), 1)]), pa.array(rights[found % max(len(rights), 1)]), pa.array(n)], names=["left", "right", "n"])

    return relation.select("at", "ids").mapInArrow(lean(scan), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def extended(relation: DataFrame, groups: DataFrame, n: int, most: tuple[int, int]) -> DataFrame:
    """The relation of phrases one word longer: ``relation`` joined with itself, those of frequent ``groups(left, right, id)`` only."""
    spread = max(most) + 1
    if n <= BROADCAST_GROUPS and spread * spread < 2**63:
        held = groups.select("left", "right").orderBy("id").toArrow()  # bounded by the test above; the id is the row's number
        sent: Broadcast = relation.sparkSession.sparkContext.broadcast(held["left"].to_numpy() * spread + held["right"].to_numpy())

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, made = sent.value, 0
            for batch in batches:
                for row in zip(batch.column(0), batch.column(1)):
                    at, left, right = _joined(row)
                    own = left * spread + right
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    kept = keys[place] == own
                    yield _relation(made, at[kept], place[kept])
                    made += 1

        return relation.select("at", "ids").mapInArrow(lean(thinned), RELATION)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1)):
                at, left, right = _joined(row)
                yield _flat(made, at, ["left", "right"], [pa.array(left), pa.array(right)])
                made += 1

    flat = relation.select("at", "ids").mapInArrow(lean(told), "block long, at long, left long, right long")
    return _gathered(flat.join(groups.select("left", "right", "id"), ["left", "right"]).select("block", "at", "id"))


def _frequent(counts: DataFrame, least: int, order: list[str]) -> tuple[DataFrame, dict]:
    """Those with ``least`` occurrences, numbered from 0 in the given order, and how many they are."""
    frequent, _ = cut(counts.where(F.col("n") >= least))
    size = {"size": F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))} if "word" in order else {"left": F.max("left"), "right": F.max("right")}
    numbered = ranked(frequent, [F.col(c) for c in order], "id").withColumn("id", F.col("id") - 1)
    return cut(numbered, rows=F.count(F.lit(1)), **size)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: tuple[int, int] = COVERED,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words by how firmly their words stick together.

    Pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs; letters A-Z count as small. A null text has no words, a
    null language is ``und``. A phrase needs ``least`` occurrences ``a``, overlapping ones included; its score is the least, over
    its cuts, of ``floor(2000000 a / (l + r))`` with the occurrences of both parts (of equal ones, the first cut's), and it goes if
    a longer candidate around it has ``covered`` of its occurrences. ``n`` are all words of the language.

    The relation of frequent words is written, sorted by place; a phrase of k+1 words is two phrases of k whose places adjoin in
    a piece. So each length is a merge join of the relation with itself, a count by group, and a semi join with the frequent
    groups, whose relation is written for the next length. Groups are pairs of the numbers of shorter ones, so nothing rests on
    hashes. Counts are summed per block before they are shuffled; frequent groups are sent to the tasks while they are few and
    joined by shuffling beyond. Repeated rows count each. An empty table gives no rows.
    """
    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = store(_counted(narrow))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    words, seen = _frequent(counts, least, ["lang", "word"])
    held = words.select("id", "lang", F.col("n").alias("a"), F.array("word").alias("words"), F.array().cast("array<long>").alias("pre"), F.array().cast("array<long>").alias("post"))
    relation = store(occurrences(narrow, words, seen["rows"], seen["size"]))
    found: list[DataFrame] = []
    for length in range(2, longest + 1):
        groups, seen = _frequent(_grouped(relation), least, ["left", "right"])
        if not seen["rows"]:
            break
        left, right = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in ("l", "r"))
        held = store(
            groups.join(left, F.col("left") == F.col("l_id")).join(right, F.col("right") == F.col("r_id")).select(
                "id", "left", "right", F.col("l_lang").alias("lang"), F.col("n").alias("a"), F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"),
                F.concat("l_pre", F.array("l_a")).alias("pre"), F.concat(F.array("r_a"), "r_post").alias("post"),
            )
        )
        around = held.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
        if found:  # what lies in a phrase of two words more lies in one of one word more that is at least as frequent
            found[-1] = found[-1].join(around, "id", "left").where(F.coalesce(F.col("around").cast("decimal(20,0)") * covered[1] < F.col("a").cast("decimal(20,0)") * covered[0], F.lit(True))).drop("around")
        found.append(held.drop("left", "right"))
        held = held.select("id", "lang", "a", "words", "pre", "post")
        if length < longest:
            relation = store(extended(relation, groups, seen["rows"], (seen["left"], seen["right"])))
    if not found:
        return narrow.where("false").selectExpr("lang", "0 AS rank", "lang AS phrase", *[f"0L AS {c}" for c in ("a", "l", "r", "n", "score")])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    big = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(F.sequence(F.lit(0), F.size("pre") - 1), lambda j: F.struct(F.get("pre", j).alias("l"), F.get("post", j).alias("r"), j.alias("j")))
    scored = every.withColumn("cut", F.explode(cuts)).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a",
        F.struct(F.expr("cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0)) div (cast(cut.l AS decimal(19,0)) + cast(cut.r AS decimal(19,0)))").alias("score"), F.col("cut.j"), F.col("cut.l"), F.col("cut.r")).alias("cut"),
    ).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score"))
