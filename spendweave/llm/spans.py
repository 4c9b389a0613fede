"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.common import filter_bits, fresh, lean, row_keys, store
from spendweave.session import cut

#: A span is the shortest run of so many sentences or more that has so many words or more.
SENTENCES, WORDS = 2, 8
#: A text is cut into these pieces, which put together are the text: sentences with their end signs, and line ends.
PIECE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n")
#: Signs that don't make a piece a sentence.
BLANK = b" \t\n\x0b\x0c\r.!?"
#: Least bits of the filter of repeated spans: 8 MB; it grows with them.
FILTER_BITS = 26


def sentences(text: str) -> tuple[list[str], list[int], list[bytes], list[int]]:
    """Pieces of a text; of those with a word, their numbers, their words joined by one space, and the number of words."""
    pieces = PIECE.findall(text)
    numbers, keys, sizes = [], [], []
    for k, piece in enumerate(pieces):
        raw = piece.encode("utf-8", "surrogatepass")
        if raw.strip(BLANK):
            words = raw.split()
            numbers.append(k)
            keys.append(b" ".join(words))
            sizes.append(len(words))
    return pieces, numbers, keys, sizes


def runs(sizes: list[int], least_sentences: int = SENTENCES, least_words: int = WORDS) -> Iterator[tuple[int, int]]:
    """``(first, last)`` of the span that begins at each sentence, where the text is long enough for one."""
    last, words = -1, 0
    for first in range(len(sizes)):
        while last + 1 < len(sizes) and (last - first + 1 < least_sentences or words < least_words):
            last += 1
            words += sizes[last]
        if last - first + 1 < least_sentences or words < least_words:
            return
        yield first, last
        words -= sizes[first]


def _spans(docs: DataFrame) -> DataFrame:
    """The first half of each span's hash, for counting."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: list[int] = []
            for text in batch.column(0).to_pylist():
                if text:
                    _, _, keys, sizes = sentences(text)
                    heads += [xxhash.xxh3_128_intdigest(b"\n".join(keys[a : b + 1])) >> 64 for a, b in runs(sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(heads, np.uint64).view(np.int64))], names=["head"])

    return docs.select("text").mapInArrow(lean(scan), "head long")


def _occurrences(docs: DataFrame, passing: Broadcast, filtered: int) -> DataFrame:
    """Spans whose hash is in the filter: ``key, doc_id, row, text_key, first, last``, the numbers of their first and last pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, row, text_key in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    _, numbers, keys, sizes = sentences(text)
                    for a, b in runs(sizes):
                        key = xxhash.xxh3_128_digest(b"\n".join(keys[a : b + 1]))
                        slot = int.from_bytes(key[:4], "big") >> (32 - filtered)
                        if bits[slot >> 3] >> (slot & 7) & 1:
                            for column, value in zip(out, (key, doc, row, text_key, numbers[a], numbers[b])):
                                column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["key", "doc_id", "row", "text_key", "first", "last"])

    return docs.mapInArrow(lean(scan), "key binary, doc_id long, row long, text_key long, first int, last int")


def _filter(heads: DataFrame, filtered: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the leading ``filtered`` bits of repeated hashes."""
    slot = F.shiftrightunsigned("head", 64 - filtered) + 1
    pieces = heads.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    whole = np.zeros(2 ** (filtered - 3), np.uint8)
    for row in pieces.toLocalIterator():  # 2**filtered / 32768 pieces of 4 KB at most
        whole[(row[0] - 1) * 4096 : row[0] * 4096] = np.frombuffer(row[1], np.uint8)
    return whole


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every span but the first occurrence (smallest doc_id, row, then place) of those that repeat: ``row, text_key, first, last``.

    Half hashes of all spans are counted first, combined before the shuffle; only spans of a repeated one go on, with 128 bits.
    ``row`` and ``text_key`` are :func:`row_keys`: rows of one id, or of none, with different texts are different documents.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_keys(id_col, text_col))
    twice, seen = cut(_spans(narrow).groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), n=F.count(F.lit(1)))
    filtered = filter_bits(seen["n"], FILTER_BITS)
    found = store(_occurrences(narrow, docs.sparkSession.sparkContext.broadcast(_filter(twice, filtered)), filtered))
    place = F.struct("doc_id", "row", "text_key", F.col("first").alias("at"))
    least = store(found.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("key", "low"))
    return found.join(least, "key").where(place > F.col("low")).select("row", "text_key", "first", "last").distinct()


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` without the sentences that a repeated span covers, but for its first occurrence; ``removed_col`` counts them.

    Every other column stays. What is between sentences, line ends and stray signs, stays too. A null text stays null; texts
    that are too short for a span are left alone. Spans that repeat inside a text count as well. What is removed grows with the
    corpus, so it is met by a sorted join at every size.
    """
    row, text_key, firsts, lasts = fresh("row"), fresh("text"), fresh("firsts"), fresh("lasts")
    ranges = repeated_spans(docs, id_col, text_col).groupBy(F.col("row").alias(row), F.col("text_key").alias(text_key)).agg(F.collect_list("first").alias(firsts), F.collect_list("last").alias(lasts))
    named = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    renamed = docs.toDF(*named)
    keys = row_keys(named[docs.columns.index(id_col)], named[at])
    keyed = renamed.select(*named, *(key.alias(name) for key, name in zip(keys, (row, text_key))))
    joined = keyed.join(ranges.hint("merge"), [row, text_key], "left").select(*named, firsts, lasts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(np.asarray(batch.column(len(named)).is_valid())):
                pieces, numbers, _, _ = sentences(texts[k])
                edge = np.zeros(len(pieces) + 1, np.int64)
                np.add.at(edge, np.array(batch.column(len(named))[int(k)].as_py()), 1)
                np.subtract.at(edge, np.array(batch.column(len(named) + 1)[int(k)].as_py()) + 1, 1)
                gone = np.cumsum(edge)[:-1] > 0
                dropped = {n for n in numbers if gone[n]}
                texts[k] = "".join(p for n, p in enumerate(pieces) if n not in dropped)
                counts[k] = len(dropped)
            columns = batch.columns[: len(named)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*named, "n"])

    schema = T.StructType([*joined.schema.fields[: len(named)], T.StructField("n", T.LongType())])
    return joined.mapInArrow(lean(scan), schema).toDF(*docs.columns, removed_col)
