"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import filter_bits, fresh, lean, row_keys, store
from spendweave.session import cut

#: One line in so many ends a chunk; the multiplier of the rolling hash over two line hashes.
EVERY, STEP = 4, 31
#: Least bits of the filter that keeps unrepeated chunks' texts from being shuffled: 2 MB; it grows with the repeated chunks.
FILTER_BITS = 24
SPACE = " \t\n\x0b\x0c\r"


def line_hash(line: str) -> int:
    return int(hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)


def chunk_bounds(lines: list[str]) -> list[tuple[int, int]]:
    """``(first line, number of lines)`` of the chunks of a text of two or more lines; none for a single line.

    A rolling hash over the hashes of a line and the one before proposes a cut after the line. A proposal straight after
    another one, after the first line, or before the last is passed over, so every chunk has two lines or more, and whether
    a cut stands depends on three lines only: text put in or taken out elsewhere doesn't move it.
    """
    if len(lines) < 2:
        return []
    hashes = [line_hash(x) for x in lines]
    proposed = [False] + [(STEP * a + b) % EVERY == 0 for a, b in zip(hashes, hashes[1:])]
    cuts = [0] + [i + 1 for i in range(1, len(lines) - 2) if proposed[i] and not proposed[i - 1]] + [len(lines)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _chunks(docs: DataFrame, passing: Broadcast | None, filtered: int = 0) -> DataFrame:
    """Chunks that have a word: ``doc_id, row, text_key, first_line, n_lines, key``; with ``passing`` those in the filter only, and their text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if passing is None else passing.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text, row, text_key in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                for first, n in chunk_bounds(lines):
                    chunk = "\n".join(lines[first : first + n])
                    key = hashlib.md5(chunk.encode("utf-8", "surrogatepass")).digest()
                    slot = int.from_bytes(key[:8], "big") >> (64 - filtered)
                    if (bits is None or bits[slot >> 3] >> (slot & 7) & 1) and chunk.strip(SPACE):
                        for column, value in zip(out, (doc, row, text_key, first, n, key, None if bits is None else chunk)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["doc_id", "row", "text_key", "first_line", "n_lines", "key", "chunk"])

    return docs.mapInArrow(lean(scan), "doc_id long, row long, text_key long, first_line int, n_lines int, key binary, chunk string")


def _filter(keys: DataFrame, filtered: int) -> np.ndarray:
    """A bitmap of the keys' leading ``filtered`` bits."""
    slot = F.shiftright(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), 32 - filtered) + 1
    pieces = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    whole = np.zeros(2 ** (filtered - 3), np.uint8)
    for piece, bits in pieces.toLocalIterator():  # 2**filtered / 32768 pieces of 4 KB at most
        whole[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, np.uint8)
    return whole


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks to remove: ``row, text_key, first_line, n_lines`` of each occurrence but the first (smallest doc_id, row, then line).

    ``row`` and ``text_key`` are :func:`row_keys`: rows of one id, or of none, with different texts are different documents. Keys alone are counted over all documents. Only chunks with a repeated key have their text moved, and they are grouped by
    key and text, so two chunks are the same when their bytes are. A chunk that very many documents share is combined before
    the shuffle, and its join is split by adaptive execution.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_keys(id_col, text_col))
    place = F.struct("doc_id", "row", "text_key", "first_line")
    keys = _chunks(narrow, None).groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    twice, seen = cut(keys.where("low < high").select("key"), n=F.count(F.lit(1)))
    filtered = filter_bits(seen["n"], FILTER_BITS)
    found = store(_chunks(narrow, docs.sparkSession.sparkContext.broadcast(_filter(twice, filtered)), filtered))
    first = store(found.groupBy("key", "chunk").agg(F.min(place).alias("first")))
    later = found.join(first, ["key", "chunk"]).where(place > F.col("first"))
    return later.select("row", "text_key", "first_line", "n_lines").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with every globally repeated chunk of lines taken out of its text, but for the first, and the lines taken.

    Every column of ``docs`` stays; ``removed_col`` is added. A null text stays null, a text of one line is left alone, and a
    text of which nothing stays becomes empty. Chunks without a word are never removed. Rows that repeat a doc_id and its text
    count as one document, all of them with the same cuts; rows with one doc_id, or none, and other texts are documents of their own. The cuts grow with the corpus, so they are met by a sorted join at every size.
    """
    ranges, row, text_key, at = fresh("ranges"), fresh("row"), fresh("text"), fresh("lines")
    removed = store(repeated_chunks(docs, id_col, text_col)).groupBy(F.col("row").alias(row), F.col("text_key").alias(text_key)).agg(
        F.sort_array(F.collect_list(F.struct("first_line", "n_lines"))).alias(ranges)  # no more than the document's own chunks
    )
    keyed = docs.select(*docs.columns, *(key.alias(name) for key, name in zip(row_keys(id_col, text_col), (row, text_key))))
    joined = keyed.join(removed.hint("merge"), [row, text_key], "left").withColumn(at, F.split(text_col, "\n", -1))
    keep = F.expr(
        f"""filter(transform(sequence(0, size({ranges})), k -> struct(
              CASE WHEN k = 0 THEN 0 ELSE {ranges}[k - 1].first_line + {ranges}[k - 1].n_lines END AS a,
              CASE WHEN k = size({ranges}) THEN size({at}) ELSE {ranges}[k].first_line END AS b)), r -> r.a < r.b)"""
    )
    text = F.array_join(F.transform(keep, lambda r: F.array_join(F.slice(F.col(at), r["a"] + 1, r["b"] - r["a"]), "\n")), "\n")
    return joined.select(
        *[F.when(F.col(ranges).isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.aggregate(ranges, F.lit(0), lambda n, r: n + r["n_lines"]), F.lit(0)).cast("long").alias(removed_col),
    )
