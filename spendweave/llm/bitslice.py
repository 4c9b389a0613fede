"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.llm.common import lean, lean_group, store

#: Rows of an index block and queries of a chunk: the pieces that meet in one task.
BLOCK_ROWS, CHUNK_ROWS = 16_384, 128


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, q``: components as ``floor(scale * x)``; vectors that are null or hold null or non-finite components are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers; a shorter vector is filled up with zeros."""
    lists = column.to_pylist()
    whole = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for k, values in enumerate(lists):
        whole[k, : len(values)] = values
    return whole


def slice_block(ids: np.ndarray, values: np.ndarray) -> dict:
    """A block of the index: rows by id, and for each attribute its least value and the bitmaps of what exceeds it."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    least = values.min(axis=0, initial=np.iinfo(np.int64).max) if len(ids) else np.zeros(values.shape[1], np.int64)
    over = (values - least).astype(np.uint64)
    bits = np.array([int(c).bit_length() for c in over.max(axis=0, initial=0)], np.int64)
    rows = -len(ids) % 64
    maps = [np.packbits(np.pad((over[:, d] >> np.uint64(b)).astype(np.uint8) & 1, (0, rows)), bitorder="little") for d in range(values.shape[1]) for b in range(bits[d])]
    return {"ids": ids.tobytes(), "least": least.tobytes(), "widths": bits.tobytes(), "maps": b"".join(m.tobytes() for m in maps)}


class Slices:
    """An opened block, which adds attribute slices up to the slices of a query's scores."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.least = np.frombuffer(row["least"], np.int64)
        widths = np.frombuffer(row["widths"], np.int64)
        words = -(-len(self.ids) // 64)
        maps = np.frombuffer(row["maps"], np.uint64).reshape(-1, words)
        ends = np.cumsum(widths)
        self.maps = [maps[e - w : e] for e, w in zip(ends, widths)]
        self.inverse = [~m for m in self.maps]
        self.all = np.packbits(np.arange(words * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices from the least significant one, and what must be added to a score read off them.

        A negative factor takes the inverse bitmaps, so that all addends count up. Addends of one weight go through carry-save
        adders, three becoming a sum and a carry, until one is left of every weight.
        """
        columns: list[list[np.ndarray]] = []
        shift = 0
        for d, factor in enumerate(query.tolist()):
            if d >= len(self.maps):
                break
            shift += factor * int(self.least[d])
            if factor < 0:
                shift += factor * (2 ** len(self.maps[d]) - 1)
            planes = self.maps[d] if factor > 0 else self.inverse[d]
            factor, at = abs(factor), 0
            while factor:
                if factor & 1:
                    while len(columns) < at + len(planes):
                        columns.append([])
                    for b in range(len(planes)):
                        columns[at + b].append(planes[b])
                factor >>= 1
                at += 1
        shift = (shift + 2**63) % 2**64 - 2**63
        done, k = [], 0
        while k < len(columns):
            column = columns[k]
            if k + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[k + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                columns[k + 1].append(a & b)
                column = [a ^ b]
            done.append(column[0] if column else np.zeros_like(self.all))
            k += 1
        return done, shift

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` highest scores of other rows, ties to smaller ids.

        From the most significant slice downward, rows with the bit are taken as long as they are no more than ``k``, and
        looked at alone as soon as they are more. The rows that are equal at the boundary fill up by id.
        """
        slices, shift = self.sums(query)
        open_ = self.all.copy()
        own = np.flatnonzero(self.ids == query_id)
        np.bitwise_and.at(open_, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        taken, n = np.zeros_like(open_), 0
        for plane in reversed(slices):
            upper = open_ & plane
            more = int(np.bitwise_count(upper).sum())
            if n + more > k:
                open_ = upper
            else:
                taken |= upper
                n += more
                open_ &= ~plane
                if n == k:
                    break
        bits = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        rows = np.concatenate([bits(taken), bits(open_)[: k - n]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        scores = np.full(len(rows), shift, np.int64)
        for at, plane in enumerate(slices):
            scores += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << at
        return self.ids[rows], scores


INDEX = "block long, ids binary, least binary, widths binary, maps binary"


def build(rows: DataFrame, blocks: int) -> DataFrame:
    """The index over ``vec_id, q`` in equally large blocks, numbered from 0: rows are dealt out in turn, whatever their ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            values.append(_matrix(batch.column(1)))
        if sum(map(len, ids)):
            width = max(v.shape[1] for v in values)
            block = slice_block(np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in values]))
            block = {"block": TaskContext.get().partitionId()} | block
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in block.values()], names=list(block))

    return store(rows.repartition(blocks).mapInArrow(lean(scan), INDEX))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the highest inner product with each query, itself left out.

    Both take ``vec_id, q`` of :func:`quantised`. Every block of the index meets every chunk of queries once; a block hands on
    ``k`` rows a query, and the best of these are the result. A vec_id names a vector: rows with the query's id are its own,
    and of queries that repeat an id the smallest is asked. Candidates that repeat an id stand each for itself. A shorter
    vector counts as filled up with zeros; integers wrap beyond 64 bits. No rows or no queries give no rows.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    index = build(rows, blocks)
    asked = store(queries.groupBy("vec_id").agg(F.min("q").alias("q")))
    chunks = max(1, -(-asked.count() // chunk_rows))
    told = "query_id long, vec_id long, score long"

    def meet(_, block: pa.Table, chunk: pa.Table) -> pa.Table:
        queries, ids, scores = [], [], []
        for row in block.to_pylist() if chunk.num_rows else []:
            opened = Slices(row)
            for query, values in zip(chunk["vec_id"].to_pylist(), _matrix(chunk["q"])):
                own, found = opened.top(query, values, k)
                queries.append(np.full(len(own), query))
                ids.append(own)
                scores.append(found)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (queries, ids, scores)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(lean_group(meet), told)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
