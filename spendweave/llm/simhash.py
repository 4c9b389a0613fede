"""Near-duplicates by SimHash, found with vantage-point trees over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import components, lean, split_words, store

#: Fingerprints that a shard should hold; the sampled tree above the shards has this many fewer leaves than fingerprints.
SHARD_ROWS = 16_384
#: Most fingerprints that are sampled for that tree, and how many each of its leaves is given.
SAMPLE_ROWS, SAMPLE_PER_LEAF = 65_536, 64
LEAF_ROWS = 256


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """SimHash of word shingles: bit set if set in over half of the shingle hashes, repeats included; zero without words."""
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    return folded(np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts, ends[last:])), np.dtype("<u8"), n))


def folded(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without any."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each whole text as a signed long. A null text has no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, words = split_words(batch.column(1), lower=True)
            words = words.cast(pa.large_binary())
            fps = [fingerprint(words[a:b].to_pylist(), width) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(scan), "doc_id long, fp long")


# ---- vantage-point trees -------------------------------------------------------------------------------------------------


def _distance(fps: np.ndarray, to: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ to)


def plan_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree of ``depth`` levels in heap order, from sampled fingerprints."""
    points, radii = np.zeros(2**depth, np.uint64), np.full(2**depth, 32, np.int64)
    held = {1: sample}
    for node in range(1, 2**depth):
        own = held.pop(node, sample[:0])
        if len(own):
            points[node] = own[len(own) // 2]
            far = _distance(own, points[node]).astype(np.int64)
            radii[node] = int(np.median(far))
            held[2 * node], held[2 * node + 1] = own[far <= radii[node]], own[far > radii[node]]
    return points, radii


def route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards that each fingerprint must be in: (row, shard, is its home).

    A fingerprint lives in one shard and visits others. Of two that lie on both sides of a ball within ``radius``, the inner
    one visits the outer side, so each link is met in exactly one shard; a visitor follows every branch that the triangle
    bound leaves open.
    """
    row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(depth):
        far = _distance(fps[row], points[node]).astype(np.int64)
        mu = radii[node]
        inside = np.where(home, far <= mu, far - radius <= mu)
        outside = np.where(home, far > mu, far + radius > mu)
        crossing = home & inside & (far + radius > mu)
        row, node, home = (
            np.concatenate([row[inside], row[outside], row[crossing]]),
            np.concatenate([2 * node[inside], 2 * node[outside] + 1, 2 * node[crossing] + 1]),
            np.concatenate([home[inside], home[outside], np.zeros(int(crossing.sum()), bool)]),
        )
    return row, node, home


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = parent[of]
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Smallest position linked to each position (members and visitors), by a vantage-point tree over the members."""
    parent = np.arange(len(fps))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        members, visitors = todo.pop()
        if not len(members):
            continue
        if len(members) > LEAF_ROWS:
            point = fps[members[len(members) // 2]]
            far, seen = _distance(fps[members], point).astype(np.int64), _distance(fps[visitors], point).astype(np.int64)
            mu = int(np.median(far))
            inner = far <= mu
            if not inner.all():
                todo.append((members[inner], visitors[seen - radius <= mu]))
                todo.append((members[~inner], np.concatenate([visitors[seen + radius > mu], members[inner & (far + radius > mu)]])))
                continue
            if mu > far.min():  # more than half lie on the rim: part them from the rest
                inner = far < mu
                todo.append((members[inner], visitors[seen - radius <= mu - 1]))
                todo.append((members[~inner], np.concatenate([visitors[seen + radius > mu - 1], members[inner & (far + radius > mu - 1)]])))
                continue
        for k in range(0, len(members), LEAF_ROWS):  # one step unless every member is equally far
            block = members[k : k + LEAF_ROWS]
            for other in (members, visitors):
                for j in range(0, len(other), 8192):
                    part = other[j : j + 8192]
                    x, y = np.nonzero(_distance(fps[block][:, None], fps[part][None, :]) <= radius)
                    _unite(parent, block[x], part[y])
    return _roots(parent, np.arange(len(fps)))


def links(distinct: DataFrame, n: int, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that keep every connection at ``radius`` or fewer bits.

    The tree above the shards comes from a sample of at most ``SAMPLE_ROWS`` fingerprints; every fingerprint is routed through
    it. Inside a shard links are found exactly and handed on as one edge per fingerprint to the smallest one linked to it
    there, so a dense group of near copies makes rows in proportion to its members, not its pairs.
    """
    depth = 0
    while n > shard_rows << depth and (2 << depth) * SAMPLE_PER_LEAF <= SAMPLE_ROWS:
        depth += 1
    sample = np.zeros(0, np.uint64)
    if depth:
        rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_LEAF << depth).select("fp").collect()
        sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    points, radii = plan_tree(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, node, home = route(fps, points, radii, depth, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def find(shard: pa.Table) -> pa.Table:
        fps, home = shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((home, fps.view(np.int64)))
        fps, home = fps[order], home[order]
        root = shard_links(fps, home, radius)
        kept = root != np.arange(len(fps))
        return pa.table({"a": fps[kept].view(np.int64), "b": fps[root[kept]].view(np.int64)})

    return distinct.select("fp").mapInArrow(lean(deal), "shard long, fp long, home boolean").groupBy("shard").applyInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``, the smallest doc_id reachable over links of ``radius`` bits.

    Texts without words have fingerprint zero and are linked like any other. Rows that repeat a doc_id are kept; a null doc_id
    keeps its row and never names a component unless nothing else is in it. An empty table gives no rows.
    """
    rows = store(fingerprints(docs, id_col, text_col, width))
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, distinct.count(), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
