"""Near copies by Jaccard similarity of word shingles: candidates from SimHash trees and, for what lies outside their balls, MinHash bands; links checked on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.llm import simhash
from spendweave.llm.common import coded_words, components, filter_bits, lean, store
from spendweave.llm.spans import FILTER_BITS, _filter
from spendweave.session import cut, spread_join

#: Words of a shingle, and the similarity from which two texts are near copies, as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Bits by which fingerprints of the sets may differ in the tree search.
RADIUS = 3
#: Bands of so many minima each: a pair of similarity s shares a band with 1 - (1 - s**MINIMA)**BANDS, 0.9996 at 0.8.
BANDS, MINIMA = 20, 5
#: Members of a band compared with all others in the first round, and how many times more in each later one.
PICKED = 16
#: Bytes of the sets that members are compared with at once, and members of a band in a task.
BLOCK, CHUNK = 1 << 20, 4096

_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 2**64, (BANDS * MINIMA, 1), dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, (BANDS * MINIMA, 1), dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: of all its words if they are fewer than ``width``, none without words."""
    offsets, codes, words = coded_words(texts, lower=True)
    known = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    flat = known[codes] if len(known) else np.zeros(0, np.uint64)
    for a, b in zip(offsets, offsets[1:]):
        own = min(width, b - a)
        rolled = np.zeros(max(b - a - own + 1, 0) if own else 0, np.uint64)
        for k in range(own):
            rolled = rolled * _STEP + flat[a + k : b - own + k + 1]
        yield np.unique(_mixed(rolled + np.uint64(own)))


def bands(found: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of ``MINIMA`` minima of a set, as signed longs; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 2048):
        least = np.minimum(least, ((found[None, k : k + 2048] ^ _FLIP) * _TIMES).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, MINIMA).T:
        key = _mixed(key * _STEP + part)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST`` or more."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, row, node, fp, bands`` of each row; texts with equal shingles have one node and fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for found in sets(batch.column(3)):
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                fps.append(simhash.folded(found))
                keys.append(bands(found))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            columns = [*batch.columns[:3], *hashes, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "row", "node", "fp", "bands"])

    return docs.mapInArrow(lean(scan), "doc_id long, text_hash long, row long, node long, fp long, bands array<long>")


def _picked(docs: DataFrame, passing: Broadcast, filtered: int) -> DataFrame:
    """``row, found`` of the rows in the filter, ``found`` their shingle sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for batch in batches:
            slot = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - filtered)
            some = batch.filter(pa.array(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1))
            found = [x.tobytes() for x in sets(some.column(3))]
            yield pa.RecordBatch.from_arrays([some.column(2), pa.array(found, pa.binary())], names=["row", "found"])

    return docs.mapInArrow(lean(scan), "row long, found binary")


def _checked(pairs: DataFrame) -> DataFrame:
    """``a, b, alike`` of ``a, b, left, right``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            told = [alike(read(x), read(y)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(told, pa.bool_())], names=["a", "b", "alike"])

    return pairs.select("a", "b", "left", "right").mapInArrow(lean(scan), "a long, b long, alike boolean")


def _met(members: DataFrame, picks: DataFrame) -> DataFrame:
    """``key, node, row, to``: each member of a band beside the picked ones; a band of very many members is spread in the join."""
    return store(spread_join(members, picks.groupBy("key").agg(F.collect_list("to").alias("_to")), "key", spread_by="node").withColumn("to", F.explode("_to")).where("node <> to.node").select("key", "node", "row", "to"))


def _close(whole: DataFrame) -> DataFrame:
    """``node, row, to``: nodes whose fingerprints the tree search links, or that have one fingerprint, beside the smallest such node."""
    firsts, seen = cut(whole.groupBy("fp").agg(F.min(F.struct("node", "row")).alias("to")), n=F.count(F.lit(1)))
    equal = spread_join(whole.select("node", "row", "fp"), firsts, "fp", spread_by="node").where("node <> to.node").select("node", "row", "to")
    links = store(simhash.links(firsts, seen["n"], RADIUS))
    near = links.join(firsts.select(F.col("fp").alias("a"), F.col("to").alias("_own")), "a")
    near = spread_join(near, firsts.withColumnRenamed("fp", "b"), "b", spread_by="a")  # a dense group hangs on one fingerprint
    return store(equal.unionByName(near.select("_own.node", "_own.row", "to")))


def _edges(met: DataFrame) -> DataFrame:
    """The pairs to check, each once: ``a, b, row, to_row``."""
    place = F.struct("node", "row")
    low, high = F.least(place, "to"), F.greatest(place, "to")
    pairs = met.select(low.alias("x"), high.alias("y")).distinct()
    return store(pairs.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.row").alias("row"), F.col("x.row").alias("to_row")))


def _told(edges: DataFrame, found: DataFrame) -> DataFrame:
    pairs = edges.join(found.withColumnRenamed("found", "left"), "row").join(found.select(F.col("row").alias("to_row"), F.col("found").alias("right")), "to_row")
    return store(_checked(pairs))


def _sets_of(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``row, found`` for ``rows(row)`` and some more, from one pass over the texts."""
    heads, seen = cut(rows.select(F.col("row").alias("head")), n=F.count(F.lit(1)))
    filtered = filter_bits(seen["n"], FILTER_BITS)
    passing = narrow.sparkSession.sparkContext.broadcast(_filter(heads, filtered))
    return store(_picked(narrow, passing, filtered).dropDuplicates(["row"]))


def _crossing(rows: DataFrame) -> DataFrame:
    """Pairs of roots ``a, b`` with a near link: ``rows(key, block, chunk, kind, root, found)``, a group's picks (kind 0) before its members.

    The picks of a group make one sorted list of hashes, and each member's hashes are looked up in it together, so what two sets
    have in common is counted for all picks at once. Pairs of one root aren't looked at, and a pair of roots leaves a batch once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, picks, roots, listed = None, [], [], None
        for batch in batches:
            out: set[tuple[int, int]] = set()
            places = zip(*(c.to_pylist() for c in batch.columns[:5]))
            for (key, block, chunk, kind, root), raw in zip(places, batch.column(5)):
                if (key, block, chunk) != group:
                    group, picks, roots, listed = (key, block, chunk), [], [], None
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    picks.append(own)
                    roots.append(root)
                    continue
                if listed is None:
                    sizes, heads = np.array([len(x) for x in picks]), np.array(roots, np.int64)
                    flat = np.concatenate(picks)
                    order = np.argsort(flat, kind="stable")
                    listed, owner = flat[order], np.repeat(np.arange(len(picks)), sizes)[order]
                other = heads != root
                if not other.any():
                    continue
                low, high = np.searchsorted(listed, own, "left"), np.searchsorted(listed, own, "right")
                n = high - low
                at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(picks))
                near = other & (both * LEAST[1] >= (sizes + len(own) - both) * LEAST[0])
                out.update((root, x) for x in heads[near].tolist())
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    at = ["key", "block", "chunk"]
    placed = rows.select(*at, "kind", "root", "found").repartition(*at).sortWithinPartitions(*at, "kind")
    return placed.mapInArrow(lean(scan), "a long, b long").distinct()


def _blocks(members: DataFrame, picks: DataFrame, found: DataFrame) -> DataFrame:
    """What :func:`_crossing` takes: a band's picks in blocks of ``BLOCK`` bytes, its members in chunks of about ``CHUNK`` rows, each block beside each chunk."""
    weight = F.length("found") + 1024
    sized = picks.join(found.select("row", weight.alias("weight")), "row")
    before = F.sum("weight").over(Window.partitionBy("key").orderBy("turn")) - F.col("weight")
    placed = store(sized.select("key", "row", "root", "n", F.floor(before / BLOCK).cast("int").alias("block")))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    left = placed.select("key", "block", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("kind"), "root", "row")
    numbers = placed.groupBy("key").agg(F.collect_set("block").alias("numbers"))
    right = spread_join(members, numbers, "key", spread_by="node")
    right = right.select("key", F.explode("numbers").alias("block"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), F.lit(1).alias("kind"), "root", "row")
    return left.unionByName(right).join(found, "row")


def _moved(rows: DataFrame, merged: DataFrame | None) -> DataFrame:
    """``rows`` with each ``root`` replaced by the one that it is merged into."""
    if merged is None:
        return rows
    into = merged.select(F.col("node").alias("root"), F.col("root").alias("_into"))
    return rows.join(into, "root", "left").withColumn("root", F.coalesce("_into", "root")).drop("_into")


def _merged(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """``node, root`` of the roots that links inside the bands ``members(key, node, row, root)`` join to smaller ones."""
    members, seen = cut(members, n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    found = store(found.join(members.select("row").distinct(), "row", "left_semi"))
    merged = pairs = done = None
    picked = PICKED
    while True:
        now = _moved(members, merged)
        tops = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("of")).groupBy("key").agg(
            F.max_by("root", F.struct("of", "root")).alias("top"), F.sum("of").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        now = store(spread_join(now, tops.drop("roots"), "key", spread_by="node"))
        still = now.where("root <> top")
        still = still if done is None else still.join(done, ["key", "node"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node"))
        picks, seen = cut(still.withColumn("turn", turn).where(F.col("turn") <= picked).select("key", "node", "row", "root", "n", "turn"), n=F.count(F.lit(1)))
        if not seen["n"]:
            return merged
        links, seen = cut(_crossing(_blocks(now, picks, found)), n=F.count(F.lit(1)))
        if seen["n"]:
            pairs = links if pairs is None else pairs.union(links)
            merged = components(pairs)
        done = picks.select("key", "node") if done is None else done.union(picks.select("key", "node"))
        picked *= PICKED


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows to remove: ``doc_id, text_hash`` (``xxhash64`` of the text) of all near copies but those with the smallest id.

    Near copies are texts that a chain of links joins, each of a Jaccard similarity of ``LEAST`` or more. Texts without words
    are copies of each other. Equal sets are one node. Sets whose SimHash fingerprints differ in at most ``RADIUS`` bits are found by
    :func:`simhash.links` and compared. Texts at ``LEAST`` differ in some ten bits, where no ball of a tree is left out any more, so
    what is farther apart than ``RADIUS`` is found by its bands. First each member of a band is compared with the smallest node there, so
    a large group makes rows in proportion to its members. What these links join is put together, over all bands. In a band whose
    members are then of several groups, those outside its largest group are compared with all members of other groups, some first, as
    their links may join the rest. So no two groups stay apart that have a link in a band. Such comparisons count what a block
    of sets has in common with each member; only links between groups leave them. The sets are
    gathered once, for all bands with two members or more, so the texts are shingled twice in all. Rows are told apart by id and text; ids mustn't be null.
    """
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), hashed.alias("text_hash"), F.xxhash64(F.col(id_col).cast("long"), hashed).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = store(_scanned(narrow))
    whole = rows.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min(F.struct("row", "bands"))["bands"].alias("bands"))
    close = _close(store(whole.select("node", "row", "fp")))
    members = store(whole.select("node", "row", F.explode("bands").alias("key")))
    place = F.struct("node", "row")
    met = _met(members, members.groupBy("key").agg(F.min_by(place, "node").alias("to")))
    edges = _edges(met.select("node", "row", "to").unionByName(close))
    rooted = rows.select("doc_id", "text_hash", "node", F.col("node").alias("root"))
    if not edges.isEmpty():
        found = _sets_of(edges.select("row").union(edges.select("to_row")).distinct(), narrow)  # all members of bands with two or more
        told = _told(edges, found)
        near = components(told.where("alike").select("a", "b"))
        pair = [F.greatest("node", "to.node").alias("a"), F.least("node", "to.node").alias("b")]
        keys = met.select("key", *pair).join(told.where("not alike").select("a", "b"), ["a", "b"]).select("key").distinct()
        merged = _merged(members.join(keys, "key", "left_semi").join(near, "node", "left").select("key", "node", "row", F.coalesce("root", "node").alias("root")), found)
        rooted = _moved(rooted.drop("root").join(near, "node", "left").withColumn("root", F.coalesce("root", "node")), merged)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return rooted.join(least, "root").where("doc_id > least").select("doc_id", "text_hash").distinct()
