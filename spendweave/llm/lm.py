"""Language-model scores by deleted interpolation of word bigrams, words, and a uniform share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import coded_words, lean, lean_group, store
from spendweave.session import cut

#: Bytes of text that are coded together; what is asked for once per block is asked for once for all its documents.
BLOCK_BYTES = 6 << 20
#: Keys that a counting shard should hold.
SHARD_KEYS = 1 << 20
#: Buckets of context frequency: never seen, then by doubling.
BUCKETS = 16
#: Steps to an octave in the table of count ratios that the weights are learned on, and rounds of learning.
FINE, ROUNDS, LEAST = 8, 40, 1e-4
#: The end of a text as a token: no word is a space.
END = " "


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """The coded texts of one block, and the distinct words and pairs that its counts are asked for."""

    def __init__(self, words: list[bytes], tokens: np.ndarray, sizes: np.ndarray, part: np.ndarray):
        self.words, self.tokens, self.sizes, self.part = words, tokens, sizes, part
        self.token_part = np.repeat(part, sizes)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = len(words) - 1  # a text begins after an end
        self.before = before
        pairs, self.pair_of = np.unique(before * len(words) + tokens, return_inverse=True)
        self.pair_keys = _mixed(self.hashes[pairs // len(words)], self.hashes[pairs % len(words)])

    def counts(self, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each is in the main and the held part of the training texts."""
        return tuple(np.bincount(index[self.token_part == p], minlength=n).astype(np.uint32) for p in (0, 1))


#: Parts: 0 main and 1 held are learned from, 2 is not.
CODED = "block string, words binary, tokens binary, sizes binary, docs binary, null_docs binary, part binary, n_words long, n_pairs long"


def code(docs: DataFrame) -> DataFrame:
    """Blocks of coded texts from ``doc_id, part, text``."""

    def block(held: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
        offsets, codes, words = coded_words(texts, lower=True)
        n = len(words)
        tokens = np.insert(codes, offsets[1:], n)
        docs, part = table.column("doc_id"), table.column("part").to_numpy().astype(np.uint8)
        row = Block([*words.cast(pa.large_binary()).to_pylist(), END.encode()], tokens, np.diff(offsets) + 1, part)
        values = [
            name, _pack_words(row.words), _pack(tokens.astype(np.uint32)), _pack(row.sizes.astype(np.uint32)), _pack(pc.fill_null(docs, 0).to_numpy().astype(np.int64)),
            _pack(pc.is_null(docs).to_numpy().astype(np.uint8)), _pack(part), n + 1, len(row.pair_keys),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "words", "tokens", "sizes", "docs", "null_docs", "part", "n_words", "n_pairs"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield block(held, f"{task}-{made}")
                held, size, made = [], 0, made + 1
        if held and sum(b.num_rows for b in held):
            yield block(held, f"{task}-{made}")

    return docs.mapInArrow(lean(scan), CODED)


def _open(row: dict) -> Block:
    return Block(_unpack_words(row["words"]), _unpack(row["tokens"], np.uint32).astype(np.int64), _unpack(row["sizes"], np.uint32).astype(np.int64), _unpack(row["part"], np.uint8))


def _dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys, the shards that have any, and where each begins in that order."""
    order = np.argsort(keys, kind="stable")
    shard = (keys[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    shards, starts = np.unique(shard, return_index=True)
    return order, shards, np.append(starts, len(keys))


def ask(blocks: DataFrame, bits: int) -> DataFrame:
    """What each block asks each counting shard: its distinct words and pairs there, with its own counts of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _open(row)
                for kind, keys, counted in ((0, own.hashes, own.counts(own.tokens, len(own.words))), (1, own.pair_keys, own.counts(own.pair_of, len(own.pair_keys)))):
                    order, shards, starts = _dealt(keys, bits)
                    out: list[list] = [[], [], [], [], [], []]
                    for shard, a, b in zip(shards.tolist(), starts, starts[1:]):
                        at = order[a:b]
                        if kind:
                            body = _pack(np.diff(keys[at], prepend=np.uint64(0)))
                        else:
                            body = _pack_words([own.words[k] for k in at])
                        for column, value in zip(out, (shard, kind, row["block"], body, _pack(counted[0][at]), _pack(counted[1][at]))):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["shard", "kind", "block", "keys", "main", "held"])

    return blocks.select("block", "words", "tokens", "sizes", "part").mapInArrow(lean(scan), "shard long, kind long, block string, keys binary, main binary, held binary")


ANSWER = "block string, shard long, kind long, main binary, held binary, n_main long, n_held long, v_main long, v long"


def answer(asked: DataFrame) -> DataFrame:
    """The corpus's counts of what was asked, block by block; in a row without a block, a shard's tokens and distinct words."""

    def count(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        kind = rows[0]["kind"]
        if kind:
            lists = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
            _, index = np.unique(np.concatenate(lists), return_inverse=True)
            sizes = [len(x) for x in lists]
        else:
            lists = [pa.array(_unpack_words(r["keys"]), pa.large_binary()) for r in rows]
            index = pa.concat_arrays(lists).dictionary_encode().indices.to_numpy().astype(np.int64)
            sizes = [len(x) for x in lists]
        sums = [np.bincount(index, np.concatenate([_unpack(r[c], np.uint32) for r in rows])).astype(np.int64) for c in ("main", "held")]
        out, at = [], 0
        for row, size in zip(rows, sizes):
            own = index[at : at + size]
            at += size
            out.append((row["block"], row["shard"], kind, _pack(sums[0][own].astype(np.uint64)), _pack(sums[1][own].astype(np.uint64)), 0, 0, 0, 0))
        if not kind:
            out.append((None, rows[0]["shard"], kind, b"", b"", int(sums[0].sum()), int(sums[1].sum()), int((sums[0] > 0).sum()), int((sums[0] + sums[1] > 0).sum())))
        names = ["block", "shard", "kind", "main", "held", "n_main", "n_held", "v_main", "v"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return pa.table([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)

    return asked.groupBy("shard", "kind").applyInArrow(count, ANSWER)


COUNTED = "block string, docs binary, null_docs binary, sizes binary, part binary, known binary, base binary, seen binary, at binary, bins binary, bin_counts binary"


def _octave(ratio: np.ndarray) -> np.ndarray:
    return np.round(np.log2(np.maximum(ratio, 2.0**-120)) * FINE).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: zero, then 1, 2-3, 4-7 and so on."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def gather(blocks: DataFrame, answers: DataFrame, bits: int, stats: dict) -> DataFrame:
    """Per block: base scores of its texts, the counts behind each token, and the table of held-out tokens by count ratios."""
    n_all, n_main, v, v_main = stats["n_main"] + stats["n_held"], stats["n_main"], stats["v"], stats["v_main"]

    def merge(_, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table([pa.array([], pa.string()), *[pa.array([], pa.binary())] * 10], names=[c.split()[0] for c in COUNTED.split(", ")])
        row, own = rows[0], _open(rows[0])
        total: list[np.ndarray] = []
        main: list[np.ndarray] = []
        for kind, keys in ((0, own.hashes), (1, own.pair_keys)):
            order, shards, _ = _dealt(keys, bits)
            told = right.filter(pc.equal(right["kind"], kind)).sort_by("shard").select(["main", "held"]).to_pylist()
            sums = [np.concatenate([_unpack(r[c], np.uint64) for r in told]).astype(np.int64) for c in ("main", "held")]
            counts = np.empty((2, len(keys)), np.int64)
            counts[0, order], counts[1, order] = sums
            main.append(counts[0])
            total.append(counts.sum(axis=0))
        word, pair = total[0][own.tokens], total[1][own.pair_of]
        context = total[0][own.before]
        starts = np.cumsum(own.sizes) - own.sizes
        base = np.add.reduceat(np.log10((word + 0.5) / (n_all + 0.5 * (v + 1))), starts)
        known = np.add.reduceat((word > 0).astype(np.int64), starts)
        triples, at = _triples(pair, context, word)
        taken = own.token_part == 1
        ctx, wrd, two = main[0][own.before[taken]], main[0][own.tokens[taken]], main[1][own.pair_of[taken]]
        low = 1.0 / (v_main + 1)
        uni = wrd / max(n_main, 1)
        bins = np.stack([bucket_of(ctx), np.where(two > 0, _octave(two / np.maximum(ctx, 1) / low), -9999), np.where(wrd > 0, _octave(uni / low), -9999)], axis=1)
        found, many = np.unique(bins, axis=0, return_counts=True)
        values = [
            row["block"], row["docs"], row["null_docs"], row["sizes"], row["part"], _pack(known), _pack(base), _pack(triples.T.astype(np.uint64).ravel()), _pack(at.astype(np.uint32)),
            found.astype(np.int32).tobytes(), many.astype(np.int64).tobytes(),
        ]
        return pa.table([pa.array([x]) for x in values], names=[c.split()[0] for c in COUNTED.split(", ")])

    return blocks.groupBy("block").cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(lean_group(merge), COUNTED)


def _triples(pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of three count rows, numbered two rows at a time."""
    contexts, a = np.unique(context, return_inverse=True)
    words, b = np.unique(word, return_inverse=True)
    pairs, c = np.unique(pair, return_inverse=True)
    keys, at = np.unique((a * len(words) + b) * len(pairs) + c, return_inverse=True)
    return np.stack([pairs[keys % len(pairs)], contexts[keys // len(pairs) // len(words)], words[keys // len(pairs) % len(words)]]), at


def learn(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of pair, word and uniform shares per bucket of context frequency, by expectation-maximisation.

    ``table`` has bucket and the two shares' logarithms relative to the uniform share, ``counts`` how many held-out tokens.
    A bucket without held-out tokens keeps equal weights; no weight falls below ``LEAST``, but that of pairs is zero where a
    context was never seen.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for bucket in range(BUCKETS):
        own = table[:, 0] == bucket
        if own.any():
            shares = np.where(table[own][:, 1:] > -9999, np.exp2(table[own][:, 1:] / FINE), 0.0)
            shares = np.concatenate([shares, np.ones((len(shares), 1))], axis=1)
            for _ in range(ROUNDS):
                mixed = shares * weights[bucket]
                weights[bucket] = np.maximum((counts[own] @ (mixed / mixed.sum(axis=1, keepdims=True))) / counts[own].sum(), LEAST * (weights[bucket] > 0))
                weights[bucket] /= weights[bucket].sum()
    return weights


def score(counted: DataFrame, weights: np.ndarray, n_all: int, v: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, context, word = _unpack(row["seen"], np.uint64).astype(np.float64).reshape(-1, 3).T
                own = weights[bucket_of(context)]
                shares = own[:, 0] * pair / np.maximum(context, 1) + own[:, 1] * word / max(n_all, 1) + own[:, 2] / (v + 1)
                logs = np.log10(shares)[_unpack(row["at"], np.uint32)]
                sizes, part = _unpack(row["sizes"], np.uint32).astype(np.int64), _unpack(row["part"], np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_unpack(row["docs"], np.int64), mask=_unpack(row["null_docs"], np.uint8).astype(bool)), pa.array(part == 2), pa.array(sizes), pa.array(_unpack(row["known"], np.int64)),
                        pa.array(_unpack(row["base"], np.float64)), pa.array(np.add.reduceat(logs, np.cumsum(sizes) - sizes)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return counted.mapInArrow(lean(scan), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, out: int = 1, held: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Learned from rows whose crc32 of the id leaves another remainder than ``out``. Of these, the remainder ``held`` is the
    held-out part for the weights, which are learned with the other rows' counts; scores then use the counts of both. A context
    is the token before (the end, for a first word). A null text is one end; a null id is learned from. Rows that repeat an id
    count each. An empty table gives no rows.
    """
    remainder = F.crc32(F.col(id_col).cast("string")) % parts
    part = F.when(remainder == out, 2).when(remainder == held, 1).otherwise(0)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.cast("int").alias("part"), F.col(text_col).cast("string").alias("text"))
    blocks, seen = cut(code(narrow), keys=F.coalesce(F.sum(F.col("n_words") + F.col("n_pairs")), F.lit(0)))
    bits = max(0, int(seen["keys"] // SHARD_KEYS).bit_length())
    answers = store(answer(ask(blocks, bits)))
    sums = answers.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_main", "n_held", "v_main", "v")]).first().asDict()
    counted = store(gather(blocks, answers, bits, sums))
    n_all = sums["n_main"] + sums["n_held"]
    weights = learn(*_table(counted)) if n_all else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    return score(counted, weights, n_all, sums["v"]).withColumn("train_tokens", F.lit(n_all).cast("long"))


def _table(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The held-out table, summed over blocks: its rows are bounded by buckets and ratio steps."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bins = np.frombuffer(bins, np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(bins[:, k]) for k in range(3)), pa.array(np.frombuffer(counts, np.int64))], names=["b", "two", "one", "n"])

    rows = counted.select("bins", "bin_counts").mapInArrow(lean(scan), "b int, two int, one int, n long").groupBy("b", "two", "one").agg(F.sum("n").alias("n")).toArrow()
    return np.stack([rows[c].to_numpy().astype(np.int64) for c in ("b", "two", "one")], axis=1), rows["n"].to_numpy().astype(np.float64)
