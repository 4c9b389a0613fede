"""Alignment of two tokenizers' tokens: groups between common ends by pointer jumping, and how often ids are linked."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import by_bytes, lean, lean_group, store
from spendweave.llm.lm import _pack, _unpack
from spendweave.llm.packing import _byte_letters

#: Bytes of text that are aligned together, bytes given to a tokenizer at once, and id pairs that are spread out at once.
BLOCK_BYTES, CALL_BYTES, PAIRS = 4 << 20, 256 << 10, 1 << 21
#: More than any id.
IDS = 1 << 17

_OPEN: dict[tuple[str, str], Encoders] = {}


class Encoders:
    """A byte-level BPE file (A) and a piece model with byte fallback (B), each with the bytes of its ids."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        size = self.a.get_vocab_size()
        spelled = [self.a.id_to_token(k) or "" for k in range(size)]
        self.a_bytes = pa.array([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in spelled], pa.large_binary())
        self.b_bytes = pa.array([self._piece(k) for k in range(self.b.get_piece_size())], pa.large_binary())
        ids = range(max(size, self.b.get_piece_size()))
        self.quick = self._merger(json.loads(self.a.to_str()), letters)
        self.told = pa.array([f"{k}{sign}".encode() for sign in ",|;" for k in ids], pa.large_binary())
        self.n_told = len(ids)

    @staticmethod
    def _merger(held: dict, letters: dict[str, int]):
        """The quicker of the installed BPE libraries for a byte-level file whose ids are its merges' ranks; else none."""
        import tiktoken
        from public_tokenizers import PATTERN

        model, parted = held["model"], held["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain = plain and held["normalizer"] is None and parted.get("type") == "ByteLevel" and not parted["add_prefix_space"] and parted["use_regex"]
        if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or sorted(model["vocab"][c] for c in letters) != list(range(256)):
            return None
        ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if k < 256 + len(merges)}
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    @classmethod
    def of(cls, first: str, second: str) -> Encoders:
        if (first, second) not in _OPEN:
            _OPEN[first, second] = cls(first, second)
        return _OPEN[first, second]

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Both tokenizers' ids of each text."""
        ours: list[np.ndarray] = []
        theirs: list[np.ndarray] = []
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= CALL_BYTES or k == len(texts) - 1:
                spaced = [" " + t for t in held]
                if self.quick is not None:
                    ours += [np.array(self.quick.encode_ordinary(t), np.int64) for t in spaced]
                else:
                    ours += [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
                theirs += [np.array(ids, np.int64) for ids in self.b.encode(held, num_threads=1)]
                held, size = [], 0
        return ours, theirs


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The ends of each id's bytes in the bytes of all."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[1 : len(ids) + 1]
    return ends, memoryview(taken.buffers()[2] or b"")


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of A and B tokens that cover the same bytes, from the ends of both; a group ends where both do.

    Every token points to the token overlapping it that reaches farthest to the right: an A token to the B token that holds its
    last byte, a B token to the A token that does, unless that ends where it ends itself; then it is the last of its component.
    Successors of successors are taken, doubling the way each time, until every token points to its component's last token.
    """
    n = len(a_ends)
    forward = np.searchsorted(a_ends, b_ends)
    own = np.arange(n, n + len(b_ends))
    after = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.where(a_ends[forward] > b_ends, forward, own) if n else own])
    while True:
        farther = after[after]
        if np.array_equal(farther, after):
            break
        after = farther
    _, label = np.unique(after, return_inverse=True)  # last tokens are B's, in the order of the text
    return label[:n], label[n:]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, index = np.unique(keys, return_inverse=True)
    return found, np.bincount(index, times, len(found)).astype(np.int64)


def _linked(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, pair, times`` of the id pairs that each document links; ``doc_of`` has the document of each group.

    Ids are counted once per group first, so a long group in which few ids repeat makes few rows, and groups are spread out in
    runs of about ``PAIRS`` rows.
    """
    groups = len(doc_of)
    left, left_times = _summed(a_group * IDS + a, np.ones(len(a)))
    right, right_times = _summed(b_group * IDS + b, np.ones(len(b)))
    left_group, right_group = left // IDS, right // IDS
    wide = np.bincount(right_group, minlength=groups)
    begins = np.cumsum(wide) - wide
    rows = wide[left_group]
    upto = np.cumsum(rows)
    out_docs, out_pairs, out_times = [], [], []
    k = 0
    while k < len(left):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
        many = rows[k:end]
        first = np.repeat(np.arange(k, end), many)
        second = np.repeat(begins[left_group[k:end]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        docs = doc_of[left_group[first]]
        pairs = (left[first] % IDS) * IDS + right[second] % IDS
        found, times = _summed((docs - docs[0]) * (IDS * IDS) + pairs, left_times[first] * right_times[second])
        out_docs.append(found // (IDS * IDS) + docs[0])
        out_pairs.append(found % (IDS * IDS))
        out_times.append(times)
        k = end
    if not out_docs:
        return (np.zeros(0, np.int64),) * 3
    docs, pairs, times = (np.concatenate(x) for x in (out_docs, out_pairs, out_times))
    order = np.lexsort((pairs, docs))  # a document may lie in two runs
    docs, pairs, times = docs[order], pairs[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])]))
    return docs[new], pairs[new], np.add.reduceat(times, new)


BLOCK = "block long, docs binary, null_docs binary, tallies binary, digests binary, sizes binary, keys binary, index binary, times binary, counts binary"


class Aligned:
    """What is told of a block's texts."""

    def __init__(self, coder: Encoders, texts: list[str | None]):
        n = len(texts)
        some = np.array([k for k, t in enumerate(texts) if t], np.int64)
        ours, theirs = coder.encode([texts[k] for k in some])
        good = []
        for j, k in enumerate(some):
            expected = b" " + texts[k].encode("utf-8", "surrogatepass")
            if all(bytes(_joined(table, ids)[1]) == expected for table, ids in ((coder.a_bytes, ours[j]), (coder.b_bytes, theirs[j]))):
                good.append(j)
        docs = some[good] if good else np.zeros(0, np.int64)
        ours, theirs = [ours[j] for j in good], [theirs[j] for j in good]
        empty = np.zeros(0, np.int64)
        a, b = (np.concatenate(x) if x else empty for x in (ours, theirs))
        a_group, b_group = groups_of(_joined(coder.a_bytes, a)[0], _joined(coder.b_bytes, b)[0]) if len(a) else (empty, empty)
        a_doc, b_doc = (np.repeat(docs, [len(x) for x in ids]) for ids in (ours, theirs))
        groups = int(b_group[-1]) + 1 if len(b_group) else 0
        doc_of = np.zeros(groups, np.int64)
        doc_of[b_group] = b_doc
        a_many, b_many = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        self.docs, self.pairs, self.times = _linked(a, b, a_group, b_group, doc_of)
        links = np.zeros(n, np.int64)
        np.add.at(links, doc_of, a_many * b_many)
        self.tallies = np.stack([np.bincount(a_doc, minlength=n), np.bincount(b_doc, minlength=n), np.bincount(doc_of, minlength=n), links]).astype(np.int64)
        # each token's id and the sign behind it, A tokens before B tokens within a group
        sign = lambda group, last: np.where(np.append(group[1:] != group[:-1], True), last, 0) if len(group) else empty
        told = np.empty(len(a) + len(b), np.int64)
        a_upto, b_upto = np.cumsum(a_many), np.cumsum(b_many) - b_many
        told[np.arange(len(a)) + b_upto[a_group]] = sign(a_group, 1) * coder.n_told + a
        told[np.arange(len(b)) + a_upto[b_group]] = sign(b_group, 2) * coder.n_told + b
        ends, data = _joined(coder.told, told)
        self.digests = [b""] * n
        at = begin = 0
        for k, x, y in zip(docs, ours, theirs):
            at += len(x) + len(y)
            self.digests[k] = hashlib.sha256(data[begin : ends[at - 1] - 1]).hexdigest().encode()
            begin = ends[at - 1]


def _blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = Encoders.of(first, second), TaskContext.get().partitionId()
        for made, batch in enumerate(by_bytes(batches, BLOCK_BYTES)):
            own = Aligned(coder, batch.column(1).to_pylist())
            keys, index, counts = np.unique(own.pairs, return_inverse=True, return_counts=True)
            sizes = np.bincount(own.docs, minlength=batch.num_rows)
            ids = batch.column(0)
            arrays = [
                pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8), own.tallies.ravel(), None,
                sizes.astype(np.uint32), np.diff(keys, prepend=0), index.astype(np.uint32), own.times.astype(np.uint64), counts.astype(np.uint32),
            ]
            values = [b"\n".join(own.digests) if x is None else _pack(x) if len(x) else b"" for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), *[pa.array([v], pa.binary()) for v in values]], names=[c.split()[0] for c in BLOCK.split(", ")])

    return docs.mapInArrow(lean(scan), BLOCK)


def _array(data: bytes, kind: type) -> np.ndarray:
    return _unpack(data, kind) if data else np.zeros(0, kind)


def _asked(blocks: DataFrame) -> DataFrame:
    """``block, pair, n``: in how many of its documents a block has each of its id pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pairs = np.cumsum(_array(keys, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(_array(counts, np.uint32).astype(np.int64))], names=["block", "pair", "n"])

    return blocks.select("block", "keys", "counts").mapInArrow(lean(scan), "block long, pair long, n long")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A space and the text are encoded by the byte-level BPE file ``first`` (A), the text by the piece model ``second`` (B), which
    adds the space; special tokens' strings are plain text. Places where tokens of both end cut them into groups, and within a
    group every A token is linked with every B token. An id pair's count is the number of rows that link it; ``n_best`` are a
    row's links whose count is the highest of their A id, ``count_sum`` the counts of all its links, ``groups_sha256`` the digest
    of the ids written as ``a1,a2|b1;a3|b2,b3``. Texts that are null, empty, or not given back by both tokenizers' bytes have
    zeros and ''. Rows that repeat a doc_id count each. An empty table gives no rows.

    Texts are aligned in blocks. A block asks for the counts of its distinct pairs, once for all its rows, and gets them back by
    its number; a pair has one row per block at most, so none is frequent among what is asked. Only the highest count of
    each A id is broadcast, no more rows than the vocabulary has.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = store(_blocks(narrow, first, second))
    asked = _asked(blocks)
    counts = store(asked.groupBy("pair").agg(F.sum("n").alias("n")))
    ours = F.shiftright("pair", IDS.bit_length() - 1).cast("int")
    tops = counts.groupBy(ours.alias("a")).agg(F.max("n").alias("top"))
    told = counts.withColumn("a", ours).join(F.broadcast(tops), "a").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best"))
    answers = asked.select("block", "pair").join(told, "pair")

    def merge(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in RESULT.split(", ")]
        if not left.num_rows:
            return pa.table([pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in names], names=names)
        row = left.to_pylist()[0]
        right = right.sort_by("pair")
        count, best = right["count"].to_numpy().astype(np.int64), right["best"].to_numpy().astype(np.int64)
        ids, gone = _array(row["docs"], np.int64), _array(row["null_docs"], np.uint8).astype(bool)
        sizes, index, times = _array(row["sizes"], np.uint32), _array(row["index"], np.uint32), _array(row["times"], np.uint64).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        sums = np.zeros((2, len(ids)), np.int64)
        np.add.at(sums[0], doc, times * best[index])
        np.add.at(sums[1], doc, times * count[index])
        tallies = _array(row["tallies"], np.int64).reshape(4, -1)
        texts = [x.decode() for x in row["digests"].split(b"\n")]
        return pa.table([pa.array(ids, mask=gone), *[pa.array(x) for x in (*tallies, *sums)], pa.array(texts)], names=names)

    return blocks.drop("keys", "counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_group(merge), RESULT)
