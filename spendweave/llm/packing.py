"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import json
import os
import unicodedata
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import by_bytes, lean

#: Context sizes, each a power of two, and the tokens of one step's group of sequences.
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
#: Bytes of text that are encoded and packed at once.
SLICE_BYTES = 2 << 20

#: Fixed values of the tokenizer file: what it does before its merges. Other files are left to the tokenizer library.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
#: The same pieces for Arrow, whose \\s is ASCII only: white space spelled out.
SPACES = "\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
MARKED = PIECES.replace("[^\\s", f"[^{SPACES}")
#: Texts with these are left to the tokenizer itself: special tokens' strings, separators that Python alone takes for space, a
#: letter whose lower case depends on its place, the mark that is put behind pieces, and characters that Arrow doesn't know.
ODD = "<\\||[\\x00\\x1c-\\x1fΣ]|[^\\pL\\pM\\pN\\pP\\pS\\pZ\\pC]"

_OPEN: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE uses for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of a tokenizer file. One whose steps are known is run by the quicker of the installed BPE libraries.

    That library merges bytes and knows no word ends. So a mark is put behind each piece, a byte and a mark are merged before
    anything else, and the file's merges follow in their order; its ranks are then turned into the file's ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merger = self._merger(json.loads(self.whole.to_str()))

    def _merger(self, held: dict) -> tuple | None:
        import tiktoken

        model, parted = held["model"], held["pre_tokenizer"] or {}
        steps = parted.get("pretokenizers", [{}])
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        known = held["normalizer"] == NORMALIZER and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and plain
        known = known and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": PIECES} and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        if not known:
            return None
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        spell = lambda t: bytes(back[c] for c in t.removesuffix(WORD_END)) + (b"\0" if t.endswith(WORD_END) else b"")
        spelled = [(bytes([b]), letters[b]) for b in range(256)] + [(bytes([b, 0]), letters[b] + WORD_END) for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        spelled += [(spell(a) + spell(b), a + b) for a, b in merges]
        ranks = {data: k for k, (data, _) in enumerate(spelled)}
        if len(ranks) != len(spelled):
            return None
        self.closing = np.array([t.endswith(WORD_END) for _, t in spelled])
        return tiktoken.Encoding("words", pat_str="[^\\x00\\s]+\\x00", mergeable_ranks=ranks, special_tokens={}), np.array([model["vocab"][t] for _, t in spelled], np.uint32)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a batch's distinct pieces are encoded once. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        given = texts.to_pylist()
        if self.merger is None:
            return [self.exact(t) for t in given]
        encoding, ids = self.merger
        odd = pc.match_substring_regex(texts, ODD).to_pylist()
        normal = pa.array(["" if o else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower() for t, o in zip(given, odd)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring_regex(normal, MARKED, "\\0\0"), "\0")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.utf8_trim_whitespace(coded.dictionary)  # white space before a piece, or at a text's end
        some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        ranks = np.array(encoding.encode_ordinary("".join(f"{w}\0" for w in words.to_pylist())), np.int64)
        ends = np.flatnonzero(self.closing[ranks]) + 1
        sizes = np.zeros(len(words), np.int64)
        sizes[some] = np.diff(ends, prepend=0)
        starts = np.cumsum(sizes) - sizes
        long = sizes[index]
        upto = np.cumsum(long)
        every = ids[ranks][np.repeat(starts[index] - (upto - long), long) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = np.concatenate([[0], upto])[lists.offsets.to_numpy()]
        return [self.exact(t) if o else every[x:y] for t, o, x, y in zip(given, odd, offsets, offsets[1:])]


class Packer:
    """Sequences of one shard. Pieces are ``(document, start, length)``; nothing else is held than what waits in a tier.

    A document's full windows of the longest tier are sequences by themselves. What is left is routed to the smallest tier that
    holds it. When enough waits in a tier, its pieces are packed into its windows, and the gap of a window is filled from the
    shorter tiers, longer pieces first, the last one cut to fit; so every window is full while a shard goes on.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, hold: int = 64):
        self.tiers, self.step_tokens, self.hold = tuple(sorted(tiers)), step_tokens, hold
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.made: list[tuple] = []
        self.sequences = 0
        self.steps: dict[int, list] = {t: [0, 0] for t in self.tiers}
        self.next_step = 0

    def add(self, doc: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self._emit(top, [(doc, start, top)])
            start += top
        if length > start:
            self._wait((doc, start, length - start))
        for tier in reversed(self.tiers):
            while self.tokens[tier] >= self.hold * tier:
                self._window(tier)

    def _wait(self, piece: tuple) -> None:
        tier = next(t for t in self.tiers if piece[2] <= t)
        self.waiting[tier].append(piece)
        self.tokens[tier] += piece[2]

    def _take(self, tier: int, room: int) -> tuple | None:
        """A piece of the tier, cut to ``room``; what is cut off goes on waiting."""
        if not self.waiting[tier]:
            return None
        doc, start, length = self.waiting[tier].popleft()
        self.tokens[tier] -= length
        if length > room:
            self._wait((doc, start + room, length - room))
            length = room
        return doc, start, length

    def _window(self, tier: int) -> None:
        room, pieces = tier, []
        for source in reversed([t for t in self.tiers if t <= tier]):
            while room and (piece := self._take(source, room)):
                pieces.append(piece)
                room -= piece[2]
        self._emit(tier, pieces)

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        step = self.steps[tier]
        if not step[1]:
            step[0], self.next_step = self.next_step, self.next_step + 1
            step[1] = max(1, self.step_tokens // tier)
        step[1] -= 1
        offset = 0
        for doc, start, length in pieces:
            self.made.append((doc, start, length, self.sequences, offset, tier, step[0]))
            offset += length
        self.sequences += 1

    def finish(self) -> None:
        """Pack what waits into windows of powers of two, the largest first, so that the end of a shard isn't padded either."""
        pool = deque(p for t in reversed(self.tiers) for p in self.waiting[t])
        rest = sum(self.tokens.values())
        self.waiting, self.tokens = {t: deque() for t in self.tiers}, dict.fromkeys(self.tiers, 0)
        while rest:
            room, pieces = min(self.tiers[-1], 1 << rest.bit_length() - 1), []
            rest -= room
            tier = next(t for t in self.tiers if room <= t)
            while room:
                doc, start, length = pool.popleft()
                taken = min(room, length)
                pieces.append((doc, start, taken))
                room -= taken
                if length > taken:
                    pool.appendleft((doc, start + taken, length - taken))
            self._emit(tier, pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group``; ids as little-endian 32-bit numbers.

    Each document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Every input partition is packed as
    a shard of its own in one pass: only pieces that wait for a window are held, a fixed number per tier. A window is
    full; those at a shard's end are smaller powers of two, so nothing is padded. A step group holds windows of one tier with ``STEP_TOKENS`` tokens
    in all (fewer at a shard's end), so steps are equally heavy. Rows that repeat a doc_id are packed each for itself.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder.of(tokenizer), Packer(tiers)
        shard = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # row number: doc_id, ids, tokens not yet placed
        row = 0

        def flush() -> pa.RecordBatch:
            out = defaultdict(list)
            for at, start, length, sequence, offset, tier, step in packer.made:
                held = waiting[at]
                for name, value in zip(names, (held[0], start, length, held[1][start : start + length].tobytes(), len(held[1]), shard + sequence, offset, tier, shard + step)):
                    out[name].append(value)
                held[2] -= length
                if not held[2]:
                    del waiting[at]
            packer.made = []
            return pa.RecordBatch.from_arrays([pa.array(out[n], pa.binary() if n == "ids" else pa.int64()) for n in names], names=names)

        for part in by_bytes(batches, SLICE_BYTES):
            for doc, ids in zip(part.column(0).to_pylist(), encoder.batch(part.column(1))):
                own = np.append(ids, np.uint32(end_id)).astype("<u4")
                waiting[row] = [doc, own, len(own)]
                packer.add(row, len(own))
                row += 1
            yield flush()
        packer.finish()
        yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(scan), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long")

