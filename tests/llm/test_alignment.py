"""Token alignment against a plain walk over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendweave.llm import alignment
from spendweave.llm.packing import _byte_letters
from spendweave.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
LETTERS = {c: b for b, c in _byte_letters().items()}


def _walk(texts):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    told, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            sides = []
            for ids, spell in ((a, lambda k: bytes(LETTERS[c] for c in first.id_to_token(k))), (b, lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode())):
                data, ends = b"", []
                for k in ids:
                    data += spell(k)
                    ends.append(len(data))
                sides.append((data, ends))
            if sides[0][0] == sides[1][0] == (" " + text).encode():
                cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
                place = lambda e: next(k for k, c in enumerate(cuts) if e <= c)
                groups = [([], []) for _ in cuts]
                for side, ids in enumerate((a, b)):
                    for k, e in zip(ids, sides[side][1]):
                        groups[place(e)][side].append(k)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(set(links))
        told.append((groups, links))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for groups, links in told:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "Hello world! It's fine, isn't it?", "<|endoftext|> <s> </s> <unk> [INST]", "naïve façade — “quoted” 🙂🙂 𝔘𝔫𝔦", "日本語のテキスト、長い文。", "▁odd", "a▁b",
    "tabs\tand\nlines\r\n\n\n  x", "1234567890 3.14159", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "the the the the", "\x00\x01\x7f", "ﬁ ½ Ⅳ", "é" * 200, "ab" * 3000, "Ünïcödé wörds everywhere " * 20, "the the the the",
]


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_walk(llm, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
        monkeypatch.setattr(alignment, "PAIRS", 7)
    rng = random.Random(4)
    words = "the of and naïve tokenization 中文 don't re-use 12:30 antidisestablishmentarianism straße 🙂 \n".split(" ")
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(None if k == 7 else k % 50, t, "mine") for k, t in enumerate(texts)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, block string").repartition(4)
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(r[0], *x) for r, x in zip(rows, _walk(texts))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sum(x[1] == 0 for x in expected) >= 4 and alignment.align(docs.where(F.lit(False)), A, B).count() == 0


def test_pointer_jumping_takes_few_rounds_and_finds_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), n)) for _ in range(2))
        cuts = np.intersect1d(a, b)
        ours, theirs = alignment.groups_of(a, b)
        assert (ours == np.searchsorted(cuts, a)).all() and (theirs == np.searchsorted(cuts, b)).all()
    long = np.arange(2, 200_001, 2)
    ours, theirs = alignment.groups_of(long, np.append(np.arange(1, 200_000, 2), 200_000))
    assert not ours.any() and not theirs.any()
