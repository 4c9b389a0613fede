"""Phrase mining against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import pytest

from spendweave.llm import phrases


def _brute(rows, least, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((lang, " ".join(p), a, l, r, n[lang], score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k + 1, *x[1:]) for k, x in enumerate(kept[:top])]
    return sorted(out)


def _rows(seed, n=150):
    rng = random.Random(seed)
    bits = ["new york city", "New York", "the cat", "the", "a\tb", "x. y", "é è", "é", "İst", "no break", "stop", "word", "red-hot", ":", ",", "\n", "\x0b", "!?", "  ", "the cat sat on the mat"]
    rows = [(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("lone " * 900, "xx"), *[("the cat sat on the mat", "en")] * 40]


@pytest.mark.parametrize("few", [False, True])
def test_against_plain_counts(llm, monkeypatch, few):
    if few:  # groups are too many to be sent: occurrences are joined with them by shuffling
        monkeypatch.setattr(phrases, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)
    rows = _rows(1)
    docs = llm.createDataFrame([(k % 7, t, x, "mine") for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, id string").repartition(5)
    out = phrases.collocations(docs, least=8, top=25).collect()
    assert sorted(map(tuple, out)) == _brute(rows, 8, 25)
    assert {r["lang"] for r in out} >= {"en", "und", "xx"}


def test_overlaps_and_covering(llm):
    rows = [("a a a a a", "q")] * 3 + [("b c d", "q")] * 9 + [("b c", "q")] * 2 + [("b c d e", "q")]
    docs = llm.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, phrases.collocations(docs, least=3, top=2).collect()))
    assert got == _brute(rows, 3, 2)
    assert got[0][2] == "b c d"


def test_nothing_to_find(llm):
    for rows in ([], [(None, None)], [("one word", "en")]):
        out = phrases.collocations(llm.createDataFrame(rows, "text string, lang string"))
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
