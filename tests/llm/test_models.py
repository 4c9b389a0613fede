"""Language mixture, quality fences, mixing, and language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendweave.llm import langid, lm, mixing, quality

SPACE = " \t\n\x0b\x0c\r"
SYLLABLES = {"aa": ["ba", "ko", "li", "mu"], "bb": ["ster", "ung", "ich", "ö"], "cc": ["xq", "zz", "yw", "qv"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def language_rows(rng, n=90):
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(k, prose(rng, x, rng.randint(3, 80))) for k, x in enumerate(langs)], langs


def test_languages_are_told_from_the_text_alone(documents):
    rng = random.Random(1)
    rows, langs = language_rows(rng)
    rows += [(100, None), (101, ""), (102, "12 34 !!"), (103, prose(rng, "aa", 300) + " " + prose(rng, "bb", 100)), (104, prose(rng, "cc", 30_000))]
    out = {r.doc_id: r for r in langid.identify(documents(rows, [*langs, *[None] * 5])).collect()}
    assert all(out[k].lang_pred == langs[k] for k in range(90))
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(90))
    assert [(out[k].lang_pred, out[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert out[103].languages == ["aa", "bb"] and 0.6 < out[103].score < 0.9
    assert out[104].lang_pred == "cc" and all(0 <= r.score <= 1 for r in out.values())


def test_rejected_languages_go_and_columns_stay(documents):
    rng = random.Random(1)
    rows, langs = language_rows(rng)
    table = documents(rows + [(200, None), (201, "... 7")], [*langs, None, "aa"]).withColumn("lang_pred", F.lit("x"))
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, table.where("doc_id < 200").collect()))
    assert langid.keep_identified(documents([])).count() == 0 and langid.identify(documents([])).count() == 0
    bare = documents([(1, "no label"), (2, "7"), (None, "no id")])
    assert {r.doc_id for r in langid.keep_identified(bare).collect()} == {1, None}
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


def slow_words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_measures_match_brute_force(documents):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a # b\na # b\n \n \n"), (3, "x y z " * 9_000), (4, "a b c d e f g h a b c d e f g h"), (5, "é#ß $$ <|>")]
    for k in range(6, 40):
        words = [rng.choice(["a", "b", "cc", "#x", "é", "%"]) for _ in range(rng.randint(0, 120))]
        rows.append((k, "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words)))
    got = {r.doc_id: r for r in quality.judge(documents(rows)).collect()}
    for k, text in rows:
        text = text or ""
        words, lines = slow_words(text), [x for x in text.split("\n") if x.strip(SPACE)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts = Counter(windows)
        covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 8)}
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert got[k].base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (got[k].base_failed and got[k].kept)


def test_fences_follow_the_group(llm):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        source, length = ("code", 5) if k % 2 else ("news", 5)
        words = ["w" * rng.randint(length - 2, length + 2) + str(rng.randint(0, 10**6)) for _ in range(60)]
        if source == "code":
            words = [w + "#" * rng.randint(0, 2) for w in words]
        rows.append((k, "en", source, " ".join(words)))
    spam = " ".join(f"w{k}####" for k in range(60))
    rows += [(1000, "en", "news", spam), (1001, "fr", "solo", spam), (1002, None, None, " ".join(f"word{k}" for k in range(60)))]
    got = {r.doc_id: r.kept for r in quality.judge(llm.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert all(got[k] for k in range(400)) and not got[1000] and got[1002]


def test_sketches_merge_to_the_same_result(llm):
    table = llm.createDataFrame([(k, f"s{k % 3}", 60, 300 + k % 50, k % 7, 0, 0) for k in range(600)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    whole = quality.sketch(table, ["lang"])
    parts = quality.sketch(table.where("doc_id < 200"), ["lang"]).unionByName(quality.sketch(table.where("doc_id >= 200"), ["lang"]))
    assert sorted(map(tuple, quality.merge(parts, ["lang"]).collect())) == sorted(map(tuple, whole.collect()))
    low = {r.bucket for r in whole.where("measure = 'length'").collect()}
    assert all(any(b <= v < b + max(1, b / 32) + 1 for b in low) for v in range(500, 583, 10))


def labelled(rng, n=300):
    rows, labels = [], []
    for k in range(n):
        kind = ["good", "poor", "toxic"][0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))]
        if kind == "poor":
            words = [w + "%%%" for w in words]
        if kind == "toxic":
            words[3] = words[7] = "awful"
        rows.append((k, " ".join(words)))
        labels.append((k, kind))
    return rows, labels


def test_rates_meet_the_targets(llm, documents):
    rng = random.Random(6)
    rows, labels = labelled(rng)
    table = documents(rows + [(900, None), (901, "")])
    given = llm.createDataFrame(labels[:250] + [(5, "good"), (None, "good"), (7, None)], "doc_id long, domain string")
    model = mixing.fit(table, given)
    soft = mixing.posteriors(table, model)
    rated, told = mixing.solve(soft, {"good": 0.7, "poor": 0.2, "toxic": 0.1})
    assert all(abs(g - t) < 0.02 * sum(told["targets"]) for g, t in zip(told["targets"], told["totals"]))
    found = rated.collect()
    totals = np.zeros(3)
    for r in found:
        assert r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9
        totals += np.array(r.p) * r.tokens * r.rate
    assert np.allclose(totals, told["totals"], rtol=1e-6)
    out = {r.doc_id: r for r in mixing.mix(table, given, {"good": 0.7, "poor": 0.2, "toxic": 0.1}).collect()}
    assert sum(out[k].domain == d for k, d in labels[250:]) >= 45
    assert (out[900].tokens, out[901].tokens) == (0, 0)
    assert all(abs(r.copies - r.rate) < 1 for r in out.values())


def test_mixing_without_labels_or_rows(llm, documents):
    none = llm.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(documents([(1, "a b"), (1, "a b"), (None, "c")]), none, {"good": 1.0}).collect()
    assert [(r.rate, r.copies) for r in out] == [(1.0, 1)] * 3
    assert mixing.mix(documents([]), none, {"good": 1.0}).count() == 0


def slow_scores(rows):
    part = lambda i: 0 if i is None else {1: 2, 0: 1}.get(zlib.crc32(str(i).encode()) % 5, 0)
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    tokens = [[*map(lower, slow_words(t or "")), " "] for _, t in rows]
    word, pair = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for (i, _), own in zip(rows, tokens):
        if part(i) < 2:
            word[part(i)].update(own)
            pair[part(i)].update(zip([" ", *own], own))
    main_n, main_v = sum(word[0].values()), len(word[0])
    every, both = word[0] + word[1], pair[0] + pair[1]
    n, v = sum(every.values()), len(every)
    bucket = lambda c: min(c.bit_length(), lm.BUCKETS - 1)
    weights = np.full((lm.BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    held = [(a, b) for (i, _), own in zip(rows, tokens) if part(i) == 1 for a, b in zip([" ", *own], own)]
    for k in range(lm.BUCKETS):
        shares = np.array([[pair[0][a, b] / max(word[0][a], 1), word[0][b] / max(main_n, 1), 1 / (main_v + 1)] for a, b in held if bucket(word[0][a]) == k])
        for _ in range(lm.ROUNDS if len(shares) else 0):
            mixed = shares * weights[k]
            weights[k] = np.maximum((mixed / mixed.sum(axis=1, keepdims=True)).mean(axis=0), lm.LEAST * (weights[k] > 0))
            weights[k] /= weights[k].sum()
    out = []
    for (i, _), own in zip(rows, tokens):
        base = sum(math.log10((every[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        model = sum(math.log10(weights[bucket(every[a])] @ np.array([both[a, b] / max(every[a], 1), every[b] / max(n, 1), 1 / (v + 1)])) for a, b in zip([" ", *own], own))
        out.append((i, part(i) == 2, len(own), sum(every[w] > 0 for w in own), n, base, model))
    return out


@pytest.mark.parametrize("block", [lm.BLOCK_BYTES, 2000])
def test_scores_match_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SHARD_KEYS", lm.SHARD_KEYS if block > 2000 else 200)
    rng = random.Random(8)
    rows = [(None, "A b"), (0, None), (1, ""), (2, " \n"), (3, "Ä É a"), (4, "b " * 20_000), (4, "b c")]
    rows += [(k, " ".join(f"W{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.randint(0, 60)))) for k in range(5, 120)]
    got = sorted(map(tuple, lm.scores(documents(rows)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=lambda r: (r[0] or -1, r[2]))
    expected = sorted(slow_scores(rows), key=lambda r: (r[0] or -1, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in got], [r[5] for r in expected], rtol=1e-12)
    assert np.allclose([r[6] for r in got], [r[6] for r in expected], rtol=2e-3)  # weights are learned from ratios in steps


def test_scores_of_empty_and_untrained_tables(documents):
    assert lm.scores(documents([])).count() == 0
    out = lm.scores(documents([(k, "a b") for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 == 1])).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in out} == {(0, 0, 0.0, 0.0)}
