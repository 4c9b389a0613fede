"""The near-copy stage against brute force on shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from spendweave.llm import shingles, simhash


def shingles_of(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def slow_kept(rows):
    sets = [shingles_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(i for (i, _), h in zip(rows, group) if h == g) for g in group}
    return sorted(i for (i, _), g in zip(rows, group) if i == least[g])


def test_stage_keeps_one_of_texts_that_share_four_fifths(llm, documents, tmp_path):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = [None, "", "One", "one", "one two", "a b c d e f"]
    for k in range(40):
        base = [word() for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(k % 4):
            near = list(base)
            for at in rng.sample(range(len(near)), rng.randint(1, max(1, len(near) // 30))):
                near[at] = word()
            texts.append("\n".join(near))
    rows = list(enumerate(texts))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(llm, documents(rows), str(tmp_path)).collect())
    assert kept == slow_kept(rows)
    assert len(kept) < len(rows) - 15


def test_rows_of_one_id_are_told_apart(llm, documents, tmp_path):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (2, text + " end"), (2, "something else that nobody has"), (None, text), (None, text)]
    kept = corpus_pipeline.near_copies(llm, documents(rows), str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, text), (-1, text), (1, text), (2, "something else that nobody has")])


def test_pairs_among_form_letters(documents):
    """Pairs of similarity over 0.8 in a family whose other letters are just below it: whole bands of them meet."""
    rng = random.Random(12)
    form = [f"form{k}" for k in range(220)]
    rows = []
    for k in range(60):
        own = [f"own{k}x{j}" for j in range(28)]
        first = [*form, *own]
        second = list(first)
        second[60 + rng.randrange(60)] = f"change{k}"
        second[200] = f"other{k}"
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[2 * k], sets[2 * k + 1]) >= 0.8 for k in range(60))
    assert max(like(sets[0], sets[2 * k]) for k in range(1, 60)) < 0.8
    gone = {r.doc_id for r in shingles.near_copies(documents(rows)).collect()}
    assert len(gone & {2 * k + 1 for k in range(60)}) >= 60 and not gone & {2 * k for k in range(60)}


def test_links_across_blocks_and_chunks(documents, monkeypatch):
    """With tiny blocks and chunks: what joins groups inside bands is what brute force over all pairs of a band joins."""
    rng = random.Random(21)
    base = [f"base{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            own[at] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, t) for k, (_, t) in enumerate(rows[:5])]
    rng.shuffle(rows)
    monkeypatch.setattr(shingles, "PICKED", 2)
    monkeypatch.setattr(shingles, "BLOCK", 3000)
    monkeypatch.setattr(shingles, "CHUNK", 7)
    gone = {r.doc_id for r in shingles.near_copies(documents(rows)).collect()}
    ordered = sorted(rows)
    assert {i for i, _ in rows} - gone == set(slow_kept(ordered))
    assert 5 < len(gone) < 64


def test_the_tree_search_finds_near_copies_by_itself(documents, monkeypatch):
    """Without bands: of texts of one base and one changed word, those go whose fingerprints a chain of close and alike texts joins."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = [f"base{k}x{j}" for j in range(300)]
        other = list(base)
        other[rng.randrange(300)] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    fps = [simhash.folded(s) for s in shingles.sets(pa.array([t for _, t in rows]))]
    near = {2 * k + 1 for k in range(40) if (fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= shingles.RADIUS}
    assert len(near) > 10
    monkeypatch.setattr(shingles, "bands", lambda found: np.zeros(0, np.int64))
    assert {r.doc_id for r in shingles.near_copies(documents(rows)).collect()} == near
