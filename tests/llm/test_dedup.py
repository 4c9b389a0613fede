"""SimHash, line chunks, and sentence spans against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spendweave.llm import lines, simhash, spans
from spendweave.llm.common import components

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def slow_fingerprint(text):
    words = words_of(text)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(documents):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "ÉTÉ", "ÀB", "Z Z"]
    texts = [None, "", " \t\n", "One", "one two", "A b C", "a B c"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("\n".join(near))
    texts.append("x " * 30_000)
    rows = list(enumerate(texts))
    fps = {i: slow_fingerprint(t) for i, t in rows}
    expected = slow_components(fps)
    got = simhash.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == {i: (fps[i], expected[i]) for i in fps}
    assert len({c for c in expected.values()}) < len(rows)


def test_trees_over_many_shards_lose_no_link(llm):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [c ^ np.uint64(1 << int(b)) for c in centres[:150] for b in rng.integers(0, 63, 6)]
    dense = [centres[0] ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(30) for b in range(a)]  # one ball of near copies
    fps = np.unique(np.concatenate([centres, np.array(flips, np.uint64), np.array(dense, np.uint64)]))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            break
        label = new
    table = llm.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows in (64, 10_000):
        edges = simhash.links(table, len(fps), 2, rows)
        roots = {r.node: r.root for r in components(edges).collect()}
        groups = {}
        for k, fp in enumerate(fps.view(np.int64).tolist()):
            groups.setdefault(label[k], set()).add(roots.get(fp, fp))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)
        assert edges.count() <= 40 * len(fps)


def test_each_pair_meets_in_one_shard_only():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(5)])
    points, radii = simhash.plan_tree(fps, 4)
    row, shard, home = simhash.route(fps, points, radii, 4, 2)
    assert np.bincount(row[home], minlength=1000).tolist() == [1] * 1000
    at = {r: set(shard[row == r].tolist()) for r in range(1000)}
    own = dict(zip(row[home].tolist(), shard[home].tolist()))
    assert all((own[k] in at[k + 500]) + (own[k + 500] in at[k]) >= 1 for k in range(500))


def test_components_of_chains_stars_and_loops(llm):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    got = {r.node: r.root for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in range(1001, 1400)} | {2001: 2000, 2002: 2000}


def test_empty_tables_and_repeated_rows(documents):
    empty = documents([])
    assert simhash.near_duplicates(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert spans.dedup_spans(empty).count() == 0
    twice = documents([(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b\nc d")])
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(-1, 1), (1, 1), (1, 1)]
    assert lines.dedup_lines(twice).count() == 3 and spans.dedup_spans(twice).count() == 3


def slow_lines(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        held = (text or "").split("\n")
        gone = set()
        for first, n in lines.chunk_bounds(held):
            chunk = "\n".join(held[first : first + n])
            if chunk.strip(SPACE):
                if chunk in seen:
                    gone |= set(range(first, first + n))
                seen.setdefault(chunk, doc)
        out[doc] = (len(gone), None if text is None else "\n".join(x for k, x in enumerate(held) if k not in gone))
    return out


def test_lines_match_brute_force(documents):
    rng = random.Random(2)
    passage = [f"shared line {k}" for k in range(30)]
    rows = [(0, None), (1, ""), (2, "one line"), (3, "\n\n\n"), (4, "\n\n\n"), (5, "same\nsame"), (6, "same\nsame")]
    for k in range(7, 60):
        body = [f"own {k} {j}" for j in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        rows.append((k, "\n".join(body)))
    rows.append((60, "\n".join(f"long {k % 500}" for k in range(20_000))))
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(documents(rows)).collect()}
    assert got == slow_lines(rows)
    assert sum(v[0] for v in got.values()) > 300


def test_chunks_withstand_shifts_and_have_two_lines_or_more():
    body = [f"line {k}" for k in range(400)]
    shifted = ["new", *body[:200], "x", *body[200:]]
    as_text = lambda ls: {"\n".join(ls[a : a + n]) for a, n in lines.chunk_bounds(ls)}
    assert len(as_text(body) & as_text(shifted)) >= len(as_text(body)) - 4
    assert all(n >= 2 for _, n in lines.chunk_bounds(body))
    assert sum(n for _, n in lines.chunk_bounds(body)) == 400


def slow_spans(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        pieces, numbers, keys, sizes = spans.sentences(text or "")
        gone = set()
        for a in range(len(sizes)):
            b = next((b for b in range(a + 1, len(sizes)) if sum(sizes[a : b + 1]) >= 8), None)
            if b is not None:
                key = tuple(keys[a : b + 1])
                if key in seen:
                    gone |= {numbers[k] for k in range(a, b + 1)} | set()
                seen.add(key)
        out[doc] = (len(gone), None if text is None else "".join(p for k, p in enumerate(pieces) if k not in gone))
    return out


def test_spans_match_brute_force(documents):
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "?", "...", ". "])
    passage = " ".join(sentence() for _ in range(9))
    rows = [(0, None), (1, ""), (2, "..."), (3, "One two three four five six seven eight."), (4, "One two three four five six seven eight.")]
    for k in range(5, 50):
        body = [sentence() for _ in range(rng.randint(1, 20))]
        if k % 3 == 0:
            body.insert(rng.randint(0, len(body)), rng.choice(["", "\n"]) + passage)
        rows.append((k, " ".join(body)))
    rows.append((50, "a b c d e. f g h i j. " * 3000))
    got = {r.doc_id: (r.n_removed, r.text) for r in spans.dedup_spans(documents(rows)).collect()}
    assert got == slow_spans(rows)
    assert got[6][0] == 0 and got[9][0] >= 7 and got[50][0] > 5000


def test_extra_columns_stay(documents):
    table = documents([(1, "a b\nc d\ne f. g h i j k l. m"), (2, "a b\nc d\ne f. g h i j k l. m")]).withColumns({"first": F.lit(1), "key": F.lit("k"), "shard": F.lit(0)})
    for out in (lines.dedup_lines(table), spans.dedup_spans(table)):
        assert out.columns == [*table.columns, "n_removed"]
        assert {(r.doc_id, r.lang, r.n, r.first, r.key) for r in out.collect()} == {(1, None, "mine", 1, "k"), (2, None, "mine", 1, "k")}
