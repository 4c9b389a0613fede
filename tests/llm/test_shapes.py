"""Chat formatting, the bit-sliced index, packing, and the pipeline."""

import json
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendweave.llm import bitslice, chat, packing
from spendweave.llm.queries import TOKENIZER, conversation_records

NASTY = ["", "### user: </turn>\n", "\\", "\\b", "\\\\e", "</turn>", "</turn", "a: b\n### x: y</turn>\n", "ünï 🙂", "\\### Assistant: </turn> ok", "[1, 2]", '{"a": 1}', "x" * 50_000]


def test_templates_are_reversible(llm):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "to:ol", "### a", None]) if k % 2 else ["user", "assistant"][t % 2]
            rows.append((k, t, role, rng.choice([*NASTY, None])))
    given = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(conversation_records(given), "conv_id", "record")
    out = out.select("id", "layout", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"), F.length("formatted").alias("n"), "loss_runs").collect()
    assert len(out) == 60 and len({r.layout for r in out}) >= 5
    for r in out:
        expected = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.id]
        assert [tuple(t) for t in r.t] == expected
        assert r.loss == [text for role, text in expected if role == "assistant"]
        assert sum(x.skip + x.take + x.rest for x in r.loss_runs) == r.n


def test_layouts_by_fingerprint(llm):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"}, {"response": "b", "prompt": 7}, {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "input": "x", "output": "done"},
        {"data": {"turns": [{"speaker": "bot", "utterance": "hi"}]}}, {"prompt": "a", "response": "b", "more": 1}, {"a.b": {"`c": [[1]]}}, [], {},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "no json"), (91, None), (91, None)]
    out = chat.format_chat(llm.createDataFrame(rows, "id long, record string"))
    got = {r.id: r for r in out.collect()}
    assert [got[k].layout for k in range(len(records))] == ["messages", "conversations", "prompt", "prompt", "instruction", "instruction", "dialogue", None, None, None, None]
    assert [tuple(t) for t in got[0].turns] == [("user", "a"), ("assistant", "")]
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b")]
    assert [tuple(t) for t in got[4].turns] == [("system", "do"), ("assistant", "done")]
    assert [tuple(t) for t in got[5].turns] == [("system", "do"), ("user", "x"), ("assistant", "done")]
    assert got[90].layout is None and got[91].formatted is None and out.count() == len(rows)
    assert chat.format_chat(llm.createDataFrame([], "id long, record string")).count() == 0


def test_field_paths(llm):
    rows = [('{"b": {"c d": [1, {"x": 2}], "a": null}, "e": []}',), ('[[{"k": "v"}]]',), ("1",)]
    out = llm.createDataFrame(rows, "j string").select(chat.field_paths(F.schema_of_variant(F.parse_json("j"))).alias("p")).collect()
    assert out[1].p == sorted(["[]", "[][]", "[][].k"]) and out[2].p == []
    assert {"b", "b.a", "b.c d", "b.c d[]", "e", "e[]"} <= set(out[0].p)


def test_top_rows_match_brute_force(llm):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (300, 12))
    vectors[50:90] = vectors[50]
    vectors[100] = 40.0
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None), (550, [None, *vectors[0][1:].tolist()]), (600, [float("nan")] * 12), (650, [float("inf")] * 12), (700, vectors[3][:5].tolist()), (None, vectors[4].tolist())]
    q = bitslice.quantised(llm.createDataFrame(rows, "vec_id long, embedding array<double>"))
    exact = {k: np.pad(np.floor(256 * np.array(v)).astype(np.int64), (0, 12 - len(v))) for k, v in rows if k is not None and k not in (500, 550, 600, 650)}
    for block, chunk in ((4096, 256), (37, 3)):
        out = bitslice.search(q, q.where("vec_id % 50 = 0"), 5, block, chunk).collect()
        expected = []
        for a in (k for k in exact if k % 50 == 0):
            best = sorted((-int(exact[a] @ exact[b]), b) for b in exact if b != a)[:5]
            expected += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
        assert sorted(map(tuple, out)) == sorted(expected)
    assert bitslice.search(q.where("false"), q.where("false")).count() == 0
    assert bitslice.search(q.where("vec_id < 3"), q.where("vec_id = 0")).count() == 2


def test_pieces_are_the_tokens_and_fill_their_sequences(documents):
    rng = random.Random(2)
    words = ["The", "cat's", "naïve", "straße", "x1y2", "<|endoftext|>", "ΣΑΣ", "\x1c", "é", "日本", "!!", "a　b", "#tag", "İ", "don't."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for k in range(60)] + [(60, None), (61, ""), (62, "word " * 30_000), (62, "again"), (None, "no id")]
    pieces = packing.pack(documents(rows).repartition(3), TOKENIZER).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    whole = {}
    for k, text in rows:
        whole.setdefault(k, []).append([*plain.encode(text or "", add_special_tokens=False).ids, 1])
    for k, expected in whole.items():
        if len(expected) == 1:
            own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == expected[0]
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    assert sum(p.length for p in pieces) == sum(len(x) for w in whole.values() for x in w)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size & (size - 1) == 0 and size <= own[0].tier <= 2048
    steps = {}
    for own in sequences.values():
        steps.setdefault(own[0].step_group, []).append(own[0].tier)
    assert all(len(set(t)) == 1 and sum(t) <= packing.STEP_TOKENS for t in steps.values())
    assert {own[0].tier for own in sequences.values()} == set(packing.TIERS)
    assert packing.pack(documents([]), TOKENIZER).count() == 0


def test_stages_take_effect_and_keep_columns(llm, documents, tmp_path):
    rng = random.Random(9)
    langs = {"en": ["the", "tion", "er", "and"], "de": ["ung", "sch", "ein", "ü"]}
    rows, tags = [], []
    for k in range(80):
        lang = ["en", "de"][k % 2]
        lines = [" ".join("".join(rng.choice(langs[lang]) for _ in range(3)) for _ in range(12)) + "." for _ in range(rng.randint(3, 9))]
        rows.append((k, "\n".join(lines)))
        tags.append(lang)
    rows += [(100, rows[3][1]), (101, "7 7 7"), (102, None), (103, rows[4][1].replace("\n", " ")), (104, rows[4][1].replace("\n", "  "))]
    tags += ["en", "en", None, "en", "en"]
    table = documents(rows, tags).drop("n")
    labels = llm.createDataFrame([(k, k % 4 and 1, 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = table, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = llm.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert {101, 102}.isdisjoint(seen[0]) and {100, 103, 104, *range(80)} <= seen[0]
    assert 100 not in seen[1] and {103, 104, *range(80)} <= seen[1]
    assert 104 not in seen[2] and set(range(80)) <= seen[2] and 103 not in seen[2] - {4} - seen[2]
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    again = corpus_pipeline.run(llm, str(tmp_path))
    assert {r.doc_id for r in again.select("doc_id").collect()} == seen[4]


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES])
def test_stages_of_no_rows(llm, documents, tmp_path, stage):
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(llm, documents([]), str(tmp_path)).count() == 0
