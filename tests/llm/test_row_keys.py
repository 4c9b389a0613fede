"""Rows that share an id, or have none, with different texts are different documents."""

import random

import pytest

from spendweave.llm import lines, spans
from tests.llm.test_dedup import slow_lines, slow_spans


def _rows():
    rng = random.Random(9)
    shared = [f"this shared line has number {k} and ends. Another sentence follows it here now." for k in range(24)]
    rows = []
    for k in range(60):
        own = [f"row {k} has its own line {j} here. It also has one more sentence of {k} and {j}." for j in range(rng.randint(1, 14))]
        rows.append((k % 20 if k % 3 else None, "\n".join(own)))
    a, b = "\n".join(f"a {k} is a line. Of its own it is, number {k} here." for k in range(40)), "\n".join(f"b {k} is a line. Of its own it is, number {k} there." for k in range(40))
    rows += [(100, a), (101, a), (101, b), (101, "short"), (101, None), (101, ""), (None, None), (None, a), (None, a)]
    return rows, [(-1, "\n".join(shared)), *[(200 + k, "\n".join([*shared, f"and then {k} comes. It ends the text number {k} now."])) for k in range(5)]]


@pytest.mark.parametrize("dedup, slow", [(lines.dedup_lines, slow_lines), (spans.dedup_spans, slow_spans)])
def test_one_id_with_different_texts(documents, dedup, slow):
    rows, plain = _rows()
    # as if each distinct row had an id of its own, in the order that counts: no id first, then by id
    distinct = sorted({(i, t) for i, t in rows + plain}, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    told = slow([(k, t) for k, (_, t) in enumerate(distinct)])
    expected = {r: told[k] for k, r in enumerate(distinct)}
    got = dedup(documents(rows + plain)).collect()
    assert len(got) == len(rows + plain)
    left = sorted(((r.doc_id, r.n_removed, r.text) for r in got), key=str)
    assert left == sorted(((i, *expected[i, t]) for i, t in rows + plain), key=str)
    b = next(t for i, t in rows if i == 101 and (t or "").startswith("b"))
    assert (101, 0, b) in left
