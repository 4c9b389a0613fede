"""Archives: round trips, revisits, and what is recovered behind damage."""

import hashlib
import random
import re

import pytest

from spendweave.llm import warc


def _pages(llm, rows):
    """Pages with an extra column that has a name used inside."""
    return llm.createDataFrame([(i, u, h, "mine") for i, u, h in rows], "page_id long, url string, html string, payload string")


BIG, NEXT = "a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n" * 60, "é" * 600
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2 b\r\nX: y", BIG), (3, None, BIG), (None, "http://a/n", BIG), (3, "http://a/3", BIG),
    (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", NEXT), (9, "u", "\x1f\x8b\x08" + "x" * 70_000), (None, None, None),
    (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000), (None, "u", "w" * 1000), (None, "u", "w" * 1000),
]


def _expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        later = len(data) >= 1000 and bool(same) and (i is None or i < max(same))
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", max(same) if later else None))
    return sorted(out, key=str)


def _got(llm, folder):
    out = warc.resolved(warc.read_archives(llm, folder))
    return sorted([tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip(llm, tmp_path, compressed):
    folder = str(tmp_path / "out")
    warc.write_archives(_pages(llm, ROWS), folder, compressed=compressed, archive_bytes=20_000)
    assert len(list((tmp_path / "out").glob("part-*"))) > 3
    assert _got(llm, folder) == _expected(ROWS)
    read = warc.read_archives(llm, folder)
    assert warc.gaps(read).count() == 0
    assert {r[0] for r in read.selectExpr("fields['warc-type']").collect()} == {"warcinfo", "response", "revisit"}
    urls = {r["page_id"]: r["url"] for r in warc.resolved(read).collect()}
    assert urls[2] == "http://a/2%20b%0D%0AX:%20y" and urls[4] == "u"


def test_empty_table(llm, tmp_path):
    warc.write_archives(_pages(llm, []), str(tmp_path / "out"))
    assert _got(llm, str(tmp_path / "out")) == []


def _plain(n):
    return [warc.record(k, f"http://x/{k}", bytes([97 + k % 26]) * (50 + 977 * k % 5000), hashlib.sha1(b"").hexdigest(), None, None, "1970-01-01T00:00:00Z") + warc.END for k in range(n)]


def _ids(found):
    return [int(f["page-id"]) for _, _, why, f, _ in found if why is None]


def _sliced(data, size):
    return [data[k : k + size] for k in range(0, len(data), size)]


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_each_broken_record_is_the_only_one_lost(compressed, size):
    parts = [warc.member(r) for r in _plain(12)] if compressed else _plain(12)
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    rng = random.Random(size)
    for hit in (0, 5, 11):
        data = bytearray(b"".join(parts))
        at = starts[hit] + (0 if hit == 5 else len(parts[hit]) - rng.randrange(5, 50))  # a plain header's own bytes have no check
        data[at] ^= 0x55
        found = list(warc.salvage(_sliced(bytes(data), size)))
        assert _ids(found) == [k for k in range(12) if k != hit], (hit, at)
        assert [(a, n) for a, n, why, _, _ in found if why] == [(starts[hit], len(parts[hit]))]


def test_lengths_cuts_and_noise():
    parts = _plain(6)
    longer = re.sub(rb"Content-Length: (\d+)(?=\r\n\r\nHTTP)", lambda m: b"Content-Length: %d" % (int(m[1]) + len(parts[3])), parts[2])
    found = list(warc.salvage([b"".join([*parts[:2], longer, *parts[3:]])]))
    assert _ids(found) == [0, 1, 3, 4, 5] and [n for _, n, why, _, _ in found if why] == [len(longer)]
    cut = b"".join(parts)[:-40]
    found = list(warc.salvage([cut]))
    assert _ids(found) == [0, 1, 2, 3, 4] and [(a, n) for a, n, why, _, _ in found if why] == [(sum(map(len, parts[:5])), len(parts[5]) - 40)]
    noise = random.Random(3).randbytes(300_000).replace(b"WARC", b"____").replace(warc.MAGIC, b"___")
    mixed = noise + parts[0] + b"\r\n\r\n" + noise[:100] + warc.member(parts[1]) + warc.EMPTY + parts[2] + noise[:50]
    found = list(warc.salvage(_sliced(mixed, 5000)))
    assert _ids(found) == [0, 1, 2]
    assert [(a, n) for a, n, why, _, _ in found if why] == [(0, 300_000), (300_004 + len(parts[0]), 100), (len(mixed) - 50, 50)]
    assert list(warc.salvage([])) == [] and list(warc.salvage([b"\r\n\r\n"])) == []
    assert [why for _, _, why, _, _ in warc.salvage([b"WARC/1.1\r\n" + b"a: b\r\n" * 300_000])] == ["header without end"]


def test_damaged_archive_through_spark(llm, tmp_path):
    rows = [(k, f"http://x/{k}", chr(97 + k % 5) * 3000) for k in range(40)]
    warc.write_archives(_pages(llm, rows).coalesce(1), str(tmp_path / "out"), archive_bytes=1 << 30)
    [file] = (tmp_path / "out").glob("part-*")
    data = bytearray(file.read_bytes())
    whole = list(warc.salvage([bytes(data)]))
    hit = next((a, n) for a, n, _, f, _ in whole if f.get("page-id") == "39")  # the response of every fifth page
    data[hit[0] + hit[1] - 6] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(data)
    read = warc.read_archives(llm, str(tmp_path / "bad"))
    assert [(r.offset, r.length, r.problem) for r in warc.gaps(read).collect()] == [(hit[0], hit[1], "member doesn't unpack")]
    out = {r.page_id: r for r in warc.resolved(read).collect()}
    assert sorted(out) == list(range(39))
    lost = out[34]
    assert (lost.record_type, lost.payload_bytes, lost.refers_to, lost.payload_digest) == ("revisit", None, None, hashlib.sha1(rows[39][2].encode()).hexdigest())
    assert (out[33].payload_bytes, out[33].refers_to) == (3000, 38)
