"""WARC archives: records with revisits of equal payloads, and a reader that recovers what follows damaged bytes."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm.common import lean, ready, store
from spendweave.session import spread_join

#: Payloads of so many bytes or more are written once.
LEAST = 1000
#: Bytes of payload that an archive should hold; archives end after a number of records, so single ones can be larger.
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive that reach a Python worker in one row, and of records that leave it in one batch.
SLICE, BATCH_BYTES = 32 << 10, 4 << 20
#: A header that doesn't end within so many bytes is damaged.
HEADER_BYTES = 1 << 20
LINE, END = b"\r\n", b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+")
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
#: An empty gzip member: it parts compressed records where Spark's text writer asks for a separator, and unpacks to nothing.
EMPTY = MAGIC + bytes(6) + b"\xff\x03" + bytes(9)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, refers_url``: the UTF-8 payload of each row, and the row that it revisits.

    A null text is an empty payload. Of equal payloads (same SHA-256) of ``least`` bytes or more, the row with the largest
    page_id is written in full, and the others revisit it; a null page_id counts as smaller than any. Rows that repeat the
    largest page_id with the same payload are written in full each, and so are rows of a group that has no page_id at all.
    Digests are combined before they are shuffled, and rows meet their group in a join that adaptive execution splits where a
    group is large; no group is ever gathered.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    held = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("last"))
    groups = store(held.where("n > 1 and last.page_id is not null").select("key", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url")))
    later = F.col("refers_to").isNotNull() & F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True))
    return rows.join(groups, "key", "left").select(
        "page_id", "url", "payload", F.sha1("payload").alias("digest"), *[F.when(later, F.col(c)).alias(c) for c in ("refers_to", "refers_url")],
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest()).urn}>"


def _line_safe(url: str) -> str:
    """Control characters and spaces of an address percent-encoded, so that it stays on its line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _written(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    fields |= {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    head = [f"WARC-Type: {kind}", *[f"{name}: {value}" for name, value in fields.items() if value is not None]]
    return b"WARC/1.1" + LINE + "\r\n".join(head).encode() + END + block


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A response, or a revisit that has the HTTP head only, without the two line ends that close a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date, "WARC-Target-URI": None if url is None else _line_safe(url),
        "Page-ID": None if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return _written("response", fields, http + payload)
    refers = {
        "WARC-Refers-To": _record_id(refers_to, digest), "WARC-Refers-To-Target-URI": None if refers_url is None else _line_safe(refers_url),
        "WARC-Profile": PROFILE,
    }
    return _written("revisit", fields | refers, http)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", compressed: bool = True,
    date: str = "1970-01-01T00:00:00Z", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write one WARC 1.1 record per row of ``pages`` into archives in ``folder``, each with a ``warcinfo`` record first.

    Archives are written by Spark's own text writer, so a retried task replaces its files: plain ones, whose records it closes
    with two line ends, or ones of a gzip member per record, parted by empty members. ``page_id`` travels in a field of its own.
    An empty table gives no archive.
    """
    text = F.octet_length(F.col(text_col).cast("string"))
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    per_archive = 1 + max(1, int(archive_bytes * n // max(size, 1)))
    rows = payloads(pages, id_col, url_col, text_col, least)
    wrapped = (lambda data: member(data + END)) if compressed else bytes
    info = wrapped(_written("warcinfo", {"WARC-Record-ID": "<urn:uuid:00000000-0000-0000-0000-000000000000>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            out: list[bytes] = []
            for row in zip(*[batch.column(k) for k in range(6)]):
                if made % per_archive == 0:  # the writer begins a new file here
                    out.append(info)
                    made += 1
                out.append(wrapped(record(*[x.as_py() for x in row], date)))
                made += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = rows.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(lean(scan), "value binary").select(F.col("value").cast("string"))
    parted = {"lineSep": EMPTY.decode("latin-1"), "encoding": "ISO-8859-1"} if compressed else {"lineSep": END.decode()}
    lines.write.options(**parted, maxRecordsPerFile=per_archive, compression="none").text(folder)


class Damaged(Exception):
    """Bytes at this place are no valid record."""


class _Raw:
    """An archive's bytes as they come in, from the first that isn't dealt with yet; what is behind is let go."""

    def __init__(self, slices: Iterable[bytes]):
        self.slices, self.held, self.at = iter(slices), bytearray(), 0

    def more(self) -> bool:
        piece = next(self.slices, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def upto(self, n: int) -> bool:
        while len(self.held) < n and self.more():
            pass
        return len(self.held) >= n

    def passed(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def _checked(claim: str | None, data: bytes, what: str) -> None:
    """Compare with a digest ``algorithm:value``, base 32 or hexadecimal; an unknown algorithm tells nothing."""
    if claim is None:
        return
    algorithm, _, value = claim.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm in ("sha1", "sha256", "sha512", "md5"):
        own = hashlib.new(algorithm, data)
        if value.strip().lower() != own.hexdigest() and value.strip().upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("="):
            raise Damaged(f"{what} digest differs")


def _parsed(raw: _Raw) -> tuple[int, dict, bytes]:
    """Length, fields and block of the plain record that begins here."""
    raw.upto(len(b"WARC/"))
    if not raw.held.startswith(b"WARC/"):
        raise Damaged("no version line")
    seen = 0
    while (ends := raw.held.find(END, max(0, seen - 3), HEADER_BYTES)) < 0:
        seen = len(raw.held)
        if seen >= HEADER_BYTES or not raw.more():
            raise Damaged("header without end")
    first, *lines = bytes(raw.held[:ends]).split(LINE)
    if not VERSION.fullmatch(first):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damaged("header line without a name")
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("field missing")
    start = ends + len(END)
    whole = start + int(size) + len(END)
    if not raw.upto(whole):
        raise Damaged("record cut off")
    if raw.held[whole - len(END) : whole] != END:
        raise Damaged("record without end")
    block = bytes(raw.held[start : whole - len(END)])
    _checked(fields.get("warc-block-digest"), block, "block")
    return whole, fields, block


def _entry(raw: _Raw) -> tuple[int, list[tuple[dict, bytes]]]:
    """Length and records of what begins here: a gzip member of whole records, or one plain record."""
    raw.upto(len(MAGIC))
    if raw.held[: len(MAGIC)] != MAGIC:
        size, fields, block = _parsed(raw)
        return size, [(fields, block)]
    unpacker, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not unpacker.eof:
            if fed == len(raw.held) and not raw.more():
                raise Damaged("member cut off")
            part = bytes(raw.held[fed : fed + SLICE])
            out.append(unpacker.decompress(part))
            fed += len(part)
    except zlib.error as e:
        raise Damaged("member doesn't unpack") from e
    inner, found = _Raw([b"".join(out)]), []
    while inner.upto(1):
        size, fields, block = _parsed(inner)
        found.append((fields, block))
        inner.passed(size)
    return fed - len(unpacker.unused_data), found


def _next(raw: _Raw) -> int:
    """Where, from the second byte on, a member or a version line may begin; all there is if none does."""
    seen = 1
    while not (place := CANDIDATE.search(raw.held, seen)):
        seen = max(1, len(raw.held) - 16)
        if seen > SLICE:  # a long stretch without one is let go
            return seen
        if not raw.more():
            return len(raw.held)
    return place.start()


def salvage(slices: Iterable[bytes]) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    """``(offset, length, problem, fields, block)`` of an archive's records, and of the gaps between them, which have a problem.

    What doesn't pass its checks (gzip's checksum and length, the header, the length and end of the block, its digest) is
    quarantined up to the next place where a gzip member or a version line begins and passes them. Offsets and lengths count
    bytes of the archive as it is stored; all bytes but empty members and blank lines belong to a record or to a gap.
    """
    raw, gap, why = _Raw(slices), 0, None
    while raw.upto(1):
        if raw.held[0] in LINE and why is None:
            raw.passed(1)
            continue
        try:
            size, found = _entry(raw)
        except Damaged as e:
            gap, why = (raw.at, str(e)) if why is None else (gap, why)
            raw.passed(_next(raw))
            continue
        if why is not None:
            yield gap, raw.at - gap, why, {}, b""
            why = None
        for fields, block in found:
            yield raw.at, size, None, fields, block
        raw.passed(size)
    if why is not None:
        yield gap, raw.at - gap, why, {}, b""


READ = "path string, offset long, length long, problem string, fields map<string,string>, http binary, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, length, problem, fields, http, payload`` of every record and every quarantined gap of the archives.

    A gap has a ``problem`` and nothing else; records have none. ``fields`` are the named fields, in small letters. Of an HTTP
    block, ``http`` is the head and ``payload`` the rest; another block is all payload. An archive is read by one task, in
    slices, so a Python worker holds no more than one record and a slice; Spark's binary source takes archives below 2 GB. An
    empty folder gives no rows.
    """
    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.octet_length("content").alias("size")).where("size > 0")
    starts = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(SLICE)))
    slices = files.select("path", "content", starts.alias("start")).select("path", "start", F.substring("content", F.col("start") + 1, F.lit(SLICE)).alias("part"))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in READ.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for path, start, part in zip(batch.column(0), batch.column(1), batch.column(2)):
                yield path.as_py(), start.as_py(), part.as_py()

    def archives(flat: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple]:
        ahead = next(flat, None)
        while ahead:
            name = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == name:
                    part, ahead = ahead[2], next(flat, None)
                    yield part
                    if ahead and ahead[1] == 0:
                        return

            for found in salvage(own()):
                yield name, *found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for name, offset, length, problem, fields, block in chain(archives(rows(batches)), [(None,) * 6]):
            if name is not None:
                http = b""
                if fields.get("content-type", "").lower().startswith("application/http"):
                    head, end, block = block.partition(END)
                    http = head + end
                out.append((name, offset, length, problem, list(fields.items()), None if problem else http, None if problem else block))
                size += len(block) + len(http)
            if out and (name is None or size >= BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
                out, size = [], 0

    return slices.mapInArrow(lean(scan), READ)


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: ``path, offset, length, problem``."""
    return read.where("problem is not null").select("path", "offset", "length", "problem")


def resolved(read: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of responses and revisits.

    Of a revisit, length and digest are those of the payload that it refers to; where that response is lost, the digest is the
    hexadecimal one that the revisit claims, and length and ``refers_to`` are null. Many revisits of one response are spread in their join.
    """
    field = lambda name: F.col("fields").getItem(name)
    claimed = F.lower(F.regexp_extract(field("warc-payload-digest"), "^sha1:([0-9A-Fa-f]{40})$", 1))
    rows = store(
        read.where("problem is null and fields['warc-type'] in ('response', 'revisit')").select(
            field("page-id").cast("long").alias("page_id"), field("warc-target-uri").alias("url"), field("warc-type").alias("record_type"), field("warc-record-id").alias("record_id"),
            field("warc-refers-to").alias("refers_id"), claimed.alias("claimed"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"),
        )
    )
    full = rows.where("record_type = 'response'").select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    targets = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max(F.struct("page_id", "bytes", "digest")).alias("to"))
    joined = spread_join(rows.where("record_type = 'revisit'"), targets, "refers_id", "page_id", "left")
    short = joined.select(
        "page_id", "url", F.col("to.bytes").alias("payload_bytes"), F.coalesce("to.digest", "claimed").alias("payload_digest"), "record_type", F.col("to.page_id").alias("refers_to"),
    )
    return full.unionByName(short)
