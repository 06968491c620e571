"""WARC archives: a writer with revisit records and a salvaging reader.

The writer puts one record per page into gzip members (or plain records).  The reader
checks every record: the gzip member's checksum, the version line, the header block, the
length and end of the record, and the digests of block and payload.  After a failed check it
searches for the next gzip member or version line that begins a valid record, goes on
from there, and reports the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmetry.llm.common import small_side
from cellmetry.llm.storage import Output
from cellmetry.session import cut_lineage, shared_folder

# Fixed values of the format.
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type"}
DIGESTS = ("md5", "sha1", "sha256", "sha512")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: Payload bytes after which a task begins another archive.
FILE_BYTES = 32 << 20
_RECORD_ID = "urn:page:"


def _header(fields: list[tuple[str, str | None]], first: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return b"\r\n".join([first, *lines]) + b"\r\n\r\n"


def _line(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else re.sub(r"[\r\n]+", " ", value).strip()


def _name(page_id: int | None) -> str:
    return f"<{_RECORD_ID}{'none' if page_id is None else page_id}>"


def page_record(page_id, url, html, digest: str, refers_to) -> bytes:
    """A response record, or a revisit one that carries the HTTP header only."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = _header(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))],
        b"HTTP/1.1 200 OK",
    )
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers_to is None else _name(refers_to)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields, VERSION) + block + b"\r\n\r\n"


def page_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for a response) of every page.

    Among rows of equal payload of MIN_REVISIT_BYTES or more, those of the smallest
    page_id are responses, the others refer to it.  A null html is an empty payload; rows
    without a page_id come last, and are responses where no row of the payload has one.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    first = (
        rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select(F.col("digest").alias("d"), "first_id")
    )
    first = cut_lineage(first)
    first = small_side(first, first.count())  # few repeated payloads: pages are not shuffled
    other = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return rows.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("first_id")).alias("refers_to")
    )


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    compress: bool = True,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row of pages; returns the archives as (path, n_records).

    Each task writes the pages it reads, and begins another archive after ``file_bytes``; see
    ``page_revisits`` for the kinds of records.  An empty table writes no archive.  Other
    columns are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, held, done = None, 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out, n, held = Output(folder, "pages", ".warc.gz" if compress else ".warc"), 0, 0
                record = page_record(*(column[i].as_py() for column in batch.columns))
                out.stream.write(gzip.compress(record, 4, mtime=0) if compress else record)
                n, held = n + 1, held + len(record)
                if held >= file_bytes:
                    out.stream.close()
                    done.append((out.path, n))
                    out = None
        if out is not None:
            out.stream.close()
            done.append((out.path, n))
        if done:
            paths, counts = zip(*done)
            yield pa.RecordBatch.from_pydict({"path": list(paths), "n_records": list(counts)})

    return cut_lineage(page_revisits(pages).mapInArrow(run, "path string, n_records long"))


@dataclass
class Found:
    """A record, or a gap where ``reason`` is set; bytes start..end of the archive."""

    start: int
    end: int
    fields: dict[str, str] | None = None
    payload: bytes | None = None
    reason: str | None = None


class _Invalid(Exception):
    pass


def _fields(block: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    name = None
    for line in block.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise _Invalid("malformed header line")
        name = key.decode("utf-8", "replace").strip().lower()
        if name in fields and name in _ONCE:
            raise _Invalid("header field repeated")  # a cut header ran into the next record
        fields[name] = value.decode("utf-8", "replace").strip()
    return fields


def _check_digest(fields: dict[str, str], name: str, data: bytes) -> None:
    """Compare a digest of the header, in hex or base32; note one that cannot be computed."""
    label, colon, value = fields.get(name, "").partition(":")
    if not colon:
        return
    if label.lower() not in DIGESTS:
        fields["unchecked"] = ",".join(x for x in (fields.get("unchecked"), label.lower()) if x)
        return
    found = hashlib.new(label, data).digest()
    if value.lower() != found.hex():
        if value.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("="):
            raise _Invalid(f"{name.removeprefix('warc-').replace('-', ' ')} differs")


def _record(text: bytes, start: int) -> tuple[int, dict, bytes]:
    """End, fields and payload of the plain record at start of text, or _Invalid."""
    line = _VERSION_LINE.match(text, start)
    if not line:
        raise _Invalid("no version line")
    close = text.find(b"\r\n\r\n", line.end() - 2)
    if close < 0:
        raise _Invalid("header without an end")
    if close < line.end():
        raise _Invalid("no header fields")
    fields = _fields(text[line.end() : close])
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise _Invalid("no content length")
    begin, end = close + 4, close + 4 + int(size)
    if text[end : end + 4] != b"\r\n\r\n":
        raise _Invalid("length does not reach the record's end")
    block = text[begin:end]
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise _Invalid("HTTP header without an end")
        http = _fields(head.partition(b"\r\n")[2]) if b"\r\n" in head else {}
        fields["http-content-length"] = http.get("content-length", "")
    fields.pop("unchecked", None)
    _check_digest(fields, "warc-block-digest", block)
    if fields.get("warc-type") in ("response", "resource"):
        _check_digest(fields, "warc-payload-digest", payload)
    return end + 4, fields, payload


def _member(data: bytes, start: int) -> tuple[int, bytes]:
    """End and content of the gzip member at start, checksum verified, or _Invalid."""
    unzip = zlib.decompressobj(31)
    parts, at = [], start
    try:
        while not unzip.eof:
            if at >= len(data):
                raise _Invalid("gzip member is cut off")
            parts.append(unzip.decompress(data[at : at + (1 << 18)]))
            at += 1 << 18
    except zlib.error as error:
        raise _Invalid(f"gzip: {error}") from None
    return min(at, len(data)) - len(unzip.unused_data), b"".join(parts)


def _inside(content: bytes, start: int, end: int) -> list[Found]:
    """Records and gaps of an unzipped member; all of them are at the member's bytes."""
    found = list(salvage_records(content, plain=True))
    if not any(f.reason is None for f in found):
        raise _Invalid("gzip member without a record")
    return [Found(start, end, f.fields, f.payload, f.reason) for f in found]


def salvage_records(data: bytes, plain: bool = False) -> Iterator[Found]:
    """Records of an archive in order, and the gaps between those that are valid."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            if not plain and data[at : at + 3] == b"\x1f\x8b\x08":
                end, content = _member(data, at)
                found = _inside(content, at, end)
            else:
                end, fields, payload = _record(data, at)
                found = [Found(at, end, fields, payload)]
        except _Invalid as failed:
            if bad is None:
                bad, why = at, str(failed)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield Found(bad, at, reason=why)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Found(bad, len(data), reason=why)


READ_SCHEMA = (
    "path string, start long, end long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, unchecked string, payload_bytes long, payload binary"
)
_ARROW = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    + [(c, pa.string()) for c in "reason record_type record_id target_uri refers_to payload_digest unchecked".split()]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _row(path: str, f: Found) -> dict:
    row = dict.fromkeys(_ARROW.names) | {"path": path, "start": f.start, "end": f.end, "reason": f.reason}
    if f.fields is None:
        return row
    kind = f.fields.get("warc-type")
    declared = f.fields.get("http-content-length", "")
    digest = f.fields.get("warc-payload-digest", "").removeprefix("sha256:").lower()
    if kind == "revisit":
        size = int(declared) if declared.isdigit() else None
    else:
        size, digest = len(f.payload), hashlib.sha256(f.payload).hexdigest()
    return row | {
        "record_type": kind, "record_id": f.fields.get("warc-record-id"),
        "target_uri": f.fields.get("warc-target-uri"), "refers_to": f.fields.get("warc-refers-to"),
        "payload_digest": digest or None, "unchecked": f.fields.get("unchecked"), "payload_bytes": size,
        "payload": None if kind == "revisit" else f.payload,
    }


def read_warc(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives given as (path, content), as binaryFile reads them.

    A row is a record, or a quarantined gap where ``reason`` (the failed check) is not
    null; ``start`` and ``end`` are its bytes in the archive, those of the gzip member
    where it lies in one.  Of a revisit, length and digest are those its headers give.  Digests of
    blocks, and of the payloads of response and resource records, are compared if they are by one
    of DIGESTS, in hex or base32; ``unchecked`` lists other algorithms that a record names.
    Empty or null contents give no rows.  Archives are read whole, one per task and row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for f in salvage_records(content or b""):
                    rows.append(_row(path, f))
                    held += len(f.payload or b"")
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return archives.select("path", "content").mapInArrow(run, READ_SCHEMA)


def load_archives(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """(path, content) of the archives in a folder, of those listed in ``written`` only."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc*")
        .load(folder)
        .select("path", "content")
    )
    if written is None:
        return found
    name = F.element_at(F.split("path", "/"), -1)
    listed = small_side(written.select(name.alias("listed")), written.count())
    return found.join(listed, name == F.col("listed"), "left_semi")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_folder(pages.sparkSession, "warc")
    written = write_warc(pages, folder)
    if written.isEmpty():
        records = pages.sparkSession.createDataFrame([], READ_SCHEMA)
    else:
        records = read_warc(load_archives(pages.sparkSession, folder, written))
    number = lambda c: F.regexp_extract(c, f"{_RECORD_ID}(-?[0-9]+)", 1).try_cast("long")
    return records.where("reason IS NULL").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100
    THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
