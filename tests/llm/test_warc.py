"""WARC round trips, and what the reader salvages from damaged archives."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellmetry.llm import warc
from cellmetry.session import ship
from llm_fixtures import SF001

PAGES = "page_id long, url string, html string"


def records(n=6, compress=True):
    out = []
    for i in range(n):
        html = f"<p>page {i} WARC/1.1\r\nnot a record</p>" * (i + 3)
        r = warc.page_record(i, "http://x", html, hashlib.sha256(html.encode()).hexdigest(), None)
        out.append(gzip.compress(r) if compress else r)
    return out


def names(found):
    return [f.fields["warc-record-id"] for f in found if f.reason is None]


def covers(found, data):
    """Records and gaps follow one another over all bytes."""
    at = 0
    for f in found:
        assert f.start == at, f
        at = f.end
    assert at == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_every_record_but_the_damaged_one_is_recovered(compress):
    parts = records(compress=compress)
    for broken in range(6):
        for where in (0, 5, len(parts[broken]) // 2, len(parts[broken]) - 6):
            damaged = bytearray(parts[broken])
            damaged[where] ^= 0xFF
            data = b"".join([*parts[:broken], bytes(damaged), *parts[broken + 1 :]])
            found = list(warc.salvage_records(data))
            covers(found, data)
            whole = {f"<urn:page:{i}>" for i in range(6)} - {f"<urn:page:{broken}>"}
            assert whole <= set(names(found))
            gaps = [f for f in found if f.reason]
            start = sum(map(len, parts[:broken]))
            if f"<urn:page:{broken}>" not in names(found):
                assert [(g.start, g.end) for g in gaps] == [(start, start + len(parts[broken]))]


def digested(name, label, kind="response"):
    """A plain record with one digest, computed with the function of that name."""
    payload = b"<p>of a payload</p>" * 9
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 171\r\n\r\n" + payload
    of = block if name == "WARC-Block-Digest" else payload
    value = label(of)
    lines = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), b"WARC-Record-ID: <urn:page:1>",
             b"Content-Type: application/http", f"{name}: {value}".encode(),
             f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("name", ["WARC-Block-Digest", "WARC-Payload-Digest"])
@pytest.mark.parametrize(
    "label",
    [
        lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode(),
        lambda b: "SHA1:" + hashlib.sha1(b).hexdigest().upper(),
        lambda b: "md5:" + base64.b32encode(hashlib.md5(b).digest()).decode().rstrip("="),
        lambda b: "sha512:" + hashlib.sha512(b).hexdigest(),
    ],
)
def test_digests_of_block_and_payload(name, label):
    record = digested(name, label)
    (whole,) = warc.salvage_records(record)
    assert whole.reason is None and "unchecked" not in whole.fields
    damaged = record.replace(b"payload</p>", b"Payload</p>", 1)
    found = list(warc.salvage_records(damaged + record))
    assert [f.reason is None for f in found] == [False, True]
    assert found[0].reason == name.removeprefix("WARC-").replace("-", " ").lower() + " differs"
    # A revisit's payload digest is that of another record.
    other = digested(name, label, "revisit").replace(b"payload</p>", b"Payload</p>", 1)
    assert (next(iter(warc.salvage_records(other))).reason is None) == (name == "WARC-Payload-Digest")


def test_unknown_digests_are_named(spark):
    ship(spark)
    record = digested("WARC-Payload-Digest", lambda b: "crc9:00")
    known = digested("WARC-Payload-Digest", lambda b: "sha1:" + hashlib.sha1(b).hexdigest())
    archives = spark.createDataFrame([("a", record + known)], "path string, content binary")
    got = [(r.reason, r.unchecked) for r in warc.read_warc(archives).orderBy("start").collect()]
    assert got == [(None, "crc9"), (None, None)]


@pytest.mark.parametrize("compress", [True, False])
def test_cuts_and_rubbish(compress):
    parts = records(compress=compress)
    junk = bytes(random.Random(3).randbytes(5000)) + b"WARC/1.1\r\n\x1f\x8b\x08"
    data = junk + parts[0] + parts[1][: len(parts[1]) // 2] + parts[2] + junk + parts[3] + parts[4][:-9]
    found = list(warc.salvage_records(data))
    covers(found, data)
    assert names(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert len([f for f in found if f.reason]) == 4


def test_one_member_with_all_records_and_a_bad_one():
    parts = records(compress=False)
    wrong = parts[2].replace(b"page 2", b"page X", 1)
    found = list(warc.salvage_records(gzip.compress(b"".join([parts[0], wrong, parts[3]]))))
    assert names(found) == ["<urn:page:0>", "<urn:page:3>"]
    assert [f.reason for f in found if f.reason] == ["payload digest differs"]
    assert list(warc.salvage_records(b"")) == []


def plain(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    return sorted(
        (str(i), len(b), hashlib.sha256(b).hexdigest(), *(
            ("response", None) if b not in first or first[b] == i else ("revisit", first[b])
        ))
        for i, b in rows
    )


def got(pages):
    return sorted((str(r.page_id), *r[1:]) for r in warc.round_trip(pages).collect())


def test_round_trip(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    more = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)
    pages = pages.union(more)
    assert got(pages) == plain(pages)


def test_archives_are_rolled(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    written = warc.write_warc(pages, file_bytes=20_000)
    assert written.count() > 3
    assert written.agg(F.sum("n_records")).first()[0] == pages.count()


def test_edges_of_the_input(spark):
    ship(spark)
    same = "é" * 60
    rows = [(5, "u", same), (3, None, same), (3, None, same), (None, "http://a\r\nb", same), (7, "u", None),
            (8, "u", ""), (9, "u", "short"), (2, "u", "short"), (11, "u", "x" * 3_000_000), (None, "u", "y" * 200)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("d")).withColumn("refers_to", F.lit(1))
    assert got(pages) == plain(pages)
    assert got(pages.limit(0)) == []


def test_plain_archives_and_gap_rows(spark):
    ship(spark)
    parts = records(compress=False)
    data = parts[0] + parts[1][10:] + parts[2]
    archives = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray()), ("c", None)], "path string, content binary")
    rows = warc.read_warc(archives).orderBy("start").collect()
    assert [(r.path, r.record_id, r.reason is None) for r in rows] == [
        ("a", "<urn:page:0>", True), ("a", None, False), ("a", "<urn:page:2>", True)
    ]
    assert (rows[1].start, rows[1].end) == (len(parts[0]), len(parts[0]) + len(parts[1]) - 10)
