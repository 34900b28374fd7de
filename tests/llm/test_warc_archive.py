from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest
import zstandard

from kelpgrid.llm import warc_archive as W
from kelpgrid.llm.staging import new_path


def frames(level=3, dictionary=b"<html><body><p>" * 40):
    coder = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    payloads = [b"", b"x", b"<html>" + b"abc" * 100_000, "é\r\n\r\nü".encode()]
    out = W.dictionary_frame(dictionary)
    for i, p in enumerate(payloads):
        out += coder.compress(W.record_bytes(i, f"http://a/ü?\n{i}" if i else None, p, hashlib.sha256(p).hexdigest())) + W.EMPTY_FRAME
    return out, payloads


def test_records_round_trip():
    data, payloads = frames()
    found = list(W.records(data))
    assert [r["payload"] for r in found] == payloads
    assert [r["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in range(4)]
    assert list(W.records(b"")) == []


@pytest.mark.parametrize("spoil", [lambda d: d[:-20], lambda d: d[:30] + d[31:], lambda d: d[8:], lambda d: d + b"junk", lambda d: d[: len(d) // 2] + b"\0" + d[len(d) // 2 :]])
def test_broken_archives(spoil):
    data, _ = frames()
    with pytest.raises(W.ArchiveError):
        list(W.records(spoil(data)))


def test_headers_are_validated():
    good = W.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest())
    assert W.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"abc\r\n\r\n", b"abcd\r\n\r\n"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"abc\r\n", b"abd\r\n"), good[:-4]):
        with pytest.raises(W.ArchiveError):
            W.parse_record(bad)


def pages():
    same, short = "<p>" + "same " * 50, "short"
    rows = [(5, "http://a", same), (3, "http://b", same), (9, None, same), (4, "u\nv", short), (2, "w", short), (7, None, None), (8, "x", ""), (None, "n", same), (3, "http://b", same), (11, "long", "é" * 300_000), (2**63 - 1, "greatest", same), (2**53 + 1, "odd", "odd " * 40), (2**53 + 3, "odd again", "odd " * 40), (-4, "negative", "y" * 120)]
    return [(*r, "clash", 1) for r in rows]


SCHEMA = "page_id long, url string, html string, payload_digest string, refers_to int"


def test_round_trip(spark):
    got = sorted((tuple(r) for r in W.round_trip(spark.createDataFrame(pages(), SCHEMA)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, html, *_ in pages():
        data = (html or "").encode()
        first = min((j for j, _, h, *_ in pages() if j is not None and h == html), default=None)
        revisit = i is not None and len(data) >= 100 and i > first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_and_files(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(2)
    path = new_path(spark, "test")
    W.write_archives(W.with_revisits(df), path)
    found = W.read_archives(spark, path).collect()
    assert len(found) == len(pages())
    html = {i: h or "" for i, _, h, *_ in pages()}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in found if r.record_type == "response" and r.page_id is not None)
    raw = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert all(d[:4] == struct.pack("<I", W.DICTIONARY_MAGIC) for d in raw if d)


def test_archives_are_bounded(spark):
    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choices("abcdefgh <>/", k=rng.randint(0, 3000))), None, None) for i in range(300)]
    df = W.with_revisits(spark.createDataFrame(rows, SCHEMA)).coalesce(1)
    path = new_path(spark, "test")
    W.write_archives(df, path, line_bytes=5000, lines=4)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 10 and max(len(f.content) for f in files) < 4 * 10_000 + 20_000
    assert all(len(list(W.records(bytes(f.content)))) > 0 for f in files)
    assert {(r.page_id, bytes(r.payload).decode()) for r in W.read_archives(spark, path).collect()} == {(i, h) for i, _, h, *_ in rows}


def test_a_missing_length_is_an_archive_error():
    bare = W.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest())
    head, _, rest = bare.partition(b"\r\n\r\n")
    block = rest[:-4].replace(b"Content-Length: 3", b"X-Other-Len.th: 3")
    head = re.sub(rb"WARC-Block-Digest: sha256:\w+", b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), head)
    with pytest.raises(W.ArchiveError):
        W.parse_record(head + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_page_id_of_several_payloads(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(1, "u", a, None, None), (1, "u", b, None, None), (5, "v", a, None, None), (5, "v", b, None, None), (5, "v", a, None, None), (3, "w", b, None, None)]
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to, r.payload_bytes) for r in W.round_trip(spark.createDataFrame(rows, SCHEMA)).collect())
    digest = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b)}
    assert got == sorted((i, digest[h], "response" if i == 1 else "revisit", None if i == 1 else 1, 150) for i, _, h, *_ in rows)
