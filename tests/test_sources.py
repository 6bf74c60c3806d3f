"""Readers of text indexes and archives, on small files made here."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import access, captures, ingest
from tidemark.sources import archives, text

LINES = [
    " CDX N b a m s k r M S V g",
    "com,example)/ 20140101000000 http://example.com/ text/html 200 AAAA - - 100 5 a.warc.gz",
    "com,example)/b 20140102000000 http://example.com/b text/html 200 BBBB 77",
    "com,example)/c 20140103000000 http://example.com/c text/html 200 CCCC - 9 b.warc.gz",
    "com,example)/d 20140104000000 http://example.com/d text/html 200 DDDD - - 9 b.warc.gz",
    "com,example)/e 20140105000000 http://example.com/e warc/revisit - AAAA - 9 b.warc.gz 100 5 a.warc.gz",
    "com,example)/f 20140106000000 http://example.com/f warc/revisit - AAAA - - 9 b.warc.gz 100 5 a.warc.gz",
    "com,example)/g 20140107000000 http://example.com/g warc/revisit - AAAA - - 3 9 b.warc.gz 100 5 a.warc.gz",
    'com,example)/h 20140108000000 {"original": "http://example.com/é h", "m": "text/html", "s": "12", "statuscode": "200", "digest": "E", "nested": {"x": 1}}',
    "not a capture line",
    "",
]


def test_lines_of_every_layout(spark):
    df = spark.createDataFrame([(x,) for x in LINES] + [(None,)], "line string")
    got = {r["urlkey"][-1]: r for r in text.parse_lines(df).collect()}
    assert len(got) == 8
    assert (got["/"]["length"], got["/"]["offset"], got["/"]["filename"]) == ("100", "5", "a.warc.gz")
    assert (got["b"]["length"], got["b"]["offset"]) == ("77", None)
    assert (got["c"]["offset"], got["c"]["robotflags"], got["d"]["robotflags"]) == ("9", None, "-")
    assert all(got[k]["orig_offset"] == "5" for k in "efg") and got["g"]["length"] == "3"
    h = got["h"]
    assert (h["url"], h["mime"], h["length"], h["status"], h["extra"]) == ("http://example.com/%C3%A9 h", "text/html", "12", "200", {"nested": '{"x":1}'})
    assert text.parse_lines(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="not a capture"):
        text.parse_lines(df, "fail").collect()


def test_text_forms_round_trip(spark, tmp_path):
    df = text.parse_lines(spark.createDataFrame([(x,) for x in LINES], "line string")).where("orig_offset is null")
    df.select(ingest.cdxj_line().alias("value")).write.text(str(tmp_path / "j"))
    back = text.read_captures(spark, str(tmp_path / "j"))
    assert {(r["urlkey"], r["url"], r["length"]) for r in back.collect()} == {(r["urlkey"], r["url"], r["length"]) for r in df.collect()}
    assert all(r["source"].startswith("part-") for r in back.collect())


def test_secondary_index_and_paths(spark, tmp_path):
    (tmp_path / "x.idx").write_text("a 1\tp1\t0\t10\t1\nb 1\tp1\t10\t10\t2\nc 1\tp1\t20\t5\t3\nd 1\tp2\t0\t7\t4\ne 1\tp2\t9\t7\t5\nbad\tp2\n")
    (tmp_path / "x.loc").write_text("p1\t/one\t/two\np2\t/three\nalone\n")
    blocks = text.read_blocks(spark, str(tmp_path / "x.idx"))
    assert blocks.count() == 5
    got = sorted((r["part"], r["offset"], r["length"], r["blocks"]) for r in text.coalesced_blocks(blocks, 2).collect())
    assert got == [("p1", 0, 20, 2), ("p1", 20, 5, 1), ("p2", 0, 7, 1), ("p2", 9, 7, 1)]
    paths = text.read_paths(spark, str(tmp_path / "x.loc"))
    df = spark.createDataFrame([("p1",), ("p2",), ("p3",), (None,)], "filename string")
    assert {(r["filename"], r["path"]) for r in text.with_path(df, paths).collect()} == {("p1", "/one"), ("p2", "/three"), ("p3", None), (None, None)}


def test_rules_are_read(spark, tmp_path):
    (tmp_path / "r.aclj").write_text('com,example)/a - {"access": "block"}\n\ncom,example)/ - {"access": "allow", "user": "x", "newer": {"years": 1}}\n')
    rules = text.read_rules(spark, str(tmp_path / "r.aclj"))
    assert rules == [access.Rule("com,example)/a", "block"), access.Rule("com,example)/", "allow", "x", newer={"years": 1})]


def warc(kind, uri, body, more=(), content="application/http; msgtype=response"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{kind}-{uri}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2014-01-06T03:04:05Z", f"Content-Type: {content}", *more, f"Content-Length: {len(body)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Long: a\r\n b\r\n\r\n<p>hi</p>"


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("arc")
    parts = [
        warc("warcinfo", "", b"software: x", content="application/warc-fields"), warc("response", "http://Example.com/A/", HTTP), warc("request", "http://Example.com/A/", b"GET /A/ HTTP/1.1\r\nReferer: http://r/\r\n\r\n", ["WARC-Concurrent-To: <response-http://Example.com/A/>"], "application/http; msgtype=request"),
        warc("revisit", "http://example.com/b", b"HTTP/1.1 200 OK\r\n\r\n", ["WARC-Payload-Digest: sha1:ABC"]), warc("metadata", "http://example.com/m", b"a: b", content="text/anvl"), warc("resource", "urn:X:log", b"text", content="text/plain"),
    ]
    (folder / "plain.warc").write_bytes(b"".join(parts))
    (folder / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (folder / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, parts))[:-40])
    (folder / "empty.warc").write_bytes(b"")
    body = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\nno"
    (folder / "old.arc").write_bytes(b"filedesc://x 0.0.0.0 20140101000000 text/plain 3\n1 0\n" + f"http://example.com/old 1.2.3.4 20140216050221 text/html {len(body)}\n".encode() + body + b"\n")
    return folder, parts


def test_records_and_captures(spark, archive):
    folder, parts = archive
    records = archives.read_records(spark, str(folder))
    by = {}
    for r in records.collect():
        by.setdefault(r["filename"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"plain.warc": 6, "packed.warc.gz": 6, "cut.warc.gz": 5, "old.arc": 2}
    at = 0
    for row, part in zip(sorted(by["plain.warc"], key=lambda r: r["offset"]), parts, strict=True):
        assert (row["offset"], row["length"]) == (at, len(part) - 4)
        at += len(part)
    for row, part in zip(sorted(by["packed.warc.gz"], key=lambda r: r["offset"]), parts, strict=True):
        assert row["length"] == len(gzip.compress(part))
    found = {(r["filename"], r["urlkey"]): r for r in archives.captures_of(records).collect()}
    a = found["packed.warc.gz", "com,example)/a"]
    assert (a["timestamp"], a["mime"], a["status"], a["digest"]) == ("20140106030405", "text/html", "200", base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode())
    b = found["plain.warc", "com,example)/b"]
    assert (b["mime"], b["digest"]) == ("warc/revisit", "ABC")
    assert found["plain.warc", "urn:x:log"]["status"] == "-" and ("plain.warc", "com,example)/m") not in found
    old = found["old.arc", "com,example)/old"]
    assert (old["timestamp"], old["status"], old["mime"]) == ("20140216050221", "404", "text/html")
    pair = archives.paired(records.where("filename = 'plain.warc'")).where("record_type = 'response'").collect()[0]
    assert (pair["request_method"], pair["request_referer"]) == ("GET", "http://r/")
    assert captures.match(archives.captures_of(records), "example.com/*").count() == 7


def test_base32(spark):
    values = [b"", b"a", b"\x00" * 30, bytes(range(256))]
    got = spark.createDataFrame([(v,) for v in values], "p binary").select(archives.base32_sha1(F.col("p"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(v).digest()).decode() for v in values]
    assert got[0][0] == ingest.EMPTY_DIGEST
