"""Packed collections, read where they are."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import captures as ops
from tidemark.sources import archives, packed, resources, store


def warc(k, body):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nWARC-Target-URI: http://e.com/{k}\r\nWARC-Date: 2014-01-06T03:04:05Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("packed")
    loose = base / "loose"
    loose.mkdir()
    for p, method in (("one", zipfile.ZIP_STORED), ("two", zipfile.ZIP_DEFLATED)):
        lines = []
        with zipfile.ZipFile(base / f"{p}.wacz", "w") as z:
            z.writestr("datapackage.json", "{}")
            for a in ("data.warc.gz", "more.warc.gz"):
                at, whole = 0, b""
                for k in range(20):
                    record = warc(f"{p}-{a}-{k}", f"{p} {a} {k} ".encode() * 40)
                    lines.append(f'com,e)/{p}-{a}-{k} 20140106030405 {{"url": "http://e.com/{p}-{a}-{k}", "mime": "text/html", "status": "200", "digest": "D{p}{a}{k}", "length": "{len(record)}", "offset": "{at}", "filename": "{a}"}}')
                    whole, at = whole + record, at + len(record)
                z.writestr(zipfile.ZipInfo(f"archive/{a}"), whole)
                (loose / f"{p}-{a}").write_bytes(whole)
            text = "".join(x + "\n" for x in sorted(lines)).encode()
            z.writestr("indexes/index.cdx" + (".gz" if p == "one" else ""), gzip.compress(text) if p == "one" else text, compress_type=method)
    return base


def test_entries_are_those_of_the_directory(folder, tmp_path):
    for p in ("one", "two"):
        with store.Opened(str(folder / f"{p}.wacz")) as f, zipfile.ZipFile(folder / f"{p}.wacz") as z:
            found = list(packed.entries(f))
            assert [(n, m, c, s) for n, m, _, c, s in found] == [(i.filename, i.compress_type, i.compress_size, i.file_size) for i in z.infolist()]
            assert all(f.read(o, c) == z.read(n) for n, m, o, c, _ in found if m == 0)
            assert f.taken < f.size + 70_000 * 2
    with zipfile.ZipFile(tmp_path / "large.wacz", "w") as z, z.open("a/b.warc", "w", force_zip64=True) as out:
        out.write(b"x" * 1000)
    with store.Opened(str(tmp_path / "large.wacz")) as f:
        assert [(n, c, s) for n, _, _, c, s in packed.entries(f)] == [("a/b.warc", 1000, 1000)]
    (tmp_path / "no.wacz").write_bytes(b"nothing")
    with store.Opened(str(tmp_path / "no.wacz")) as f, pytest.raises(ValueError, match="no directory"):
        list(packed.entries(f))


def test_captures_and_records_are_those_of_the_parts(spark, folder):
    path = str(folder / "*.wacz")
    found = packed.packed_captures(spark, path)
    assert found.count() == 80 and {r[0] for r in found.select("filename").distinct().collect()} == {f"{p}-{k}.warc.gz" for p in ("one", "two") for k in (0, 1)}
    assert ops.match(found, "e.com/one-data.warc.gz-3").count() == 1
    key = lambda df: sorted((r["record_id"], r["offset"], bytes(r["payload"])) for r in df.collect())
    for split in (500, 1 << 20):
        assert key(packed.packed_records(spark, path, split)) == key(archives.read_records(spark, str(folder / "loose")))
    places = packed.packed_archives(packed.read_entries(spark, path))
    loaded = resources.fetch(found, places).select("url", "answer", F.col("payload").cast("string").alias("body")).collect()
    assert len(loaded) == 80 and all(r["answer"] == 200 and r["body"].startswith(r["url"].split("/")[-1].replace("-", " ")) for r in loaded)
    assert packed.packed_captures(spark, str(folder / "one.wacz")).count() == 40


def test_deflated_archives_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", "x" * 1000)
    with pytest.raises(Exception, match="deflated inside"):
        packed.packed_records(spark, str(tmp_path / "d.wacz")).collect()
    assert packed.packed_captures(spark, str(tmp_path / "d.wacz")).count() == 0
