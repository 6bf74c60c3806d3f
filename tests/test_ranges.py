"""Range scans of sorted text and block indexes: what they return, and how many bytes they open."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.urls import BadRequest, key_range
from tidemark.operators import building, captures
from tidemark.plans import views
from tidemark.plans.query import CaptureQuery
from tidemark.sources import blocks, ranges, store, text


@pytest.fixture(scope="module")
def lines():
    r = random.Random(5)
    out = [" CDX N b a m s k r M S V g"]
    for host in range(300):
        for k in range(r.choice([0, 1, 3, 40])):
            pad = "x" * r.choice([1, 5, 30, 9000 if r.random() < 0.02 else 2])
            out.append(f'com,h{host:03d})/{k % 7} 2014{k:010d} {{"url": "http://h{host:03d}.com/{k % 7}?{pad}", "status": "200"}}')
    return sorted(out)


def test_bisection_finds_every_line(tmp_path, lines, monkeypatch):
    for block, part in ((64, lines), (8192, lines), (64, lines[:1]), (64, []), (8, ["a 1", "a 2", "b 3"])):
        monkeypatch.setattr(ranges, "BLOCK", block)
        (tmp_path / "i").write_text("".join(x + "\n" for x in part))
        with store.Opened(str(tmp_path / "i")) as f:
            starts = [0]
            for x in part:
                starts.append(starts[-1] + len(x) + 1)
            for key in {"", "a", "b", "zzz", "com,h", *(x.split(" ")[0] for x in part[::11]), *(x.split(" ")[0] + "!" for x in part[::17])}:
                n = sum(x.split(" ")[0] < key for x in part)
                assert ranges.bisected(f.read, f.size, key.encode()) == starts[n]
                assert ranges.before(f.read, starts[n]) == starts[max(0, n - 1)]


def test_pieces_meet_every_line_once(tmp_path, lines):
    body = "".join(x + "\n" for x in lines)
    for name, data in (("a", body.encode()), ("b", body.encode()[:-1]), ("c", body.replace("\n", "\r\n").encode()), ("d", gzip.compress(body.encode())), ("e", gzip.compress(body[:5000].encode()) + gzip.compress(body[5000:].encode()))):
        (tmp_path / name).write_bytes(data)
        for piece in (1000, 1 << 20):
            cut, _ = ranges.pieces(str(tmp_path / name), None, None, 0, piece)
            got = [r for p in cut for b in ranges.lines_of(p) for r in b.to_pylist()]
            assert [r["line"] for r in got] == lines and [r["urlkey"] for r in got] == [x.split(" ")[0] for x in lines]
            assert len(cut) > 1 or piece > 1000 or name in "de"


def test_a_range_opens_its_bytes_alone(spark, tmp_path):
    with open(tmp_path / "big.cdxj", "w") as f:
        for k in range(200_000):
            f.write(f'com,h{k // 100:05d})/{k % 100:02d} 20140101000000 {{"url": "http://h{k // 100}.com/{k % 100}", "status": "200", "digest": "{"D" * 60}"}}\n')
    path = str(tmp_path / "big.cdxj")
    size = store.listed(path)[0][1]
    found, searched = ranges.pieces(path, *(k.encode() for k in key_range("h01234.com", "host")), 0, ranges.PIECE)
    assert searched < 64 * ranges.BLOCK and sum(p.high - p.low for p in found) < 100 * 200 and size > 20_000_000
    df = text.TextIndex(spark, path)
    for url, match, n in (("h01234.com", "host", 100), ("h01234.com/5*", "prefix", 10), ("h01234.com/05", "exact", 1), ("h09999.com", "host", 0)):
        asked = captures.match(df, url, match)
        assert asked.count() == n
        assert asked.select("line" if "line" in asked.columns else "seq").rdd.getNumPartitions() == 1
    both = captures.match(df, "h01234.com", "host").unionByName(captures.match(df, "h00007.com", "host"))
    assert both.count() == 200
    assert text.TextIndex(spark, path).scan("com,h01234", "com,h01236").count() == 200
    began = time.perf_counter()
    captures.match(df, "h01234.com", "host").collect()
    one = time.perf_counter() - began
    began = time.perf_counter()
    captures.match(text.read_captures(spark, path), "h01234.com", "host").collect()
    assert one < max(4, 3 * (time.perf_counter() - began))


def test_scan_equals_filter(spark, sf, tmp_path):
    events = views.events(spark, sf)
    building.write_text_index(events, str(tmp_path / "i"), "cdxj", 3)
    df = text.TextIndex(spark, str(tmp_path / "i"))
    assert df.scan().count() == events.count() and set(df.scan().columns) == set(text.read_captures(spark, str(tmp_path / "i")).columns)
    for url, match in (("u12.example.com", "host"), ("*.example.com", "exact"), ("http://u1*", "exact"), ("u12.example.com/view", "exact"), ("nowhere.org", "domain")):
        key = lambda x: sorted((r["urlkey"], r["timestamp"], r["url"], r["offset"]) for r in captures.match(x, url, match).select("urlkey", "timestamp", "url", "offset").collect())  # noqa: B023, E731
        assert key(df) == key(events)
    pattern = str(tmp_path / "i" / "part-*.txt")
    assert text.TextIndex(spark, pattern).scan().count() == events.count()
    with pytest.raises(FileNotFoundError):
        text.TextIndex(spark, str(tmp_path / "none")).scan()
    (tmp_path / "whole.gz").write_bytes(gzip.compress(b"".join(open(x, "rb").read() for x, _ in store.listed(pattern))))
    packed = text.TextIndex(spark, str(tmp_path / "whole.gz"))
    assert packed.scan("com,example,u12)/", "com,example,u12*").count() == captures.match(events, "u12.example.com", "host").count()
    q = CaptureQuery.parse({"url": "u12.example.com", "matchType": "host", "limit": "0"})
    assert q.run({"a": df, "b": packed}).count() == 2 * q.run(events).count() == 2 * q.run(df).count()


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    return blocks.write_block_index(views.events(spark, sf), str(tmp_path_factory.mktemp("blocks")), lines=20, parts=3)


def test_block_index_ranges(spark, sf, index):
    events = views.events(spark, sf)
    shown = [r["first_line_key"] for r in index.blocks().orderBy("lineno").collect()]
    assert shown == sorted(shown) and len(shown) == -(-events.count() // 20)
    assert index.scan().count() == events.count()
    for url, match in (("u12.example.com", "host"), ("*.example.com", "exact"), ("u3.example.com/view", "exact"), ("nowhere.org", "host"), ("aaa.com", "host")):
        low, high = key_range(url.removeprefix("*."), "domain" if url.startswith("*.") else match)
        want = sorted((r["urlkey"], r["timestamp"], r["offset"]) for r in captures.match(events, url, match).collect())
        got = sorted((r["urlkey"], r["timestamp"], r["offset"]) for r in index.scan(low, high).collect())
        assert got == want
    touched = index.blocks(*key_range("u12.example.com", "host")).count()
    assert 1 <= touched <= events.where("urlkey like 'com,example,u12)%'").count() // 20 + 3


def test_pages_through_the_query(spark, sf, index):
    events = views.events(spark, sf)
    asked = {"url": "*.example.com", "pageSize": "4", "allowFuzzy": "0", "limit": "0"}
    info = CaptureQuery.parse({**asked, "showNumPages": "1"}).run(index).first()
    blocks_found = index.blocks(*key_range("example.com", "domain")).count()
    assert (info["blocks"], info["pages"], info["pageSize"]) == (blocks_found, -(-blocks_found // 4), 4)
    got = [r["offset"] for k in range(info["pages"]) for r in CaptureQuery.parse({**asked, "page": str(k)}).run(index).collect()]
    assert sorted(got) == sorted(r["offset"] for r in events.select("offset").collect()) and info["pages"] > 3
    assert CaptureQuery.parse({**asked, "page": "0"}).run(index).count() <= 80
    for page in ("-1", str(info["pages"])):
        with pytest.raises(BadRequest):
            CaptureQuery.parse({**asked, "page": page}).run(index)
    with pytest.raises(BadRequest):
        CaptureQuery.parse({**asked, "page": "x"})
    with pytest.raises(BadRequest):
        CaptureQuery.parse({**asked, "page": "0"}).run(events)
    nothing = CaptureQuery.parse({"url": "u12.example.com/none", "showNumPages": "1"}).run(index).first()
    assert (nothing["pages"], nothing["blocks"]) == (0, 0)
    assert json.loads(index.page_count(*key_range("u12.example.com", "host")).toJSON().first())["pages"] == 1


def test_a_lost_part_and_its_replica(spark, sf, index, tmp_path):
    events = views.events(spark, sf)
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"com,x)/ 2014 {}\n")[:-9])
    places = open(index.places).read()
    (tmp_path / "loc").write_text("".join(f"{n}\t{tmp_path}/gone.gz\t{tmp_path}/cut.gz\t{p}\n" for n, p in (x.split("\t") for x in places.split("\n") if x)))
    there = blocks.BlockIndex(spark, index.summary, str(tmp_path / "loc"))
    assert there.scan().count() == events.count()
    (tmp_path / "bad").write_text("".join(f"{x.split(chr(9))[0]}\t{tmp_path}/gone.gz\n" for x in places.split("\n") if x))
    lost = blocks.BlockIndex(spark, index.summary, str(tmp_path / "bad"))
    assert lost.scan().count() == 0
    with pytest.raises(Exception, match="gone.gz"):
        lost.scan(mode="fail").where(F.length("urlkey") > 0).count()
