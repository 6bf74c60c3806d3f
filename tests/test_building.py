"""Index building, block reading and resource loading on small files."""

import gzip
import time
import zlib

import pytest

from tidemark.operators import building, captures
from tidemark.plans import views
from tidemark.plans.query import CaptureQuery
from tidemark.sources import archives, text
from tidemark.sources import blocks as blocks_of


def test_sorted_index_is_pruned(spark, sf, tmp_path):
    events = views.events(spark, sf)
    path = str(tmp_path / "index")
    building.write_index(events, path, files=4)
    index = building.read_index(spark, path)
    assert index.count() == events.count()
    rows = [tuple(r) for r in index.select(*captures.ORDER).collect()]
    assert sorted(rows) == sorted(tuple(r) for r in events.select(*captures.ORDER).collect())
    ends = index.selectExpr("input_file_name() as f", "struct(urlkey, timestamp, seq) as k").groupBy("f").agg({"k": "min"}).count()
    assert 2 <= ends <= 4
    plan = captures.match(index, "u12.example.com", "host")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(urlkey" in plan
    more = events.limit(10)
    merged = str(tmp_path / "merged")
    building.add_to_index(spark, path, more, merged)
    assert building.read_index(spark, merged).count() == events.count()
    building.write_index(events, str(tmp_path / "each"), per_input=True)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "each")).select("index_of").distinct().collect()} == {f"arc-{k}.warc.gz" for k in range(4)}


@pytest.mark.parametrize("layout", [9, 11, "cdxj"])
def test_text_index_round_trip(spark, sf, tmp_path, layout):
    events = views.events(spark, sf).limit(200)
    path = str(tmp_path / "text")
    building.write_text_index(events, path, layout, files=2)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert len(lines) == events.count() + (layout in building.HEADERS) and sum(x.startswith(" CDX N b a") for x in lines) == (layout in building.HEADERS)
    back = text.read_captures(spark, path)
    keys = ("urlkey", "timestamp", "url", "mime", "status", "digest", "offset", "filename")
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, events.select(*keys).collect()))
    moved = str(tmp_path / "moved")
    building.migrate(spark, path, moved)
    assert text.read_captures(spark, moved).count() == events.count()


def test_blocks_are_read_by_range(spark, tmp_path):
    lines = [f"com,example)/{k:03d} 2014{k:010d} {{\"url\": \"http://example.com/{k:03d}\", \"status\": \"200\"}}" for k in range(90)]
    parts, index, at = b"", [], 0
    for k in range(0, 90, 30):
        block = gzip.compress("\n".join(lines[k : k + 30]).encode() + b"\n")
        index.append((lines[k].rsplit(" {", 1)[0], "p", at, len(block)))
        parts, at = parts + block, at + len(block)
    (tmp_path / "p.gz").write_bytes(parts)
    blocks = spark.createDataFrame(index, "first_line_key string, part string, offset long, length long")
    paths = spark.createDataFrame([("p", 0, str(tmp_path / "gone.gz")), ("p", 1, str(tmp_path / "p.gz"))], "name string, rank int, path string")
    got = blocks_of.load_blocks(blocks.where("offset > 0"), paths)
    assert sorted(r["urlkey"] for r in got.collect()) == [f"com,example)/{k:03d}" for k in range(30, 90)]
    lost = spark.createDataFrame([("p", 0, str(tmp_path / "gone.gz"))], "name string, rank int, path string")
    assert blocks_of.load_blocks(blocks, lost).count() == 0
    with pytest.raises(Exception, match="gone.gz|No such file"):
        blocks_of.load_blocks(blocks, lost, "error").count()


def test_archives_are_read_in_linear_time():
    import random

    r = random.Random(1)
    record = lambda k: (b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://e/%d\r\nContent-Length: 60000\r\n\r\n" % k) + r.randbytes(60000) + b"\r\n\r\n"
    one = [gzip.compress(record(k), 1) for k in range(500)]
    data = b"".join(one)
    began = time.perf_counter()
    found = list(archives.records_of(data))
    assert time.perf_counter() - began < 5 and len(data) > 29_000_000
    assert [x["length"] for x in found] == [len(x) for x in one] and found[7]["payload"] == zlib.decompress(one[7], 31)[-60004:-4]
    assert [x["offset"] for x in archives.records_of(data[: sum(map(len, one[:3]))])] == [0, len(one[0]), len(one[0]) + len(one[1])]


def test_fuzzy_keeps_parameters(spark):
    q = CaptureQuery.parse({"url": "http://e.com/?a=1&_=123", "from": "2014", "to": "2015", "resolveRevisits": "1", "collapseTime": "8", "closest": "2014", "filter": "=status:200"})
    near = q.fuzzied()
    assert (near.start, near.end, near.resolve_revisits, near.collapse_digits) == ("2014", "2015", True, 8)
    assert near.closest is None and not near.reverse and near.match_type == "prefix" and near.url == "http://e.com" and near.filters == ("urlkey:",)


def test_private_headers(spark):
    from pyspark.sql import functions as F

    pair = "transform(split('Set-Cookie=a=b; HttpOnly|Cookie=x|set-cookie=c=d|ETag=e', '[|]'), x -> struct(split(x, '=')[0] as name, substring(x, instr(x, '=') + 1) as value))"
    row = spark.range(1).select(building.without_private_cookies(F.expr(pair)).alias("a"), building.without_headers(F.expr(pair), ["etag", "COOKIE"]).alias("b")).first()
    assert [x["value"] for x in row["a"]] == ["c=d", "e"] and [x["value"] for x in row["b"]] == ["a=b; HttpOnly", "c=d"]


def test_resources_without_an_origin_are_spread(spark):
    """Captures that ask for no record of an original, or for one without a number, fill no single task, and load the same."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).selectExpr(
            "concat('com,example)/', id) urlkey", "'2024' timestamp", "'f' filename", "if(id % 10 = 1, '-', cast(id as string)) offset", "if(id % 10 = 0, 'warc/revisit', 'text/html') mime",
            "if(id % 10 = 0 and id > 0, 'f', '-') orig_filename", "if(id % 10 = 0 and id > 0, cast(id - 8 as string), '-') orig_offset", "if(id % 10 = 3, 'block', 'allow') access", "id",
        )
        records = spark.range(-5, 2000).selectExpr("'f' filename", "id offset", "'HTTP/1.1 200 OK' status_line", "array(struct('A' name, 'b' value)) headers", "cast(cast(id as string) as binary) payload")
        got = building.load_resources(rows, records).selectExpr("id", "answer", "cast(payload as string) body", "spark_partition_id() part").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {k: (451, None) if k % 10 == 3 else (404, None) if k % 10 == 1 or k == 0 else (200, str(k - 8 if k % 10 == 0 else k)) for k in range(2000)}
    assert {r["id"]: (r["answer"], r["body"]) for r in got} == want and len(got) == 2000
    assert max(sum(r["part"] == p for r in got) for p in {r["part"] for r in got}) < 800


def test_small_archive_files_share_tasks(spark, tmp_path):
    """Files far below a task's bytes are read several to a task, whole; split files still get tasks by their bytes."""
    from tidemark.sources import writing

    path, few = str(tmp_path / "files"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = spark.range(60).selectExpr(
        "'c' collection", "id seq", "'resource' record_type", "concat('<', id, '>') record_id", "concat('http://e/', id) target_uri", "'20240101000000' timestamp",
        "cast(null as string) status_line", "cast(null as array<struct<name:string,value:string>>) headers", "cast(repeat(cast(id as string), 50) as binary) payload",
    )
    assert writing.write_archives(records, path, 1, False).count() == 60
    for split, least in ((archives.SPLIT, 1), (64, 60)):
        read = archives.read_records(spark, path, split)
        assert least <= read.rdd.getNumPartitions() and (split == 64 or read.rdd.getNumPartitions() <= few)
        assert sorted((r["record_id"], r["payload"].decode()) for r in read.collect()) == sorted((f"<{k}>", str(k) * 50) for k in range(60))
