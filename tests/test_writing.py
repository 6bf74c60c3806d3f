"""Archive files that are written and read again."""

from pyspark.sql import functions as F

from tidemark.sources import archives, writing


def test_archives_round_trip(spark, tmp_path):
    head = "array(named_struct('name', 'Content-Type', 'value', 'text/html'))"
    rows = spark.range(60).selectExpr(
        "concat('c', id % 2) as collection", "id as seq", "'response' as record_type", "concat('<urn:', id, '>') as record_id", "concat('http://e.com/', id % 9) as target_uri", "concat('201401010000', lpad(id, 2, '0')) as timestamp",
        "'HTTP/1.1 200 OK' as status_line", f"{head} as headers", "cast(concat('é body ', id % 20, repeat('x', 1000)) as binary) as payload",
    )
    path = str(tmp_path / "out")
    files = writing.write_archives(rows, path, max_bytes=6_000)
    assert files.agg(F.sum("records")).first()[0] == 60 and files.count() > 4
    back = archives.read_records(spark, path)
    got = {r["record_id"]: r for r in back.collect()}
    assert len(got) == 60 and sum(r["record_type"] == "revisit" for r in got.values()) == 40
    for k in range(60):
        r = got[f"<urn:{k}>"]
        assert (r["record_type"], r["date"], r["headers"][0]["value"]) == ("response" if k < 20 else "revisit", f"2014-01-01T00:00:{k:02d}Z", "text/html")
        assert bytes(r["payload"]) == (f"é body {k % 20}".encode() + b"x" * 1000 if k < 20 else b"")
        assert r["refers_to_uri"] == (None if k < 20 else f"http://e.com/{k % 20 % 9}") and r["refers_to_date"] == (None if k < 20 else f"2014-01-01T00:00:{k % 20:02d}Z")
    index = archives.captures_of(back)
    assert index.count() == 60 and index.where("mime = 'warc/revisit'").count() == 40 and index.select("digest").distinct().count() == 20
    single = writing.write_archives(rows.limit(5), str(tmp_path / "single"), max_bytes=1, revisits=False)
    assert [r["records"] for r in single.collect()] == [1] * 5
    assert writing.write_archives(rows.limit(0), str(tmp_path / "none")).count() == 0
