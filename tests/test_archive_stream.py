"""Archive files over batches: by size, by silence, again after an attempt cut short, and over lanes."""

import pytest

from tidemark.sources import archives, writing
from tidemark.streaming.archives import ArchiveWriter

ROWS = "collection string, seq long, at string, record_type string, record_id string, target_uri string, timestamp string, status_line string, headers array<struct<name string, value string>>, payload binary"


def record(collection, seq, second, size=900):
    return (collection, seq, f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}", "response", f"<{collection}-{seq}>", f"http://e/{seq}", "20240101000000", "HTTP/1.1 200 OK", [("A", "b")], bytes([65 + seq % 26]) * size)


def names(spark, writer):
    return sorted((r["path"].rsplit("/", 1)[-1], r["records"]) for r in writer.files(spark).collect())


def test_size_and_silence(spark, tmp_path):
    w = ArchiveWriter(str(tmp_path / "out"), max_bytes=5_000, idle_seconds=600, lateness_seconds=0)
    parts = [
        [record("a", k, k) for k in range(3)] + [record("b", 0, 0)], [record("a", k, k) for k in range(3, 9)], [record("c", 0, 700)], [record("b", 1, 701), record("a", 9, 702)],
        [record("b", 2, 1500)], [record(None, 0, 1501), record("x/y", 0, 1502)],
    ]
    for k, part in enumerate(parts):
        w.write(spark.createDataFrame(part, ROWS), k)
        if k in (1, 4):  # cut short, or not known to have ended: run again
            w.write(spark.createDataFrame(part, ROWS), k)
    later = lambda batch: (batch << 20) + 0  # noqa: E731  numbers of a file that a batch opens anew
    assert names(spark, w) == sorted([("a-00000.warc.gz", 5), ("a-00001.warc.gz", 4), ("b-00000.warc.gz", 1), ("c-%05d.warc.gz" % later(2), 1), ("a-%05d.warc.gz" % later(3), 1), ("b-%05d.warc.gz" % later(3), 1)])
    w.finish(spark, len(parts))
    assert {("b-%05d.warc.gz" % later(4), 1), ("%%00-%05d.warc.gz" % later(5), 1), ("x%%2Fy-%05d.warc.gz" % later(5), 1)} <= set(names(spark, w)) and len(names(spark, w)) == 9
    got = archives.read_records(spark, str(tmp_path / "out" / "files"))
    assert sorted(r["record_id"] for r in got.collect()) == sorted(x[4] for p in parts for x in p)
    assert {r["filename"]: r["target_uri"] for r in got.where("filename = 'a-00001.warc.gz'").orderBy("offset").collect()}["a-00001.warc.gz"] == "http://e/8"
    assert not (tmp_path / "out" / "parts" / "batch=0").exists()


def test_a_stream_that_is_started_again(spark, tmp_path):
    w = ArchiveWriter(str(tmp_path / "out"), max_bytes=4_000, lanes=2)
    for k in range(3):
        spark.createDataFrame([record("hot", k * 10 + n, k * 20 + n) for n in range(10)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        w.start(stream, str(tmp_path / "cp")).awaitTermination()
    w.finish(spark, 99)
    got = archives.read_records(spark, str(tmp_path / "out" / "files")).collect()
    assert sorted(r["record_id"] for r in got) == sorted(f"<hot-{k}>" for k in range(30))
    assert {r["filename"].split("-")[0] for r in got} == {"hot~0", "hot~1"} and all(n <= 4 for _, n in names(spark, w))


@pytest.mark.parametrize("size", [1, 10_000_000])
def test_numbers_without_moving_payloads(spark, size):
    df = spark.range(500).selectExpr("if(id % 3 = 0, null, concat('c', id % 2)) as collection", "id as seq", "cast('x' as binary) as record", "cast(100 as long) as length")
    got = writing.numbered(df, size).collect()
    assert len(got) == 500 and len({(r["collection"], r["file_no"]) for r in got}) == (500 if size == 1 else 3)
    assert writing.numbered(df.limit(0), size).count() == 0
