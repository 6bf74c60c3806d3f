"""Streams against the batch operators over the same rows."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans import views
from tidemark.streaming.ingest import Ingest, archive_stream, distinct_within, event_time, session_counts, windowed

ROWS = "urlkey string, timestamp string, url string, mime string, digest string, filename string, seq long"


def row(k, digest, url=None, mime="text/html"):
    u = url or f"http://e/{k}"
    return (u, f"202401{k + 1:02d}000000", u, mime, digest, "f", k)


def batches(spark, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_revisits_over_batches(spark, tmp_path):
    parts = [[row(0, "a"), row(1, "a"), row(2, "b"), row(3, None), row(4, "")], [row(5, "a"), row(6, None), row(7, "c", mime="warc/revisit"), row(8, "c")]]
    ing = Ingest(str(tmp_path / "out"))
    for k, part in enumerate(parts):
        ing.write(spark.createDataFrame(part, ROWS), k)
    ing.write(spark.createDataFrame(parts[1], ROWS), 1)  # a batch run again changes nothing
    got = {r["seq"]: r for r in ing.captures(spark).collect()}
    assert len(got) == 9
    assert {k for k, r in got.items() if r["refers_url"]} == {1, 5}
    assert (got[5]["mime"], got[5]["refers_url"], got[5]["refers_timestamp"]) == ("warc/revisit", "http://e/0", "20240101000000")


@pytest.mark.parametrize(("policy", "kept"), [("skip", {0, 2, 3}), ("keep", {0, 1, 2, 3, 4})])
def test_policies(spark, tmp_path, policy, kept):
    stream = batches(spark, tmp_path, [[row(0, "a", "u"), row(1, "b", "u"), row(2, "c", "v")], [row(3, "d", "w"), row(4, "e", "u")]])
    ing = Ingest(str(tmp_path / "out"), policy)
    ing.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert {r["seq"] for r in ing.captures(spark).collect()} == kept or policy == "skip" and ing.captures(spark).count() == 3


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """Seven batches against a model; what one of them opens is bounded by its keys and by the batches since the last merge."""
    import random

    r = random.Random(3)
    ing = Ingest(str(tmp_path / "out"), buckets=16, merged_every=3)
    seen, want = {}, {}
    for k in range(8):
        part = [row(20, f"d{r.randrange(60)}", f"http://e/{k}-{n}")[:6] + (k * 100 + n,) for n in range(12)]
        for x in sorted(part, key=lambda x: x[6]):
            want[x[6]] = seen.setdefault(x[4], x[2]) if x[4] in seen else None
            seen.setdefault(x[4], x[2])
        ing.write(spark.createDataFrame(part, ROWS), k)
        if k in (3, 5):  # an attempt that is made again
            ing.write(spark.createDataFrame(part, ROWS), k)
    got = {x["seq"]: x["refers_url"] for x in ing.captures(spark).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 20
    opened = ing._seen(spark, 8, [5]).inputFiles()
    assert opened and all("bucket=5/" in f for f in opened) and len(opened) <= 3
    assert len(ing._seen(spark, 8).inputFiles()) > len(opened)
    assert sorted(p.name for p in (tmp_path / "out" / "merged").iterdir()) == ["batch=3", "batch=6"]


def test_unknown_policy():
    with pytest.raises(ValueError, match="policy"):
        Ingest("x", "maybe")


def stream_of(spark, sf, tmp_path):
    views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))


def run(stream, tmp_path, spark):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "o")).collect()


def test_sessions_that_have_closed(spark, sf, tmp_path):
    stream = event_time(stream_of(spark, sf, tmp_path), "ts", "1 hour")
    got = {(r["user_id"], r["start"], r["captures"]) for r in run(session_counts(stream, "ts", "user_id", "1 hour"), tmp_path, spark)}
    e = spark.read.parquet(str(tmp_path / "ev"))
    top = e.agg(F.max("ts")).first()[0]
    whole = ingest.sessions(e, "user_id", "ts", 3600).collect()
    assert got == {(r["user_id"], r["start"], r["events"]) for r in whole if (top - r["end"]).total_seconds() >= 2 * 3600}


def test_windows_that_have_closed(spark, sf, tmp_path):
    stream = event_time(stream_of(spark, sf, tmp_path), "ts", "1 hour")
    got = run(windowed(stream, "ts", ["event_type"], "1 day"), tmp_path, spark)
    e = spark.read.parquet(str(tmp_path / "ev"))
    top = e.agg(F.max("ts")).first()[0]
    want = {(r["d"], r["event_type"], r["n"]) for r in e.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect() if (top - r["d"]).total_seconds() >= 25 * 3600}
    assert {(r["start"], r["event_type"], r["captures"]) for r in got} == want


def test_distinct_within_the_watermark(spark, sf, tmp_path):
    stream = event_time(stream_of(spark, sf, tmp_path), "ts", "1 hour")
    got = run(distinct_within(stream, ["user_id", "event_type"]).select("user_id", "event_type"), tmp_path, spark)
    assert len(got) == len({(r["user_id"], r["event_type"]) for r in got}) > 0


def test_archives_as_they_arrive(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nsame"
    folder = tmp_path / "arcs"
    folder.mkdir()
    record = lambda u: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{u}>\r\nWARC-Target-URI: http://e/{u}\r\nWARC-Date: 2024-01-0{u}T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    ing = Ingest(str(tmp_path / "out"))
    for u in (1, 2):
        (folder / f"{u}.warc.gz").write_bytes(gzip.compress(record(u)))
        ing.start(archive_stream(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
    got = {r["url"]: r for r in ing.captures(spark).collect()}
    assert got["http://e/1"]["mime"] == "text/html" and got["http://e/2"]["refers_url"] == "http://e/1" and len(got) == 2


def test_running_sums_over_slices(spark):
    from tidemark.operators.ordering import with_running

    rows = [("hot", k, k % 7) for k in range(4000)] + [(f"k{k % 50}", k, 1) for k in range(400)] + [(None, k, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "key string, seq long, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["key"], r["seq"]): r["_running"] for r in with_running(df, F.col("n"), ["key"], F.col("seq")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = {}, {}
    for key, seq, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[key, seq] = sums.get(key, 0)
        sums[key] = want[key, seq] + n
    assert got == want
