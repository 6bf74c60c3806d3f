"""State by key with expiry in event time, over batches and after a restart."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cookies import cookies_for
from tidemark.streaming import state


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(seconds):
    return f"2024-01-01 00:{seconds // 60:02d}:{seconds % 60:02d}"


def feed(spark, folder, schema, parts):
    """A stream that takes one part a batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drain(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_pending_counters_end_in_event_time(rocks, tmp_path):
    schema = "k string, t string, c int"
    parts = [[("a", at(0), 1), ("a", at(0), 1), ("b", at(1), 1), (None, at(1), 1)], [("a", at(10), -1), ("b", at(20), 0)], [("c", at(60), 1), ("c", at(60), None)]]
    later = [[("a", at(100), 1), ("z", at(101), 1)], [("z", at(300), 0)]]
    given = feed(rocks, tmp_path / "in", schema, parts).select("k", F.to_timestamp("t").alias("t"), "c")
    drain(state.pending(given, "k", "t", "c"), tmp_path / "out", tmp_path / "cp")
    given = feed(rocks, tmp_path / "in", schema, [[], [], [], *later]).select("k", F.to_timestamp("t").alias("t"), "c")
    drain(state.pending(given, "k", "t", "c"), tmp_path / "out", tmp_path / "cp")  # started again, with what it held
    got = [(r["key"], r["pending"], r["at"].strftime("%M:%S")) for r in rocks.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(x for x in got if x[0] == "a") == [("a", 0, "00:40"), ("a", 0, "02:10"), ("a", 1, "00:10"), ("a", 1, "01:40"), ("a", 2, "00:00")]
    assert sorted(x for x in got if x[0] == "b") == [("b", 0, "00:50"), ("b", 1, "00:01"), ("b", 1, "00:20")] and ("c", 1, "01:00") in got and ("c", 0, "01:30") in got


def test_cookies_over_streams(rocks, tmp_path):
    sets, asks = "session string, domain string, name string, value string, set_at string", "request_id long, session string, host string, at string, cookie string"
    cookies = [[("s", ".Example.com", "a", "1", at(0)), ("s", "b.example.com", "x", "9", at(0)), ("q", "example.com", "a", "7", at(0))], [("s", "example.com", "a", "2", at(50))], [], [("s", "example.com", "late", "3", at(400))]]
    requests = [[(1, "s", "www.example.com", at(10), None)], [(2, "s", "a.b.example.com", at(60), "y=1"), (3, "s", "a.b.example.com", at(61), "a=5"), (4, "s", "example.com", at(62), None)], [(5, "s", "www.example.com", at(170), None), (6, "s", "www.example.com", at(171), None), (8, "q", "z.example.com", at(100), None)], [(7, "s", "www.example.com", at(400), None)]]
    all_cookies = rocks.createDataFrame([x for p in cookies for x in p], sets).withColumn("set_at", F.to_timestamp("set_at"))
    all_requests = rocks.createDataFrame([x for p in requests for x in p], asks).withColumn("at", F.to_timestamp("at"))
    given = feed(rocks, tmp_path / "c", sets, cookies).withColumn("set_at", F.to_timestamp("set_at"))
    asked = feed(rocks, tmp_path / "r", asks, requests).withColumn("at", F.to_timestamp("at"))
    drain(state.cookie_cache(asked, given), tmp_path / "out", tmp_path / "cp")
    got = sorted(tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).select("request_id", "domain", "name", "value").collect())
    assert got == sorted(tuple(r) for r in cookies_for(all_requests, all_cookies).select("request_id", "domain", "name", "value").collect())
    assert (1, "example.com", "a", "1") in got and (2, "b.example.com", "x", "9") in got and not any(r[0] in (4, 6) for r in got)


def test_another_store_is_refused(spark):
    stream = spark.readStream.format("rate").load()
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        with pytest.raises(ValueError, match="RocksDB"):
            state.pending(stream, "value", "timestamp", "value")
