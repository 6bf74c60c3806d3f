"""Rule lists, stand-in sources, time map headers and domain cookies."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import captures, cookies, rules, timeline
from tidemark.plans import contracts
from tidemark.sources.text import read_rules

RULES = "urlkey string, access string, user string, url string"


def test_rule_list(spark, tmp_path):
    old = spark.createDataFrame([("com,example)/a", "allow", None, "a"), ("com,example)/", "block", "x", "b"), ("com,example)/", "allow", None, "c")], RULES)
    urls = spark.createDataFrame([("http://Example.com/",), (" com,other)/p ",), ("",), ("*,",)], "value string")
    new = rules.imported(urls, "exclude")
    assert {r[0] for r in new.select("urlkey").collect()} == {"com,example)/", "com,other)/p", "*,"}
    assert {r[0] for r in rules.imported(urls, "block", exact=True).select("urlkey").collect()} == {"com,example)/###", "com,other)/p###", "*,###"}
    now = rules.put(old, new)
    assert {(r["urlkey"], r["user"]): r["access"] for r in now.collect()} == {("com,example)/a", None): "allow", ("com,example)/", "x"): "block", ("com,example)/", None): "exclude", ("com,other)/p", None): "exclude", ("*,", None): "exclude"}
    left = rules.remove(now, spark.createDataFrame([("com,example)/", "x")], "urlkey string, user string"))
    assert left.count() == 4
    rules.write(left, str(tmp_path / "list"))
    assert [r.urlkey for r in read_rules(spark, str(tmp_path / "list"))] == ["com,other)/p", "com,example)/a", "com,example)/", "*,"]
    with pytest.raises(ValueError, match="access must be"):
        rules.put(old, spark.createDataFrame([("x", "perhaps", None, "x")], RULES))


def test_first_found(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "id int, v string")
    b = spark.createDataFrame([(1, "c"), (2, "d"), (None, "m")], "id int, v string")
    assert sorted(map(str, captures.first_found([a, b], ["id"]).collect())) == sorted(map(str, [*a.collect(), *b.where("id = 2").collect()]))


def test_timemap_header(spark):
    rows = spark.createDataFrame([("k", "20140102030405", 2), ("k", "20130102030405", 1)], "urlkey string, timestamp string, seq int")
    got = [r["link"] for r in timeline.timemap_header(rows, "http://e/", "/gate", "/map").orderBy("number").collect()]
    assert got == ['</map>; rel="self"; type="application/link-format"; from="Wed, 02 Jan 2013 03:04:05 GMT",', '</gate>; rel="timegate",', '<http://e/>; rel="original",']
    assert timeline.timemap_header(rows.limit(0), "http://e/", "/gate", "/map").orderBy("number").first()["link"] == '</map>; rel="self"; type="application/link-format",'


def test_domain_cookies(spark):
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    asked = spark.createDataFrame([(1, "s", "a.b.example.com", at(100), None), (2, "s", "example.com", at(100), None), (3, "t", "x.example.com", at(100), None), (4, "s", "x.example.com", at(300), "n=1"), (5, "s", "x.example.com", at(100), "n=1")], "request_id int, session string, host string, at timestamp, cookie string")
    known = spark.createDataFrame([("s", ".example.com", "n", "old", at(10)), ("s", ".example.com", "n", "new", at(20)), ("s", "b.example.com", "m", "v", at(90)), ("s", "a.b.example.com", "own", "v", at(90)), ("s", ".example.com", "late", "v", at(200))], "session string, domain string, name string, value string, set_at timestamp")
    got = {tuple(r) for r in cookies.cookies_for(asked, known).collect()}
    assert got == {(1, "example.com", "n", "new"), (1, "b.example.com", "m", "v"), (4, "example.com", "late", "v")}
    assert spark.range(1).select(cookies.parent_domains(F.lit("a.b.co.uk"), 2)).first()[0] == ["b.co.uk"]


@pytest.mark.parametrize("name", ["fuzzy_keeps_clamp", "fuzzy_jquery", "fuzzy_no_groups", "fuzzy_findall"])
def test_fuzzy_queries_find_more_than_a_million(spark, tmp_path, name):
    """No limit cuts what stands in."""
    n = 1_000_001
    events = spark.range(10, n + 10, numPartitions=4).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_705_000_000) + F.col("id") % 1000).alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert contracts.QUERIES[name](spark, str(tmp_path)).count() == n
