"""Captures derived from the standard tables, alike in Spark and in SQL, so that operators can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture for each event: every fifth is a revisit, errors are 404s, digests repeat within a user."""
    e = table(spark, sf_dir, "events")
    user, kind, text = F.col("user_id").cast("string"), F.col("event_type"), lambda c: c.cast("string")
    return e.select(
        F.concat(F.lit("com,example,u"), user, F.lit(")/"), kind).alias("urlkey"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"),
        F.concat(F.lit("http://u"), user, F.lit(".example.com/"), kind).alias("url"), F.when(F.col("event_id") % 5 == 0, "warc/revisit").otherwise("text/html").alias("mime"),
        F.when(kind == "error", "404").otherwise("200").alias("status"), F.concat(F.lit("D"), user, F.lit("_"), text(F.col("event_id") % 3)).alias("digest"), F.lit("-").alias("redirect"), F.lit("-").alias("robotflags"),
        text(F.col("event_id") % 900 + 100).alias("length"), text(F.col("event_id")).alias("offset"), F.concat(F.lit("arc-"), text(F.col("event_id") % 4), F.lit(".warc.gz")).alias("filename"), F.col("event_id").alias("seq"),
    )


EVENTS = """
SELECT 'com,example,u' || user_id || ')/' || event_type AS urlkey, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'http://u' || user_id || '.example.com/' || event_type AS url,
  CASE WHEN event_id % 5 = 0 THEN 'warc/revisit' ELSE 'text/html' END AS mime, CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS status,
  'D' || user_id || '_' || (event_id % 3) AS digest, '-' AS redirect, '-' AS robotflags, CAST(event_id % 900 + 100 AS VARCHAR) AS length, CAST(event_id AS VARCHAR) AS "offset",
  'arc-' || (event_id % 4) || '.warc.gz' AS filename, event_id AS seq
FROM events"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture for each document; digests repeat where texts do."""
    d = table(spark, sf_dir, "documents")
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60), "yyyyMMddHHmmss")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), (F.col("doc_id") % 400).cast("string"))
    return d.select(url.alias("url"), when.alias("timestamp"), F.sha1("text").alias("digest"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("length"), F.col("source").alias("collection"))


DOCUMENTS = """
SELECT 'https://' || source || '.example.com/' || lang || '/' || (doc_id % 400) AS url, strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%Y%m%d%H%M%S') AS timestamp,
  sha1(text) AS digest, doc_id AS seq, n_chars AS length, source AS collection
FROM documents"""

SURT = """
CASE WHEN split_part(lower({0}), '#', 1) = '' THEN '' ELSE
array_to_string(list_reverse(string_split(regexp_replace(split_part(split_part(regexp_replace(split_part(lower({0}), '#', 1), '^[a-z]+://', ''), '/', 1), '?', 1), '^www[0-9]*\\.', ''), '.')), ',') || ')' ||
CASE WHEN rtrim(regexp_extract(regexp_replace(split_part(lower({0}), '#', 1), '^[a-z]+://', ''), '^[^/?]*([^?]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(regexp_replace(split_part(lower({0}), '#', 1), '^[a-z]+://', ''), '^[^/?]*([^?]*)', 1), '/') END ||
CASE WHEN split_part(split_part(lower({0}), '#', 1), '?', 2) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(split_part(split_part(lower({0}), '#', 1), '?', 2), '&')), '&') END END"""


def surt_sql(column: str) -> str:
    return SURT.strip().format(column)
