"""Building and keeping up an index: request pairing, dedup policies, writers' text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import surt
from tidemark.operators.captures import FIELDS
from tidemark.operators.fuzzy import nearest
from tidemark.operators.ordering import with_previous, with_running

#: SHA-1 of nothing, in base 32: revisits of it need no payload.
EMPTY_DIGEST = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def join_requests(records: DataFrame) -> DataFrame:
    """Responses with method, request headers and body of the request made with them, if any.

    A pair has one URL, and one record names the other's id as concurrent; which of the two is irrelevant.
    """
    answers = records.where("record_type <> 'request'")
    asks = records.where("record_type = 'request'").select(
        F.col("target_uri").alias("_uri"), F.col("record_id").alias("_id"), F.col("concurrent_to").alias("_to"), F.col("method").alias("request_method"), F.col("referer").alias("request_referer")
    )
    # either end may name the other: both become one equality on the pair's ids
    named = asks.select("_uri", F.explode(F.array_distinct(F.array("_id", "_to"))).alias("_key"), "request_method", "request_referer").where("_key is not null")
    own = answers.withColumn("_keys", F.array_compact(F.array_distinct(F.array("record_id", "concurrent_to"))))
    hits = own.select("record_id", "target_uri", F.explode("_keys").alias("_key")).join(named, "_key").where("target_uri = _uri")
    best = hits.groupBy(F.col("record_id").alias("_of")).agg(F.min(F.struct("request_method", "request_referer")).alias("_r"))
    return own.drop("_keys").join(best, F.col("record_id") == F.col("_of"), "left").select(*answers.columns, "_r.request_method", "_r.request_referer")


def dedup_revisits(captures: DataFrame) -> DataFrame:
    """Each capture with ``action``: write, or revisit of the earliest capture of its digest before it, named by ``refers_*``.

    The earliest of each digest is one minimum combined before the shuffle; very common digests are a skewed join key.
    """
    first = captures.groupBy(F.col("digest").alias("_digest")).agg(F.min(F.struct("timestamp", "seq", "url")).alias("_first"))
    joined = captures.join(first, F.col("digest") == F.col("_digest"), "left")
    again = F.struct("timestamp", "seq") > F.struct(F.col("_first.timestamp").alias("timestamp"), F.col("_first.seq").alias("seq"))
    again = F.coalesce(again, F.lit(False))
    return joined.withColumns({"action": F.when(again, "revisit").otherwise("write"), "refers_url": F.when(again, F.col("_first.url")), "refers_timestamp": F.when(again, F.col("_first.timestamp"))}).drop("_digest", "_first")


def dedup_skip(captures: DataFrame) -> DataFrame:
    """Only the first capture of each URL."""
    first = F.min_by(F.struct(*captures.columns), F.struct("timestamp", "seq"))
    return captures.groupBy(F.col("url").alias("_url")).agg(first.alias("_c")).select("_c.*")


def cross_url(revisits: DataFrame, originals: DataFrame) -> DataFrame:
    """Revisits (refers_to_uri, refers_to_date, digest) with the original nearest to that date, of that URL and digest."""
    wanted = revisits.select("seq", surt(F.col("refers_to_uri")).alias("_key"), F.col("digest"), F.col("refers_to_date").alias("_date"))
    given = originals.select(F.col("urlkey").alias("_key"), "digest", "timestamp", F.col("seq").alias("_seq"), "offset", "filename")
    best = nearest(given, wanted, ["_key", "digest"], "_date", ("timestamp", "_seq")).select("seq", F.col("offset").alias("payload_offset"), F.col("filename").alias("payload_filename"))
    return revisits.join(best, "seq", "left")


def text_line(fields: tuple[str, ...] = FIELDS) -> Column:
    """Space-joined fields, ``-`` for what is missing."""
    return F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields))


def json_line(fields: tuple[str, ...]) -> Column:
    """JSON of the fields that a row has."""
    return F.to_json(F.struct(*fields))


def cdxj_line(fields: tuple[str, ...] = FIELDS[2:]) -> Column:
    """``key time {json}``; fields that are ``-`` or empty stay out."""
    shown = F.struct(*(F.when(~F.col(f).cast("string").isin("-", ""), F.col(f).cast("string")).alias(f) for f in fields))
    return F.concat_ws(" ", "urlkey", "timestamp", F.to_json(shown))


def indexable(records: DataFrame) -> DataFrame:
    """Records that an index lists: with a URL, no warcinfo, requests or plain-text metadata."""
    kind = F.coalesce(F.col("record_type"), F.lit(""))
    return records.where(F.col("target_uri").isNotNull() & ~kind.isin("warcinfo", "request") & ~((kind == "metadata") & (F.col("content_type") == "text/anvl")))


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, events): runs of a key's events with gaps below a limit. A file closes after such a gap.

    Gaps and islands, not session windows: filters on the result stay above the runs. A very busy key is spread over
    slices of the global order, so it fills no single task.
    """
    near = F.unix_micros(F.col("_t")) - F.unix_micros(F.col("_previous.t")) < gap_seconds * 1_000_000
    rows = with_previous(events.select(key, F.col(time).alias("_t")), F.struct(F.col(key).alias("k"), F.col("_t").alias("t")), F.col(key), F.col("_t"))
    new = F.when(F.col("_previous.k").eqNullSafe(F.col(key)) & near, 0).otherwise(1)
    rows = rows.withColumn("_n", new).drop("_previous")
    runs = with_running(rows, F.col("_n"), [key], F.col("_t"), F.col("_n").desc()).withColumn("session", F.col("_running") + F.col("_n"))
    return runs.groupBy(key, "session").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count(F.lit(1)).alias("events"))


def rollover(records: DataFrame, max_bytes: int) -> DataFrame:
    """Records with ``file_no``: a file of a collection closes once its records pass max_bytes."""
    rows = with_running(records, F.col("length"), ["collection"], F.col("seq"))
    return rows.withColumn("file_no", F.floor(F.col("_running") / max_bytes).cast("long")).drop("_running")
