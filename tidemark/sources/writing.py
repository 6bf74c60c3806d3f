"""Writing archive files: records as bytes by column expressions, files by size, revisits in place of repeated payloads.

Record bytes are made in the JVM. ``numbered`` numbers a collection's files by running size, over slices of the global
order, so that a large collection is no single task's work; a file is written by one task, under a name of its own first
and moved into place when it is whole, so that a task that is run again leaves no half a file.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import let
from tidemark.operators.ingest import dedup_revisits
from tidemark.operators.ordering import materialize, with_running
from tidemark.sources.archives import base32_sha1
from tidemark.sources.store import Draft

#: Bytes after which a file closes.
MAX_BYTES = 1_000_000_000
#: Fixed value: the profile of a revisit whose payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def iso_date(timestamp: Column) -> Column:
    """A capture time as records state it; other text as it is."""
    return F.regexp_replace(timestamp, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def with_revisits(records: DataFrame) -> DataFrame:
    """records (timestamp, seq, target_uri, payload) with digest; what repeats an earlier payload becomes a revisit of it.

    A revisit keeps its own headers, drops its payload and names the first record of that payload.
    """
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.coalesce("payload", F.lit(b""))))
    judged = dedup_revisits(records.withColumns({"digest": digest, "url": F.col("target_uri")}))
    again = (F.col("action") == "revisit") & (F.col("record_type") == "response")
    made = {"record_type": F.when(again, "revisit").otherwise(F.col("record_type")), "payload": F.when(~again, F.col("payload"))}
    made |= {"refers_to_uri": F.when(again, F.col("refers_url")), "refers_to_date": F.when(again, iso_date(F.col("refers_timestamp")))}
    return judged.withColumns(made).drop("action", "refers_url", "refers_timestamp", "url")


def record_bytes(records: DataFrame) -> DataFrame:
    """records with ``record``, their bytes, and ``length``. Needs record_type, record_id, target_uri, timestamp, status_line,
    headers and payload; digest, refers_to_uri and refers_to_date count where they are. Missing fields are left out."""
    has = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    raw = lambda c: F.encode(c, "UTF-8")
    field = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    fields = F.array_join(F.transform(F.coalesce("headers", F.array()), lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")), F.lit("\r\n"))), "")
    http = F.when(F.col("status_line").isNotNull(), F.concat(F.col("status_line"), F.lit("\r\n"), fields, F.lit("\r\n"))).otherwise("")
    kind = F.when(F.col("status_line").isNotNull(), F.when(F.col("record_type") == "request", "application/http; msgtype=request").otherwise("application/http; msgtype=response"))
    profile = F.when(F.col("record_type") == "revisit", F.lit(PROFILE))

    def whole(body: Column) -> Column:
        head = F.concat(
            F.lit("WARC/1.0\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", has("record_id")), field("WARC-Target-URI", F.col("target_uri")), field("WARC-Date", iso_date(F.col("timestamp"))),
            field("WARC-Payload-Digest", has("digest")), field("WARC-Profile", profile), field("WARC-Refers-To-Target-URI", has("refers_to_uri")), field("WARC-Refers-To-Date", has("refers_to_date")),
            field("Content-Type", kind), field("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
        )
        return F.concat(raw(head), body, raw(F.lit("\r\n\r\n")))

    made = records.withColumn("record", let(F.concat(raw(http), F.coalesce("payload", F.lit(b""))), whole))
    return made.withColumn("length", F.octet_length("record").cast("long"))


def numbered(sized: DataFrame, max_bytes: int, carried: DataFrame | None = None, fresh: int = 0) -> DataFrame:
    """sized (collection, seq, length, ...) with ``file_no``: a file of a collection closes once its records pass max_bytes.

    Numbers begin at ``fresh``, or for collections that are ``carried`` (collection, base, total) at their base, ``total`` bytes
    after it. Only (collection, seq, length) goes through the running
    sum and its global order; records take their file from it by (collection, seq), of which equal ones share a file.
    """
    narrow = with_running(sized.select("collection", "seq", "length"), F.col("length"), ["collection"], F.col("seq"))
    total = base = F.lit(None).cast("long")
    if carried is not None:
        narrow = narrow.join(carried.select(F.col("collection").alias("_c"), "base", "total"), F.col("collection").eqNullSafe(F.col("_c")), "left").drop("_c")
        total, base = F.col("total"), F.col("base")
    number = F.floor((F.col("_running") + F.coalesce(total, F.lit(0))) / max_bytes) + F.coalesce(base, F.lit(fresh))
    number = F.min(number.cast("long")).alias("file_no")
    of = narrow.groupBy(F.col("collection").alias("_c"), F.col("seq").alias("_s")).agg(number)
    return sized.join(of, F.col("collection").eqNullSafe(F.col("_c")) & F.col("seq").eqNullSafe(F.col("_s"))).drop("_c", "_s")


def file_name(collection: str | None, number: int) -> str:
    """The name of a file of a collection: what a path cannot hold, or what hides a file, is percent-encoded; none is ``%00``."""
    name = quote(collection, safe="") if collection else "%00"
    return f"{f'%{ord(name[0]):02X}{name[1:]}' if name[0] in '_.' else name}-{number:05d}"


def write_files(placed: DataFrame, folder: str, ending: str = ".warc.gz", tasks: int | None = None) -> DataFrame:
    """Writes records (collection, file_no, seq, record), compressed one by one, to a file for each (collection, file_no).

    (collection, file_no, path, records, bytes) of each, which is computed once. A file is there whole or not at all, and a
    repeated task replaces it.
    """
    tasks = tasks or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, n, done = None, None, 0, []

        def close() -> None:
            out.close()
            done.append((*key, f"{folder.rstrip('/')}/{file_name(*key)}{ending}", n, out.size))

        for b in batches:
            for name, number, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if key != (name, number):
                    if out:
                        close()
                    key, n = (name, number), 0
                    out = Draft(f"{folder.rstrip('/')}/{file_name(*key)}{ending}")
                out.write(gzip.compress(record.as_py()))
                n += 1
        if out:
            close()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 5, kinds, strict=True)], names=["collection", "file_no", "path", "records", "bytes"])

    dealt = placed.select("collection", "file_no", "seq", "record").repartition(tasks, "collection", "file_no").sortWithinPartitions("collection", "file_no", "seq")
    return materialize(dealt.mapInArrow(write, "collection string, file_no long, path string, records long, bytes long"))


def write_archives(records: DataFrame, path: str, max_bytes: int = MAX_BYTES, revisits: bool = True) -> DataFrame:
    """Writes records of collections (collection, seq, ...) as compressed archive files; (path, records, bytes) of each file.

    A file closes once its records (before compression) pass ``max_bytes``; with 1 each record has its own.
    """
    sized = record_bytes(with_revisits(records) if revisits else records).select("collection", "seq", "record", "length")
    return write_files(numbered(sized, max_bytes), path).select("path", "records", "bytes")
