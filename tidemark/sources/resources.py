"""Records by file, offset and length, and the resources of captures, which read no more of archives than their own bytes.

Requests are put in the order of file and offset over partitions. A task reads neighbouring ranges together, up to READ bytes
with gaps of at most GAP, from the first place of the file that can give them, and parses each record from its own range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import is_self_redirect
from tidemark.functions.times import from_iso
from tidemark.operators.building import load_resources
from tidemark.operators.ingest import EMPTY_DIGEST, cross_url
from tidemark.operators.ordering import materialize
from tidemark.sources import archives
from tidemark.sources.store import Held, Opened, first_readable

#: Bytes that are read together, the largest gap between ranges of one read, and what is taken where the length is not known.
READ, GAP, UNKNOWN = 8 << 20, 64 << 10, 64 << 10
FOUND = archives.RECORDS.replace("length long, ", "length long, error string, ", 1)
_ARROW = pa.schema([*list(archives._ARROW)[:3], pa.field("error", pa.string()), *list(archives._ARROW)[3:]])


def _parsed(f: Opened | Held, offset: int) -> dict:
    row = next(archives.stream_records(f, offset, offset + 1), None)
    if row is None or row["format"] == "arc" and row["target_uri"] and ":" not in row["target_uri"]:
        raise ValueError(f"no record at {offset}")
    return row


def _read_run(f: Opened, run: list[tuple[int, int | None]]) -> list[dict]:
    """Records of neighbouring (offset, length), each or why not. A length that is unknown or cuts its record short is no bound."""
    low, high = run[0][0], max(o + (n or UNKNOWN) for o, n in run)
    if low >= f.size:
        raise EOFError(f"{low} is behind the end of the file")
    held, out = Held(f.read(low, high - low), low), []
    for offset, length in run:
        try:
            own = Held(held.data[offset - low : offset - low + length], offset) if length else held
            try:
                row = _parsed(own, offset)
                if row["offset"] + row["length"] > own.size:
                    raise EOFError
            except (EOFError, ValueError):
                row = _parsed(f, offset)
            out.append(row)
        except (ValueError, EOFError) as e:
            out.append({"error": str(e)})
    return out


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows in order, cut where the file changes, a gap is wide or enough is read together."""
    run: list[dict] = []
    for r in rows:
        if run and (r["filename"] != run[-1]["filename"] or r["offset"] > run[-1]["offset"] + (run[-1]["length"] or UNKNOWN) + GAP or r["offset"] - run[0]["offset"] > READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_at(requests: DataFrame, paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of requests (filename, offset, length: text or numbers), and ``error`` where one cannot be given.

    ``paths`` (name, path, rank) are the places of files, the best first. Each request is read once, however often it is
    made. A file without a place, a place that no store has, an offset that is no number or no record: these are rows with an
    error and no record. A length that is missing, no number or too short is made up for by reading on. The row's length is the record's own.
    """
    number = lambda c: F.col(c).cast("string").try_cast("long")
    wanted = requests.select("filename", number("offset").alias("offset"), number("length").alias("length"))
    wanted = wanted.groupBy("filename", "offset").agg(F.max(F.when(F.col("length") > 0, F.col("length"))).alias("length"))
    places = paths.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    placed = wanted.join(places, wanted["filename"] == places["name"], "left").select("filename", "offset", "length", "paths")
    tasks = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(tasks, "filename", "offset").sortWithinPartitions("filename", "offset")

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        given = batch.to_pylist()
        good = [r for r in given if r["filename"] is not None and r["offset"] is not None and r["offset"] >= 0]
        yield from ({k: r[k] for k in ("filename", "offset")} | {"error": "no file or offset", "payload": None} for r in given if r["filename"] is None or r["offset"] is None or r["offset"] < 0)
        for run in _runs(good):
            try:
                found = first_readable(run[0]["paths"] or (), lambda f, run=run: _read_run(f, [(r["offset"], r["length"]) for r in run]))
            except (OSError, EOFError, ValueError) as e:
                found = [{"error": str(e)}] * len(run)
            yield from ({"payload": None} | row | {"filename": r["filename"], "offset": r["offset"]} for r, row in zip(run, found, strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from archives._batched((row for b in batches for row in rows(b)), _ARROW)

    return dealt.mapInArrow(read, FOUND)


def fetch(captures: DataFrame, paths: DataFrame, originals: DataFrame | None = None, asked: str | None = None) -> DataFrame:
    """Captures with ``status_line``, ``headers``, ``payload`` and ``answer`` of their records (see ``load_resources``), read by offset.

    The records of captures and those of the originals that ``resolve_revisits`` named are read in one pass, each once. A
    revisit that is still unresolved names a URL and a time in its record: with ``originals`` (captures) it takes the
    nearest capture of that URL and its digest. A revisit that is a redirect, or one of an empty payload, needs no original. ``asked`` is a column
    with the URL that was asked for: a capture that redirects to it answers 508 and gives no payload.
    """
    has = lambda c: c in captures.columns
    given = materialize(captures.withColumn("_id", F.monotonically_increasing_id()))
    allowed = given.where(F.coalesce(F.col("access") != "block", F.lit(True))) if has("access") else given
    own = allowed.where("filename <> '-'").select("filename", "offset", "length")
    if has("orig_filename"):
        own = own.unionByName(allowed.where("orig_filename <> '-'").select(F.col("orig_filename").alias("filename"), F.col("orig_offset").alias("offset"), F.col("orig_length").alias("length")))
    records = materialize(read_at(own, paths))
    open_ = allowed.where("mime = 'warc/revisit'")
    if has("orig_filename"):
        open_ = open_.where("coalesce(orig_filename, '-') = '-'")
    meets = (open_["filename"] == records["filename"]) & (open_["offset"].try_cast("long") == records["offset"])
    light = records.where("error is null").select("filename", "offset", "refers_to_uri", "refers_to_date", "status_line")
    named = open_.join(light, meets).select("_id", "digest", "refers_to_uri", F.coalesce(from_iso(F.col("refers_to_date")), open_["timestamp"]).alias("refers_to_date"), F.coalesce(F.col("status_line").rlike(r"^\S+ 3"), F.lit(False)).alias("moved"))
    bare = named.where(F.col("moved") | (F.col("digest") == EMPTY_DIGEST)).select("_id", F.lit(True).alias("_bare"))
    given = given.join(bare, "_id", "left")
    if originals is not None:
        sought = named.where(~F.col("moved") & (F.col("digest") != EMPTY_DIGEST) & F.col("refers_to_uri").isNotNull()).select(F.col("_id").alias("seq"), "digest", "refers_to_uri", "refers_to_date")
        plain = originals.where("mime <> 'warc/revisit'")
        found = cross_url(sought, plain).where("payload_filename is not null").select(F.col("seq").alias("_id"), F.col("payload_filename").alias("_orig_file"), F.col("payload_offset").alias("_orig_at"))
        found = materialize(found)
        given = given.join(found, "_id", "left")
        for name, value in (("orig_filename", "_orig_file"), ("orig_offset", "_orig_at")):
            given = given.withColumn(name, F.coalesce(F.col(value), F.col(name) if has(name) else F.lit("-")))
        more = found.select(F.col("_orig_file").alias("filename"), F.col("_orig_at").alias("offset"), F.lit(None).cast("string").alias("length"))
        records = records.unionByName(read_at(more.join(records.where("error is null").select("filename", F.col("offset").cast("string").alias("offset")), ["filename", "offset"], "left_anti"), paths))
    # what needs no original is no revisit to the join below, and has no payload but its own
    marked = given.withColumn("_mime", F.col("mime")).withColumn("mime", F.when(F.col("_bare"), "-").otherwise(F.col("mime")))
    loaded = load_resources(marked, records.where("error is null")).withColumn("mime", F.col("_mime"))
    if asked is not None:
        location = F.get(F.filter("headers", lambda h: F.lower(h["name"]) == "location"), F.lit(0))["value"]
        status = F.regexp_extract(F.coalesce("status_line", F.lit("")), r"^\S+ (\d+)", 1)
        loops = F.coalesce(is_self_redirect(F.col(asked), status, location), F.lit(False)) & (F.col("answer") == 200)
        loaded = loaded.withColumns({"answer": F.when(loops, 508).otherwise(F.col("answer")), "payload": F.when(~loops, F.col("payload"))})
    return loaded.drop("_id", "_bare", "_mime", "_orig_file", "_orig_at")
