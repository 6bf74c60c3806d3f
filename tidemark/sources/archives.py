"""Readers of archive files: one row for each archived record, and captures of them.

Files are read by ranges. The task of a range finds the first record that begins in it, a compressed member or a version
line that a whole record and another one follow, and reads on to the end of the last record that begins in it. Files are
streamed: a task holds a record, and records leave it in batches of bounded size. Damaged files give the records before
the damage. Should a record hold an archive itself, a range could begin inside it; the task before then sees that the
next range's first record is not where its own last one ends, and says so instead of giving wrong records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import let
from tidemark.functions.payload import digest_of, mime_of, status_of
from tidemark.functions.times import from_iso
from tidemark.functions.urls import surt
from tidemark.operators.ingest import indexable, join_requests
from tidemark.sources.store import Held, Opened

RECORDS = (
    "filename string, offset long, length long, format string, record_type string, record_id string, concurrent_to string, target_uri string, date string, refers_to_uri string,"
    " refers_to_date string, payload_digest string, content_type string, status_line string, method string, referer string, headers array<struct<name string, value string>>, payload binary"
)
_NAMES = [x.split()[0] for x in RECORDS.split(", headers")[0].split(",")] + ["headers", "payload"]
_TYPES = [pa.int64() if n in ("offset", "length") else pa.string() for n in _NAMES[:-2]]
_ARROW = pa.schema(list(zip(_NAMES, [*_TYPES, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()], strict=True)))
#: Bytes of payload that leave a task together.
BATCH = 16 << 20
#: Bytes of a compressed file that are given to the decompressor together.
FEED = 1 << 15
#: Bytes of a file that are one task's work, and most tasks of a scan.
SPLIT, MOST_TASKS = 64 << 20, 100_000


def header_block(block: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and fields of a header block; folded lines belong to the field before."""
    lines = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip(), value.strip()))
    return lines[0], fields


def _end_of_head(data: bytes, at: int) -> tuple[int, int]:
    """Where a header block ends, and where its body begins."""
    full = data.find(b"\r\n\r\n", at)
    bare = data.find(b"\n\n", at, full if full >= 0 else len(data))
    return (bare, bare + 2) if bare >= 0 else (full, full + 4) if full >= 0 else (len(data), len(data))


def _record(kind: str, fields: dict[str, str], content: bytes) -> dict:
    row = {
        "format": kind, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "target_uri": (fields.get("warc-target-uri") or "").strip("<>") or None,
        "date": fields.get("warc-date"), "refers_to_uri": fields.get("warc-refers-to-target-uri"), "refers_to_date": fields.get("warc-refers-to-date"), "payload_digest": fields.get("warc-payload-digest"),
        "content_type": fields.get("content-type"), "status_line": None, "method": None, "referer": None, "headers": [], "payload": content,
    }
    if kind == "arc" or "http" in (row["content_type"] or "") and row["record_type"] in ("response", "revisit", "request"):
        end, begin = _end_of_head(content, 0)
        first, http = header_block(content[:end])
        if kind == "arc" and not first.startswith("HTTP/"):
            return row
        named = {n.lower(): v for n, v in http}
        row |= {"headers": [{"name": n, "value": v} for n, v in http], "payload": content[begin:], "content_type": named.get("content-type"), "referer": named.get("referer")}
        row |= {"method": first.split(" ", 1)[0]} if row["record_type"] == "request" else {"status_line": first}
    return row


class Content:
    """Bytes of a file, or of one compressed member of it, in order; ``at`` is how many have been taken."""

    def __init__(self, parts: Iterator[bytes], at: int = 0):
        self.parts, self.held, self.at = parts, bytearray(), at

    def fill(self, size: int) -> bool:
        """Holds ``size`` bytes, if there are so many."""
        while len(self.held) < size:
            part = next(self.parts, None)
            if part is None:
                return False
            self.held += part
        return True

    def take(self, size: int) -> bytes:
        self.fill(size)
        out = bytes(self.held[:size])
        del self.held[:size]
        self.at += len(out)
        return out

    def skip_breaks(self) -> bool:
        """Goes on to the next byte that ends no line; false at the end."""
        while self.fill(1):
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            if not n:
                return True
            self.take(n)
        return False

    def until(self, *ends: bytes) -> bytes:
        """What stands before the first of ``ends``, and that end; all that is left if there is none."""
        seen = 0
        while True:
            found = [k + len(e) for e in ends if (k := self.held.find(e, seen)) >= 0]
            if found:
                return self.take(min(found))
            seen = max(0, len(self.held) - 3)
            if not self.fill(len(self.held) + 1):
                return self.take(len(self.held))


class Member:
    """One compressed member of a file from an offset on, decompressed as it is asked for; ``size`` once it has ended."""

    def __init__(self, f: Opened, offset: int):
        self.f, self.offset, self.size = f, offset, None

    def parts(self, fetch: int = FEED) -> Iterator[bytes]:
        tool, at = zlib.decompressobj(31), self.offset
        for part in self.f.through(self.offset, fetch=fetch):
            # fed block by block: what lies behind the member is handed back, and must not be the rest of the file each time
            for k in range(0, len(part), FEED):
                given = part[k : k + FEED]
                try:
                    out = tool.decompress(given)
                except zlib.error:
                    return
                at += len(given)
                if out:
                    yield out
                if tool.eof:
                    self.size = at - len(tool.unused_data) - self.offset
                    return

    def whole(self) -> int | None:
        """The member's size, by decompressing it once more without holding it."""
        again = Member(self.f, self.offset)
        for _ in again.parts():
            pass
        return again.size


def _one(content: Content) -> tuple[str, dict[str, str], int, bytes, int] | None:
    """(format, fields, place, content, length) of the record that comes next; none at the end or at what is no record."""
    if not content.skip_breaks():
        return None
    at = content.at
    content.fill(5)
    if content.held[:5] == b"WARC/":
        head = content.until(b"\r\n\r\n", b"\n\n")
        kind, fields = "warc", {n.lower(): v for n, v in header_block(head)[1]}
        length = fields.get("content-length", "")
    else:
        words = content.until(b"\n").decode("utf-8", "replace").split(" ")
        if len(words) < 5:
            return None
        kind, length = "arc", words[-1].strip()
        fields = {"warc-type": "warcinfo" if words[0].startswith("filedesc:") else "response", "warc-target-uri": words[0], "warc-date": words[-3], "content-type": words[-2]}
    if not length.isdigit():
        return None
    body = content.take(int(length))
    return kind, fields, at, body, content.at - at + int(length) - len(body)


def stream_records(f: Opened | Held, low: int = 0, stop: int | None = None) -> Iterator[dict]:
    """Records of a file that begin in [low, stop); at ``low`` one begins. A record is held, never the file.

    ``offset`` and ``length`` are those of the record, in a compressed file those of its member. Damage ends the records: a
    member that is not whole gives none of its own but those before the damage of a member that holds several.
    """
    stop = f.size if stop is None else stop
    if f.read(low, 2) != b"\x1f\x8b":
        content = Content(f.through(low), low)
        while content.skip_breaks() and content.at < stop and (found := _one(content)):
            kind, fields, at, body, length = found
            yield _record(kind, fields, body) | {"offset": at, "length": length}
        return
    while low < min(stop, f.size):
        member = Member(f, low)
        content = Content(member.parts())
        found = _one(content)
        if found and content.skip_breaks():  # several records in one member share its place
            size = member.whole()
            while found and size:
                yield _record(*found[:2], found[3]) | {"offset": low, "length": size}
                found = _one(content)
        elif found and member.size:
            yield _record(*found[:2], found[3]) | {"offset": low, "length": member.size}
        for _ in content.parts:
            pass
        if not member.size:
            return
        low += member.size


def records_of(data: bytes) -> Iterator[dict]:
    """Records of a file that is held."""
    return stream_records(Held(data))


# --- files in parts ------------------------------------------------------------------------------------------------

_GZIP_MAGIC = b"\x1f\x8b\x08"
_WARC_HEAD = re.compile(rb"(?:\r\n\r\n|\n\n)(?=WARC/\d\.\d\r?\n)")
_ARC_HEAD = re.compile(rb"\n(?=[a-z][a-z0-9+.\-]*:\S* [0-9a-fA-F.:]+ \d{14} \S+ \d+\r?\n)")
_FIRST_LINE = re.compile(rb"WARC/\d\.\d\r?\n|[a-z][a-z0-9+.\-]*:\S* [0-9a-fA-F.:]+ \d{14} \S+ \d+\r?\n")


def record_start(f: Opened | Held, low: int, high: int, window: int = 1 << 20) -> int | None:
    """Where the first record begins that begins in [low, high); none if none does.

    A place is a candidate by its first bytes, and is one if a whole record stands there and is followed by another one
    or by the end of the file.
    """
    if low == 0:
        return 0
    packed = f.read(0, 2) == b"\x1f\x8b"
    base, high = max(0, low - 4), min(high, f.size)
    while base < high:
        held = f.read(base, window + 512)
        found = _magics(held) if packed else sorted(m.end() for form in (_WARC_HEAD, _ARC_HEAD) for m in form.finditer(held))
        for k in found:
            if low <= base + k < high and k < window + 4 and _stands(f, base + k, packed):
                return base + k
        base += window
    return None


def _magics(held: bytes) -> Iterator[int]:
    k = held.find(_GZIP_MAGIC)
    while k >= 0:
        if k + 3 < len(held) and held[k + 3] < 0x20:  # no reserved flag
            yield k
        k = held.find(_GZIP_MAGIC, k + 1)


def _stands(f: Opened | Held, at: int, packed: bool) -> bool:
    if packed:
        member = Member(f, at)
        parts = member.parts(1 << 16)
        head = b""
        for part in parts:
            head += part
            if len(head) > 4096:
                break
        if not _FIRST_LINE.match(head.lstrip(b"\r\n")):
            return False
        for _ in parts:
            pass
        return member.size is not None and (at + member.size >= f.size or f.read(at + member.size, 2) == b"\x1f\x8b")
    content = Content(f.through(at, fetch=1 << 16), at)
    head = content.until(b"\r\n\r\n", b"\n\n") if f.read(at, 5) == b"WARC/" else content.until(b"\n")
    if head.startswith(b"WARC/"):
        fields = {n.lower(): v for n, v in header_block(head)[1]}
        named = fields.get("content-length", "") if "warc-type" in fields else ""
    else:
        named = head.split(b" ")[-1].strip().decode("ascii", "replace")
    if not named.isdigit():
        return False
    end = at + len(head) + int(named)
    after = f.read(end, 4096).lstrip(b"\r\n")
    return end >= f.size or not after or bool(_FIRST_LINE.match(after)) or (len(after) < 40 and after.startswith(b"WARC/"))


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"")
        if size >= BATCH or len(held) >= 5_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _split_records(path: str, low: int, high: int) -> Iterator[dict]:
    """Records that begin in [low, high) of a file, as its task gives them."""
    name = path.rsplit("/", 1)[-1]
    with Opened(path) as f:
        first = record_start(f, low, high)
        if first is None:
            return
        end = first
        for row in stream_records(f, first, high):
            end = row["offset"] + row["length"]
            yield row | {"filename": name}
        # the next task begins at the first place that looks like a record; it must be where this one ends
        after = record_start(f, high, f.size) if high < f.size and end >= high else None
        if after is not None and (after < end or f.read(end, after - end).strip(b"\r\n")):
            raise ValueError(f"{path} holds an archive in a record at {end}: read it with split_bytes=0")


def records_from(files: DataFrame, split_bytes: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """Records of files (path, length), batch or stream: each file is cut into ranges of ``split_bytes`` (0: not at all), dealt out to tasks."""
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(split_bytes) if split_bytes else F.greatest(F.col("length"), F.lit(1))
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))).alias("low")).withColumn("high", F.least("length", F.col("low") + step))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((row for b in batches for path, low, high in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for row in _split_records(path, low, high)), _ARROW)

    return ranges.select("path", "low", "high").repartition(tasks, "path", "low").mapInArrow(read, RECORDS)


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Records of archive files, plain or compressed record by record; a file that is compressed as a whole is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    # small files share tasks: a stream leaves many, and a task of its own costs more than a small file's records
    few = min(total[1], int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = (total[0] or 0) // split_bytes + few if split_bytes else total[1]
    return records_from(files, split_bytes, int(max(1, min(tasks, MOST_TASKS))))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four of base 32."""
    digits = lambda h: F.concat(*(F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(F.upper(let(F.sha1(payload), digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures_of(records: DataFrame) -> DataFrame:
    """Captures of records: those that an index lists, in the fields of the text form.

    A record without a payload digest gets one of its payload. Revisits have the type warc/revisit. ``seq`` is file and
    offset, which name a record.
    """
    r = indexable(records)
    revisit = F.col("record_type") == "revisit"
    mime = F.when(revisit, "warc/revisit").otherwise(mime_of(F.col("content_type")))
    digest = F.coalesce(digest_of(F.col("payload_digest")), base32_sha1(F.col("payload")))
    date = F.when(F.col("date").rlike(r"^\d{14}$"), F.col("date")).otherwise(from_iso(F.col("date")))
    text = lambda c: F.col(c).cast("string")
    status = F.when(F.col("status_line").isNull(), "-").otherwise(status_of(F.col("status_line")))
    return r.select(
        surt(F.col("target_uri")).alias("urlkey"), date.alias("timestamp"), F.col("target_uri").alias("url"), mime.alias("mime"), status.alias("status"), digest.alias("digest"), F.lit("-").alias("redirect"),
        F.lit("-").alias("robotflags"), text("length").alias("length"), text("offset").alias("offset"), "filename", F.concat_ws(" ", "filename", F.lpad(text("offset"), 20, "0")).alias("seq"),
    )


def paired(records: DataFrame) -> DataFrame:
    """Records with the method and referer of their requests."""
    return join_requests(records)
