"""Packed collections (zip files of archives and indexes), read where they are: nothing is unpacked.

The directory at a package's end is read by ranges, and says where each entry is stored. Archives and compressed indexes are stored
as they are, so a range of the package is a file: archives are read in parts, records by offset, as from files of their
own. Archives get the package's name and a number, so that names of several packages do not clash, and captures of a
package's indexes are told the new names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import archives
from tidemark.sources.ranges import Piece, lines_of
from tidemark.sources.store import Opened, inside, listed
from tidemark.sources.text import parse_lines

ENTRIES = "package string, entry string, method int, offset long, packed long, size long"
#: Signatures and sizes of a zip file's structures.
_END, _END64, _AT64, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_STORED, _DEFLATED = 0, 8


def entries(f: Opened) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, offset of its bytes, packed size, size) of the files of a package, by its directory; a file that is none is an error."""
    tail_at = max(0, f.size - 65_577)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("not a packed collection: it has no directory")
    size, start = struct.unpack_from("<II", tail, at + 12)
    if 0xFFFFFFFF in (size, start) and tail[at - 20 : at - 16] == _AT64:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = f.read(where, 56)
        if end[:4] != _END64:
            raise ValueError("not a packed collection: its large directory is not there")
        size, start = struct.unpack_from("<QQ", end, 40)
    directory, at = f.read(start, size), 0
    while directory[at : at + 4] == _ENTRY:
        method = struct.unpack_from("<H", directory, at + 10)[0]
        sizes = list(struct.unpack_from("<II", directory, at + 20))
        name_size, extra_size, note_size = struct.unpack_from("<HHH", directory, at + 28)
        place = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_size].decode("utf-8", "replace")
        extra, end = at + 46 + name_size, at + 46 + name_size + extra_size
        while extra + 4 <= end:
            kind, length = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # what does not fit 32 bits, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", directory, extra + 4))
                unpacked = wide.pop(0) if sizes[1] == 0xFFFFFFFF else sizes[1]
                sizes = [wide.pop(0) if sizes[0] == 0xFFFFFFFF else sizes[0], unpacked]
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            extra += 4 + length
        at = end + note_size
        if not name.endswith("/"):
            own = f.read(place, 30)
            yield name, method, place + 30 + sum(struct.unpack_from("<HH", own, 26)), *sizes


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The entries (ENTRIES) of packages, one task a package at most."""
    found = [(p,) for p, _ in listed(path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            for package in b.column(0).to_pylist():
                with Opened(package) as f:
                    rows = [(package, *e) for e in entries(f)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["package", "entry", "method", "offset", "packed", "size"])

    return spark.createDataFrame(found, "package string").repartition(max(1, min(len(found), 10_000))).mapInArrow(run, ENTRIES)


def packed_archives(found: DataFrame) -> DataFrame:
    """(package, entry, name, path, rank, length) of the archives among entries: their new names, and where they lie, as ``fetch`` asks for it.

    A name is that of the package with the archive's number in it. An archive that is deflated inside its package is an
    error where it is read: only stored ones are ranges.
    """
    ending = F.regexp_extract("entry", r"\.warc(?:\.gz)?$", 0)
    stem = F.regexp_replace(F.element_at(F.split("package", "/"), -1), r"\.[^.]*$", "")
    listed_ = found.where(ending != "").groupBy("package").agg(F.sort_array(F.collect_list(F.struct("offset", "entry", "method", "packed"))).alias("all"))  # the archives of one package
    rows = listed_.select("package", F.posexplode("all").alias("n", "e")).select("package", "n", "e.*")
    name = F.concat(stem, F.lit("-"), F.col("n").cast("string"), ending)
    stored = F.when(F.col("method") == _STORED, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("an archive is deflated inside its package: "), "entry")).cast("boolean"))
    where = F.format_string("%s!%d+%d/%s", F.col("package"), F.col("offset"), F.col("packed"), name)
    return rows.select("package", F.element_at(F.split("entry", "/"), -1).alias("entry"), name.alias("name"), F.when(stored, where).alias("path"), F.lit(0).alias("rank"), F.col("packed").alias("length"))


def packed_records(spark: SparkSession, path: str | list[str], split_bytes: int = archives.SPLIT) -> DataFrame:
    """Records of the archives of packages, in parts; ``filename`` is an archive's new name."""
    return archives.records_from(packed_archives(read_entries(spark, path)).select("path", "length"), split_bytes)


def packed_captures(spark: SparkSession, path: str | list[str], mode: str = "drop") -> DataFrame:
    """Captures of the indexes of packages, with the new names of their archives and their ``package``. A package without indexes gives none."""
    found = read_entries(spark, path)
    indexes = found.where(F.col("entry").rlike(r".+\.cdxj?(\.gz)?$"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                place = inside(r["package"], r["offset"], r["packed"], r["entry"].rsplit("/", 1)[-1])
                for lines in _lines(place, r["method"], r["packed"]):
                    yield pa.RecordBatch.from_arrays([lines, pa.array([r["package"]] * len(lines), pa.string())], names=["line", "package"])

    rows = parse_lines(indexes.repartition(tasks, "package", "entry").mapInArrow(run, "line string, package string"), mode)
    names = packed_archives(found).select(F.col("package").alias("_p"), F.col("entry").alias("_e"), "name")
    return rows.join(names, (F.col("package") == F.col("_p")) & (F.col("filename") == F.col("_e")), "left").withColumn("filename", F.coalesce("name", "filename")).drop("_p", "_e", "name")


def _lines(place: str, method: int, size: int) -> Iterator[pa.Array]:
    if method == _STORED:
        with Opened(place) as f:
            plain = f.read(0, 2) != b"\x1f\x8b"
        yield from (b.column(1) for b in lines_of(Piece(place, 0, size, True, plain)))
        return
    if method != _DEFLATED:
        raise ValueError(f"an index is packed in a way that is not known: {method}")
    tool, rest = zlib.decompressobj(-15), b""
    with Opened(place) as f:
        for part in f.through(0):
            rest += tool.decompress(part)
            *lines, rest = rest.split(b"\n")
            yield pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], pa.string())
    if rest:
        yield pa.array([rest.decode("utf-8", "replace")], pa.string())
