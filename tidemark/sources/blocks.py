"""Compressed block indexes: sorted captures in compressed blocks of lines, and a sorted summary that tells where blocks begin.

A query reads the lines of the summary in which its key range can stand (by bisection), coalesces neighbouring blocks to one
read, and cuts the lines of its range out of them. The summary tells how many blocks a query touches before any is read,
which makes pages: page k of a query is its blocks from k times the page's size on.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import BadRequest
from tidemark.operators.building import index_lines
from tidemark.operators.captures import ORDER
from tidemark.operators.ordering import materialize, sliced
from tidemark.sources.ranges import key_of, sorted_lines
from tidemark.sources.store import Draft, Opened, first_readable
from tidemark.sources.text import block_rows, coalesced_blocks, parse_lines, read_paths

#: Lines of a block, blocks that are read together, and blocks of a page.
LINES, TOGETHER, PAGE = 3_000, 10, 10


def _lines(f: Opened, offset: int, length: int) -> list[bytes]:
    """Lines of the compressed members in a byte range; a range that is cut short or damaged is an error."""
    out, tool, whole = [], zlib.decompressobj(31), False
    for part in f.through(offset, offset + length):
        while part:
            try:
                out.append(tool.decompress(part))
            except zlib.error as e:
                raise OSError(str(e)) from e
            part = tool.unused_data
            whole = tool.eof
            if whole:
                tool = zlib.decompressobj(31)
    if not out or not whole or offset + length > f.size:
        raise OSError(f"no whole blocks at {offset}")
    return b"".join(out).split(b"\n")


def load_blocks(blocks: DataFrame, paths: DataFrame, mode: str = "drop", start: str | None = None, end: str | None = None) -> DataFrame:
    """Captures in the compressed blocks (part, offset, length, first_line_key) of a secondary index, or those with keys of [start, end).

    ``paths`` (name, path, rank) tells where a part lies. Neighbouring blocks of a part are one read, up to TOGETHER of them;
    reads are dealt out like other rows, and a task holds one at a time. Of several places of a part the first that
    can be read whole serves; a read that none can give is an error, in mode "drop" none.
    """
    places = paths.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    reads = coalesced_blocks(blocks, TOGETHER)
    wanted = reads.join(places, reads["part"] == places["name"], "left").select("part", "offset", "length", "paths").repartition("part", "offset")
    low, high = (k.encode() if k is not None else None for k in (start, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    lines = first_readable(r["paths"] or (), lambda f, r=r: _lines(f, r["offset"], r["length"]))
                except OSError:
                    if mode != "drop":
                        raise
                    continue
                kept = [x for x in lines if x and (low is None or key_of(x) >= low) and (high is None or key_of(x) < high)]
                if kept:
                    told = [x.decode("utf-8", "replace") for x in kept]
                    yield pa.RecordBatch.from_arrays([pa.array(told), pa.array([r["part"]] * len(told))], names=["line", "source"])

    return parse_lines(wanted.mapInArrow(run, "line string, source string"), mode)


@dataclass(frozen=True)
class BlockIndex:
    """A block index: where its summary and its places (name, then paths, a line a part) are, and how large a page is."""

    spark: SparkSession
    summary: str
    places: str
    page_size: int = PAGE

    def blocks(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The blocks in which keys of [start, end) can stand: those that begin in it, and the one before."""
        return block_rows(sorted_lines(self.spark, self.summary, start, end, previous=1).select(F.col("line").alias("value")))

    def scan(self, start: str | None = None, end: str | None = None, page: int | None = None, page_size: int | None = None, mode: str = "drop") -> DataFrame:
        """Captures with keys of [start, end), or those of one page of its blocks; a page that is not there is a bad request."""
        blocks = self.blocks(start, end)
        if page is not None:
            size, found = self._size(page_size), blocks.count()
            if page < 0 or page >= max(1, -(-found // size)):
                raise BadRequest(f"page {page} of {-(-found // size)}")
            place = Window.orderBy("first_line_key", "part", "offset")  # one row a block of the range
            blocks = blocks.withColumn("_n", F.row_number().over(place) - 1).where((F.col("_n") >= page * size) & (F.col("_n") < (page + 1) * size)).drop("_n")
        return load_blocks(blocks, read_paths(self.spark, self.places), mode, start, end)

    def page_count(self, start: str, end: str, page_size: int | None = None) -> DataFrame:
        """(pages, pageSize, blocks) of a key range, in one row. A range inside one block is looked up there: it may be empty."""
        size, found = self._size(page_size), self.blocks(start, end).count()
        if found == 1 and self.scan(start, end).isEmpty():
            found = 0
        return self.spark.range(1).select(F.lit(-(-found // size)).cast("long").alias("pages"), F.lit(size).cast("long").alias("pageSize"), F.lit(found).cast("long").alias("blocks"))

    def _size(self, page_size: int | None) -> int:
        size = page_size or self.page_size
        if size < 1:
            raise BadRequest("a page has at least one block")
        return size


def _one_file(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines of the one partition that there is, and tells where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Draft(path)
        for b in batches:
            text.write("".join(f"{x}\n" for x in b.column(0).to_pylist()).encode())
        text.close()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return run


def write_block_index(captures: DataFrame, path: str, lines: int = LINES, parts: int | None = None, layout: int | str = "cdxj") -> BlockIndex:
    """Writes captures as a block index below ``path``: part-*.gz, summary.idx and places.loc.

    A block has so many lines in the order of all captures, the last one fewer, wherever parts are cut. The summary has a
    line a block, and one task writes it.
    """
    spark = captures.sparkSession
    base = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[str] = []
        draft, found, name = None, [], ""

        def close(block: list[str]) -> None:
            packed = gzip.compress(("\n".join(block) + "\n").encode(), mtime=0)
            found.append((" ".join(block[0].split(" ", 2)[:2]), name, draft.size, len(packed)))
            draft.write(packed)

        for b in batches:
            for number, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if draft is None:
                    name = f"part-{number:05d}"
                    draft = Draft(f"{base}/{name}.gz")
                rest.append(line)
                if len(rest) == lines:
                    close(rest)
                    rest = []
        if rest:
            close(rest)
        if draft:
            draft.close()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)], names=["first_line_key", "part", "offset", "length"])

    placed = sliced(index_lines(captures, layout), *(F.col(c) for c in ORDER))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))  # one row a slice
    numbered = placed.join(F.broadcast(shifts), "_part").select(F.expr(f"(_shift + _in) div {lines}").alias("block"), (F.col("_shift") + F.col("_in")).alias("at"), "line")
    dealt = (numbered.repartitionByRange(parts, "block") if parts else numbered.repartitionByRange("block")).sortWithinPartitions("block", "at")
    dealt = dealt.select(F.spark_partition_id().alias("number"), "line")
    written = materialize(dealt.mapInArrow(run, "first_line_key string, part string, offset long, length long"))
    order = Window.orderBy("first_line_key", "part", "offset")
    summary = written.withColumn("lineno", F.row_number().over(order)).select(F.concat_ws("\t", "first_line_key", "part", *(F.col(c).cast("string") for c in ("offset", "length", "lineno"))).alias("line"))
    places = written.select("part").distinct().select(F.concat_ws("\t", "part", F.concat(F.lit(f"{base}/"), "part", F.lit(".gz"))).alias("line"))
    for name, rows in (("summary.idx", summary), ("places.loc", places.coalesce(1))):
        rows.mapInArrow(_one_file(f"{base}/{name}"), "path string").collect()
    return BlockIndex(spark, f"{base}/summary.idx", f"{base}/places.loc")

