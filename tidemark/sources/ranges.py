"""Sorted text indexes as a data source that reads the byte ranges a key range can stand in, and nothing else.

Lines of a sorted file follow each other bytewise, and a line begins with its key, so the first line of a key or a later one
is found by bisection, with some log2(size / 8 KB) reads of a block. A scan bisects each file for both ends of the range, cuts
what lies between into pieces, and a task reads the lines that begin in its piece. The range comes from the options start
and end, not from pushed-down predicates: Spark keeps one state for all scans of a Python relation, so two branches of a
plan that push different predicates into one frame would read one of their ranges. Files that are compressed as a whole
cannot be bisected and are read through, a task each; lines beside the range do not come back from them either.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.store import Opened, listed

#: Bytes that bisection reads together, and bytes of a piece.
BLOCK, PIECE = 8 << 10, 32 << 20
SCHEMA = "urlkey string, line string, source string, at long"
_ARROW = pa.schema([("urlkey", pa.string()), ("line", pa.string()), ("source", pa.string()), ("at", pa.int64())])
Read = Callable[[int, int], bytes]


def key_of(line: bytes) -> bytes:
    """A line's key: what stands before its first space or tab."""
    return line.replace(b"\t", b" ", 1).split(b" ", 1)[0].rstrip(b"\r")


def line_start(read: Read, size: int, at: int) -> int:
    """Where the first line begins that begins at ``at`` or later; the size if none does."""
    if at <= 0:
        return 0
    at -= 1
    while at < size:
        block = read(at, BLOCK)
        cut = block.find(b"\n")
        if cut >= 0:
            return min(at + cut + 1, size)
        at += len(block)
    return size


def line_at(read: Read, size: int, at: int) -> bytes:
    """The line that begins at ``at``, with its newline."""
    out = b""
    while at + len(out) < size:
        block = read(at + len(out), BLOCK)
        cut = block.find(b"\n")
        if cut >= 0:
            return out + block[: cut + 1]
        out += block
    return out


def bisected(read: Read, size: int, key: bytes) -> int:
    """Where the first line begins whose key is ``key`` or comes later; the size if none is."""
    low, high, best = 0, size, size  # lines before low come earlier; the first of the others begins before high or is at best
    while high - low > BLOCK:
        middle = (low + high) // 2
        start = line_start(read, size, middle)
        if start >= high:
            high = middle
            continue
        line = line_at(read, size, start)
        if key_of(line) >= key:
            high, best = middle, start
        else:
            low = start + len(line)
    held = read(low, min(size, high + BLOCK) - low) if low < high else b""
    base = low
    while low < high:
        cut = held.find(b"\n", low - base)
        line = held[low - base : cut + 1] if cut >= 0 else line_at(read, size, low)
        if key_of(line) >= key:
            return low
        low += len(line)
    return best


def before(read: Read, at: int, lines: int = 1) -> int:
    """Where the line begins that is ``lines`` before the one at ``at``; 0 if there are not so many."""
    while at > 0 and lines > 0:
        end = at - 1  # the newline of the line before
        while True:
            low = max(0, end - BLOCK)
            cut = read(low, end - low).rfind(b"\n")
            if cut >= 0 or low == 0:
                at = low + cut + 1
                break
            end = low
        lines -= 1
    return at


@dataclass
class Piece(InputPartition):
    """Lines that begin in [low, high) of a file; the ``first`` piece begins with a line; a file that is not ``plain`` is one piece."""

    path: str
    low: int
    high: int
    first: bool
    plain: bool = True


def pieces(path: str, start: bytes | None, end: bytes | None, previous: int, piece: int) -> tuple[list[Piece], int]:
    """The pieces of one file in which keys of [start, end) can stand, and the bytes that were read to find them."""
    with Opened(path) as f:
        if f.read(0, 2) == b"\x1f\x8b":
            return [Piece(path, 0, f.size, True, False)], f.taken
        low = bisected(f.read, f.size, start) if start else 0
        high = bisected(f.read, f.size, end) if end is not None else f.size
        if previous and low < f.size or previous and start:
            low = before(f.read, low, previous)
        cuts = [*range(low, high, piece), high]
        return [Piece(path, a, b, k == 0) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], f.taken


def _columns(data: bytes, source: str, base: int) -> pa.RecordBatch:
    """Whole lines as Arrow columns, without a loop over lines."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 0x0A)
    if not len(ends) or ends[-1] != len(raw) - 1:
        ends = np.append(ends, len(raw))
    starts = np.concatenate(([0], ends[:-1] + 1))
    gaps = np.append(np.flatnonzero((raw == 0x20) | (raw == 0x09)), len(raw))
    stops = np.minimum(gaps[np.searchsorted(gaps, starts)], ends)

    def texts(to: np.ndarray) -> pa.Array:
        kept = np.zeros(len(raw) + 1, np.int8)
        np.add.at(kept, starts, 1)
        np.add.at(kept, to, -1)
        offsets = np.concatenate(([0], np.cumsum(to - starts))).astype(np.int64)
        whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[np.cumsum(kept[:-1], dtype=np.int8) > 0])])
        return (pc.utf8_rtrim(whole, "\r") if b"\r" in data else whole).cast(pa.string())

    return pa.RecordBatch.from_arrays([texts(stops), texts(ends), pa.array([source] * len(starts)), pa.array(starts + base)], schema=_ARROW)


def lines_of(piece: Piece) -> Iterator[pa.RecordBatch]:
    """The lines of a piece."""
    source = piece.path.rsplit("/", 1)[-1]
    with Opened(piece.path) as f:
        if not piece.plain:
            yield from _inflated(f, source)
            return
        at = piece.low if piece.first else line_start(f.read, f.size, piece.low)
        if at >= piece.high:
            return
        stop = line_start(f.read, f.size, piece.high)
        rest = b""
        for part in f.through(at, stop):
            rest += part
            cut = rest.rfind(b"\n") + 1
            if cut:
                yield _columns(rest[:cut], source, at)
                rest, at = rest[cut:], at + cut
        if rest:
            yield _columns(rest, source, at)


def _inflated(f: Opened, source: str) -> Iterator[pa.RecordBatch]:
    """Lines of a file of compressed members, one after the other."""
    rest, at, tool = b"", 0, zlib.decompressobj(31)
    for part in f.through(0):
        while part:
            rest += tool.decompress(part)
            part = tool.unused_data
            if tool.eof:
                tool = zlib.decompressobj(31)
        cut = rest.rfind(b"\n") + 1
        if cut:
            yield _columns(rest[:cut], source, at)
            rest, at = rest[cut:], at + cut
    if rest:
        yield _columns(rest, source, at)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.previous, self.piece = int(options.get("previous", 0)), int(options.get("piece", PIECE))
        self.start, self.end = (options[k].encode() if options.get(k) is not None else None for k in ("start", "end"))

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(32) as pool:
            found = list(pool.map(lambda path: pieces(path, self.start, self.end, self.previous, self.piece)[0], self.paths))
        return [p for of_file in found for p in of_file] or [Piece("", 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for batch in lines_of(partition) if partition.path else ():
            yield batch if partition.plain else self._cut(batch)

    def _cut(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column(0).cast(pa.binary())
        kept = pa.array(np.ones(len(key), bool))
        for bound, test in ((self.start, pc.greater_equal), (self.end, pc.less)):
            kept = kept if bound is None else pc.and_(kept, test(key, bound))
        return batch.filter(kept)


class SortedLines(DataSource):
    """Format ``sorted_lines``; options paths (a JSON list), start, end, previous (lines before the range that come along), piece (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "sorted_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def sorted_lines(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None, previous: int = 0, piece: int = PIECE) -> DataFrame:
    """(urlkey, line, source, at) of the lines of sorted text files with keys of [start, end); ``at`` is where a line begins."""
    spark.dataSource.register(SortedLines)
    options = {"paths": json.dumps([p for p, _ in listed(path)]), "previous": str(previous), "piece": str(piece)}
    options |= {k: v for k, v in (("start", start), ("end", end)) if v is not None}
    return spark.read.format("sorted_lines").options(**options).load()
