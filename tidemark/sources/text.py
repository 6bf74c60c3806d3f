"""Readers of text indexes: captures, secondary indexes, locations, access rules.

A line of captures has the key, the time and either JSON or a number of fields that names its layout. Lines are read by
Spark's own text reader, so any store and any number of files will do, and parsed by column expressions alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.access import Rule
from tidemark.operators.captures import ALIASES, FIELDS
from tidemark.sources.ranges import sorted_lines

_HEAD = ("urlkey", "timestamp", "url", "mime", "status", "digest")
_ORIGIN = ("orig_length", "orig_offset", "orig_filename")
#: Fields of a text line by their number.
LAYOUTS = {
    7: (*_HEAD, "length"),
    9: (*_HEAD, "redirect", "offset", "filename"),
    10: (*_HEAD, "redirect", "robotflags", "offset", "filename"),
    11: FIELDS,
    12: (*_HEAD, "redirect", "offset", "filename", *_ORIGIN),
    13: (*_HEAD, "redirect", "robotflags", "offset", "filename", *_ORIGIN),
    14: (*FIELDS, *_ORIGIN),
}
_KNOWN = (*FIELDS, *_ORIGIN)


def _quoted(url: Column) -> Column:
    """Characters beyond ASCII percent-encoded."""
    return F.when(url.rlike(r"^[\x00-\x7F]*$"), url).otherwise(
        F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")
    )


def parse_lines(lines: DataFrame, mode: str = "drop") -> DataFrame:
    """Captures of a column ``line``; its other columns stay.

    ``seq`` is the line itself, so that equal keys and times keep the bytewise order of lines. Other JSON fields are in
    the map ``extra``. Header lines (a space first) go. A line of no known layout goes too, or fails the job if mode is
    "fail". Empty and null lines go.
    """
    rows = lines.where("line is not null and line <> '' and not startswith(line, ' ')").withColumn("_f", F.split("line", " ", 3))
    body, words = F.try_element_at("_f", F.lit(3)), F.split("line", " ")
    told = F.from_json(F.when(F.startswith(body, F.lit("{")), body), "map<string,string>", {"mode": "PERMISSIVE"})
    rows = rows.withColumns({"_json": told, "_w": F.when(~F.startswith(body, F.lit("{")), words)})
    if mode == "fail":
        known = F.col("_json").isNotNull() | F.size("_w").isin(*LAYOUTS)
        rows = rows.withColumn("_w", F.when(F.coalesce(known, F.lit(False)), F.col("_w")).otherwise(F.raise_error(F.concat(F.lit("not a capture: "), F.col("line"))).cast("array<string>")))
    else:
        rows = rows.where(F.col("_json").isNotNull() | F.size("_w").isin(*LAYOUTS))

    def of(name: str) -> Column:
        text = F.lit(None).cast("string")
        for n, layout in LAYOUTS.items():
            if name in layout:
                text = F.when(F.size("_w") == n, F.col("_w")[layout.index(name)]).otherwise(text)
        if name in ("urlkey", "timestamp"):
            return F.coalesce(text, F.col("_f")[("urlkey", "timestamp").index(name)])
        keys = [name.replace("orig_", "orig."), *(a for a, f in ALIASES.items() if f == name)]
        return F.coalesce(text, *(F.col("_json")[k] for k in keys))

    others = [k for f in _KNOWN for k in (f.replace("orig_", "orig."), *(a for a, x in ALIASES.items() if x == f))]
    extra = F.map_filter("_json", lambda k, _: ~k.isin(*others))
    out = rows.select(*lines.columns, *(of(f).alias(f) for f in _KNOWN if f not in lines.columns), extra.alias("extra"), F.col("line").alias("seq"))
    return out.withColumn("url", _quoted(F.col("url"))).drop("line")


def read_captures(spark: SparkSession, path: str | list[str], mode: str = "drop") -> DataFrame:
    """Captures of text files, sorted or not, tagged with the name of the ``source`` file they stand in. Reads whole files."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"))
    return parse_lines(lines, mode)


@dataclass(frozen=True)
class TextIndex:
    """A text index of files that are each sorted. What asks for a key range (``captures.match``, a query) reads its bytes alone."""

    spark: SparkSession
    path: str | tuple[str, ...]

    def scan(self, start: str | None = None, end: str | None = None, mode: str = "drop") -> DataFrame:
        """Captures with keys of [start, end)."""
        paths = self.path if isinstance(self.path, str) else list(self.path)
        return parse_lines(sorted_lines(self.spark, paths, start, end).select("urlkey", "line", "source"), mode)


def block_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) of a secondary index as rows: first_line_key, part, offset, length, lineno. A line with fewer than four fields goes."""
    f = F.split("value", "\t")
    at = lambda k: F.try_element_at(f, F.lit(k))
    number = lambda k: F.expr(f"try_cast(try_element_at(split(value, '\t'), {k}) as bigint)")
    return lines.where(F.size(f) >= 4).select(at(1).alias("first_line_key"), at(2).alias("part"), number(3).alias("offset"), number(4).alias("length"), number(5).alias("lineno"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks of a secondary index."""
    return block_rows(spark.read.text(path))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, rank): where a part or archive lies, best place first. One row a place."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) > 1).select(f[0].alias("name"), F.posexplode(F.slice(f, 2, F.size(f))).alias("rank", "path"))


def with_path(captures: DataFrame, paths: DataFrame) -> DataFrame:
    """Captures with the best ``path`` of their file, null where none is known."""
    best = paths.groupBy(F.col("name").alias("_name")).agg(F.min_by("path", "rank").alias("path"))
    return captures.join(best, F.col("filename") == F.col("_name"), "left").drop("_name")


def coalesced_blocks(blocks: DataFrame, most: int = 10) -> DataFrame:
    """Byte ranges to read: neighbouring blocks of a part, at most ``most`` together (part, offset, length, blocks)."""
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("offset")
    start = F.when(F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset"), 0).otherwise(1)
    runs = blocks.withColumn("_new", start).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("part", "_run").orderBy("offset")
    cut = runs.withColumn("_cut", F.floor((F.row_number().over(inside) - 1) / most))
    return cut.groupBy("part", "_run", "_cut").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("blocks"), F.min("first_line_key").alias("first_line_key")).drop("_run", "_cut")


#: Most rules that are brought to the driver; more are an error, since rules are kept by hand and stay few.
MAX_RULES = 100_000


def parse_rule(line: str) -> Rule:
    """An access rule ``key - {json}``."""
    key, _, body = line.split(" ", 2)
    told = json.loads(body)
    return Rule(key, told.get("access", ""), told.get("user"), *(told.get(k) for k in ("before", "after", "newer", "older")))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Access rules of text files, greatest key first."""
    lines = [r[0] for r in spark.read.text(path).where("trim(value) <> ''").limit(MAX_RULES + 1).collect()]
    if len(lines) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} access rules")
    return sorted(map(parse_rule, lines), key=lambda r: (r.urlkey, r.user or ""), reverse=True)
