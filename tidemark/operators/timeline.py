"""Calendar rollups, paging and time maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import http_date
from tidemark.operators.captures import ordered
from tidemark.operators.ordering import with_previous


def bucket(timestamp: Column) -> Column:
    """Three-hour part of the day, 1 to 8."""
    return (F.floor(F.substring(timestamp, 9, 2).cast("int") / 3) + 1).cast("int")


def parts(captures: DataFrame) -> DataFrame:
    """captures with year, month, day and bucket."""
    ts = F.col("timestamp")
    return captures.withColumns({"year": F.substring(ts, 1, 4).cast("int"), "month": F.substring(ts, 5, 2).cast("int"), "day": F.substring(ts, 7, 2).cast("int"), "bucket": bucket(ts)})


def rollup(captures: DataFrame) -> DataFrame:
    """Captures of all time, and of each year, month, day and bucket; coarser rows have nulls below their level.

    ``only`` is the time of a period's single capture.
    """
    counted = parts(captures).rollup("year", "month", "day", "bucket").agg(F.count(F.lit(1)).alias("captures"), F.min("timestamp").alias("_t"))
    return counted.withColumn("only", F.when(F.col("captures") == 1, F.col("_t"))).drop("_t")


def dedupe(captures: DataFrame) -> DataFrame:
    """The first of each run of captures with one time, in order of time."""
    rows = with_previous(captures, F.col("timestamp"), F.col("timestamp"), *ordered())
    return rows.where(F.col("_previous").isNull() | (F.col("_previous") != F.col("timestamp"))).drop("_previous")


def heat(captures: DataFrame) -> DataFrame:
    """For each year, the most captures of any of its days, and of any of its months."""
    days = parts(captures).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))
    months = days.groupBy("year", "month").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return months.groupBy("year").agg(F.max("top").alias("most_in_day"), F.max("n").alias("most_in_month"))


def filled_days(captures: DataFrame, *keys: str) -> DataFrame:
    """Captures of every day between the first and the last (of each of ``keys``), days without any included."""
    day = F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd")
    counts = captures.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("captures"))
    span = counts.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    every = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return every.join(counts, [*keys, "day"], "left").select(*keys, "day", F.coalesce("captures", F.lit(0)).alias("captures"))


def blocks(captures: DataFrame, lines: int) -> DataFrame:
    """Secondary index: first key, number and size of each run of ``lines`` ordered captures."""
    from tidemark.operators.ordering import sliced

    rows = sliced(captures.select("urlkey", "timestamp", "seq"), *ordered())
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = F.sum("_n").over(_before())
    rows = rows.join(F.broadcast(sizes.select("_part", F.coalesce(shift, F.lit(0)).alias("_shift"))), "_part")
    numbered = rows.withColumn("lineno", F.floor((F.col("_shift") + F.col("_in")) / lines).cast("long"))
    first = F.min(F.struct("urlkey", "timestamp"))
    return numbered.groupBy("lineno").agg(first.alias("_f"), F.count(F.lit(1)).alias("lines")).select("lineno", F.concat_ws(" ", "_f.urlkey", "_f.timestamp").alias("first_line_key"), "lines")


def _before():
    from pyspark.sql import Window

    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def matching_blocks(index: DataFrame, start: str, end: str) -> DataFrame:
    """Blocks that can hold keys in [start, end): from the last that begins before start."""
    floor = index.where(F.col("first_line_key") < start).agg(F.max("lineno").alias("floor"))
    return index.join(F.broadcast(floor), (F.col("lineno") >= F.coalesce("floor", F.lit(0))) & (F.col("first_line_key") < end)).drop("floor")


def page_count(index: DataFrame, start: str, end: str, page_size: int) -> DataFrame:
    """One row (blocks, pages, page_size) of a key range; block distance, as paging counts it."""
    span = matching_blocks(index, start, end).agg(F.coalesce(F.max("lineno") - F.min("lineno"), F.lit(0)).cast("long").alias("blocks"), F.count(F.lit(1)).alias("n"))
    pages = F.when(F.col("n") == 0, 0).otherwise(F.floor(F.col("blocks") / page_size) + 1)
    return span.select("blocks", pages.cast("long").alias("pages"), F.lit(page_size).cast("long").alias("page_size"))


def page(index: DataFrame, start: str, end: str, number: int, page_size: int) -> DataFrame:
    """Blocks of one page of a key range, pages counted from 0."""
    hit = matching_blocks(index, start, end)
    low = hit.agg(F.min("lineno").alias("_low"))
    at = F.col("lineno") - F.col("_low")
    return hit.join(F.broadcast(low), F.lit(True)).where((at >= number * page_size) & (at < (number + 1) * page_size)).drop("_low")


def timemap(captures: DataFrame, prefix: str) -> DataFrame:
    """Link lines of captures: number in order, and text; all but the last end in a comma."""
    ts = F.col("timestamp")
    text = F.format_string('<%s%s/%s>; rel="memento"; datetime="%s"', F.lit(prefix), ts, F.col("url"), http_date(ts))
    last = captures.select(F.max(F.struct("urlkey", "timestamp", "seq")).alias("_last"))
    rows = captures.join(F.broadcast(last), F.lit(True))
    here = F.struct("urlkey", "timestamp", "seq")
    return rows.select("urlkey", "timestamp", "seq", F.concat(text, F.when(here == F.col("_last"), "").otherwise(",")).alias("link"))


def timemap_header(captures: DataFrame, url: str, timegate: str, self_url: str) -> DataFrame:
    """The three lines (number, link) before a time map: itself, from its first capture on, its time gate, and the original."""
    begin = captures.agg(F.min(F.struct("urlkey", "timestamp", "seq"))["timestamp"].alias("first"))
    since = F.coalesce(F.concat(F.lit('; from="'), http_date(F.col("first")), F.lit('"')), F.lit(""))
    lines = (
        F.concat(F.lit(f'<{self_url}>; rel="self"; type="application/link-format"'), since, F.lit(",")), F.lit(f'<{timegate}>; rel="timegate",'), F.lit(f'<{url}>; rel="original",'),
    )
    return begin.select(F.posexplode(F.array(*lines)).alias("number", "link"))


def replay_links(captures: DataFrame, prefix: str) -> DataFrame:
    """captures with ``links``, the link header of their replay: original, time gate, time map, and the capture itself."""
    url, ts = F.col("url"), F.col("timestamp")
    link = lambda target, rel, *more: F.concat(F.lit("<"), target, F.lit(f'>; rel="{rel}"'), *more)
    links = (
        link(url, "original"), link(F.concat(F.lit(prefix), url), "timegate"), link(F.concat(F.lit(f"{prefix}timemap/link/"), url), "timemap", F.lit('; type="application/link-format"')),
        link(F.concat(F.lit(prefix), ts, F.lit("mp_/"), url), "memento", F.lit('; datetime="'), http_date(ts), F.lit('"')),
    )
    return captures.withColumn("links", F.concat_ws(", ", *links))


def listed_sources(spark: SparkSession, sources: Mapping[str, DataFrame | str]) -> DataFrame:
    """(name, type) of the sources in scope: table for a frame, else the ending of the path, or folder."""
    kind = lambda s: "table" if isinstance(s, DataFrame) else (s.rsplit("/", 1)[-1].rpartition(".")[2] if "." in s.rsplit("/", 1)[-1] else "folder")
    return spark.createDataFrame([(n, kind(s)) for n, s in sources.items()], "name string, type string")
