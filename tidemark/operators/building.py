"""Index building: sorted tables whose key ranges prune files and row groups, sorted text indexes, merging, migration.

A table index is Parquet in the order (urlkey, timestamp, seq). Rows are range-partitioned and sorted, so a file and each
of its row groups hold one short key range, and a query's key range (equality, prefix or interval on urlkey) reads only
those that can hold it. A host with very many captures fills many files, since time and seq are part of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.captures import FIELDS, ORDER, merge_distinct
from tidemark.operators.ingest import cdxj_line, text_line

#: The header lines of the text forms, and the fields of the nine-field one.
HEADERS = {11: " CDX N b a m s k r M S V g", 9: " CDX N b a m s k r V g"}
NINE = ("urlkey", "timestamp", "url", "mime", "status", "digest", "redirect", "offset", "filename")
#: Rows of a Parquet row group, roughly, by its bytes.
ROW_GROUP_BYTES = 8 << 20


def sort_index(captures: DataFrame, files: int | None = None) -> DataFrame:
    """Captures in index order over partitions; ``files`` of them if given."""
    by = [F.col(c) for c in ORDER]
    dealt = captures.repartitionByRange(files, *by) if files else captures.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def write_index(captures: DataFrame, path: str, files: int | None = None, per_input: bool = False, mode: str = "errorifexists") -> None:
    """Writes a table index: one for all inputs, or with ``per_input`` one folder for each input file (``index_of=name``)."""
    out = sort_index(captures, files)
    if per_input:
        by = [F.col("index_of"), *(F.col(c) for c in ORDER)]
        out = captures.withColumn("index_of", F.col("filename")).repartitionByRange(*by).sortWithinPartitions(*by)
    writer = out.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.partitionBy("index_of") if per_input else writer).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a table index; a key range on it is pushed down to row groups."""
    return spark.read.parquet(path)


def add_to_index(spark: SparkSession, index: str, captures: DataFrame, merged: str, files: int | None = None) -> None:
    """Writes to ``merged`` the sorted union of an index and further captures, equal rows once."""
    old = read_index(spark, index)
    write_index(merge_distinct(old, captures.select(*old.columns)), merged, files)


def index_lines(captures: DataFrame, layout: int | str = "cdxj") -> DataFrame:
    """(part, line) of a text index: 11 or 9 fields, or key, time and JSON. Captures without a URL or key are no lines."""
    line: Column = cdxj_line(tuple(c for c in FIELDS[2:] if c in captures.columns)) if layout == "cdxj" else text_line(NINE if layout == 9 else FIELDS)
    given = captures.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("urlkey", F.lit("")) != ""))
    return given.select(*ORDER, line.alias("line"))


def write_text_index(captures: DataFrame, path: str, layout: int | str = "cdxj", files: int | None = None, header: bool = True) -> None:
    """Writes a sorted text index; its files follow each other in order, and the first begins with the header of its layout."""
    lines = index_lines(captures, layout)
    if header and layout in HEADERS:
        top = captures.sparkSession.range(1).select(F.lit("").alias("urlkey"), F.lit("").alias("timestamp"), F.lit(None).cast(lines.schema["seq"].dataType).alias("seq"), F.lit(HEADERS[layout]).alias("line"))
        lines = lines.unionByName(top)
    sort_index(lines, files).select("line").write.text(path)


def migrate(spark: SparkSession, source: str, path: str, files: int | None = None) -> None:
    """Text indexes of any layout as one sorted JSON index, with keys made afresh of their URLs."""
    from tidemark.functions.urls import surt
    from tidemark.sources.text import read_captures

    rows = read_captures(spark, source)
    write_text_index(rows.withColumn("urlkey", F.coalesce(surt(F.col("url")), "urlkey")), path, "cdxj", files)


# --- what a recorder keeps -----------------------------------------------------------------------------------------


def recorded(exchanges: DataFrame, accept: Sequence[str] = (), skip: str = "recorder-skip") -> DataFrame:
    """Exchanges (collection, request_headers, response_headers: arrays of name and value) that are recorded.

    Those go that ask to be skipped, by the header ``skip`` with the value 1 on either side, and those of collections that
    none of the ``accept`` expressions matches from its start.
    """
    asked = lambda c: F.coalesce(F.exists(c, lambda h: (F.lower(h["name"]) == skip) & (h["value"] == "1")), F.lit(False))
    rows = exchanges.where(~asked("request_headers") & ~asked("response_headers"))
    return rows.where(F.col("collection").rlike("^(?:" + "|".join(f"(?:{a})" for a in accept) + ")")) if accept else rows


def without_headers(headers: Column, names: Sequence[str]) -> Column:
    """Headers but for those named."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*(n.lower() for n in names)))


def without_private_cookies(headers: Column) -> Column:
    """Headers without cookies sent, and without cookies set for HTTP alone."""
    name = lambda h: F.lower(h["name"])
    return F.filter(headers, lambda h: (name(h) != "cookie") & ~((name(h) == "set-cookie") & h["value"].rlike(r"(?i);\s*HttpOnly\s*(;|$)")))


# --- payloads of captures ------------------------------------------------------------------------------------------


def load_resources(captures: DataFrame, records: DataFrame) -> DataFrame:
    """Captures with ``status_line``, ``headers`` and ``payload`` of their records, and ``answer``, the status to reply with.

    A capture's record is named by file and offset. A revisit takes its payload from the original that ``resolve_revisits``
    named (orig_filename, orig_offset) and its own headers where it has any. Blocked captures (``access``) answer 451 and load
    nothing; a missing record, or a revisit without its original, answers 404. Records of a file meet captures of that file only,
    by equality of file and offset.
    """
    has = lambda c: c in captures.columns
    blocked = F.coalesce(F.col("access") == "block", F.lit(False)) if has("access") else F.lit(False)
    revisit = (F.col("mime") == "warc/revisit") | F.coalesce(F.col("orig_filename") != "-", F.lit(False)) if has("orig_filename") else F.col("mime") == "warc/revisit"
    given = captures.withColumns({"_blocked": blocked, "_again": F.coalesce(revisit, F.lit(False))})
    loaded = ("status_line", "headers", "payload")

    def meet(rows: DataFrame, side: str, asked: Column, file: str, offset: str) -> DataFrame:
        """rows with what a record holds, and whether there is one, under names of a side. Rows that ask for none, or for no number,
        get a place by their own hash, which ``asked`` keeps from meeting any: with a null key all would go to one task."""
        number = F.col(offset).try_cast("long")
        asked = asked & F.col(file).isNotNull() & number.isNotNull()
        rows = rows.withColumns({"_asked": asked, "_place": F.when(asked, number).otherwise(F.xxhash64("urlkey", "timestamp", "filename", "offset"))})
        held = records.select(F.col("filename").alias("_file"), F.col("offset").alias("_at"), *(F.col(c).alias(f"{side}_{c}") for c in loaded))
        found = rows.join(held, F.col("_asked") & (F.col(file) == F.col("_file")) & (F.col("_place") == F.col("_at")), "left")
        return found.withColumn(f"{side}_found", F.col("_file").isNotNull()).drop("_file", "_at", "_asked", "_place")

    rows = meet(given, "_own", ~F.col("_blocked"), "filename", "offset")
    if has("orig_filename"):
        rows = meet(rows, "_first", ~F.col("_blocked") & F.col("_again"), "orig_filename", "orig_offset")
    else:
        kinds = records.select(*loaded).schema
        rows = rows.withColumns({f"_first_{c}": F.lit(None).cast(kinds[c].dataType) for c in loaded} | {"_first_found": F.lit(False)})
    body = F.when(F.col("_again"), F.col("_first_payload")).otherwise(F.col("_own_payload"))
    headed = F.size(F.coalesce("_own_headers", F.array())) > 0
    pick = lambda c: F.when(F.col("_again") & ~headed, F.col(f"_first_{c}")).otherwise(F.col(f"_own_{c}"))
    answer = F.when(F.col("_blocked"), 451).when(~F.col("_own_found") | (F.col("_again") & ~F.col("_first_found")), 404).otherwise(200)
    return rows.withColumns({"answer": answer, "status_line": pick("status_line"), "headers": pick("headers"), "payload": body}).drop("_blocked", "_again", *(f"{side}_{c}" for side in ("_own", "_first") for c in (*loaded, "found")))
