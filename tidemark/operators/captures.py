"""Operators over captures: one row per archived exchange, in the order (urlkey, timestamp, seq).

``seq`` is any unique tie-break: a line number, an offset. Every operator is DataFrame to DataFrame and lazy, but for
``collapse``, which must place rows in a global order first. The fixed order of a query is: key range, revisits, filters,
time clamp, collapse, then one of closest, reverse and limit. Revisits resolve before filters, so filters see the
resolved values; nothing but the key range may move below that step.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import distance, pad
from tidemark.functions.urls import BadRequest, in_range, key_range
from tidemark.operators.ordering import with_previous

ORDER = ("urlkey", "timestamp", "seq")
#: Columns in the order of the eleven-field text form.
FIELDS = ("urlkey", "timestamp", "url", "mime", "status", "digest", "redirect", "robotflags", "length", "offset", "filename")
#: Other names of fields, as accepted in filters and JSON rows; ``s`` is the length.
ALIASES = {
    "original": "url", "u": "url", "statuscode": "status", "mimetype": "mime", "m": "mime", "l": "length", "s": "length",
    "o": "offset", "d": "digest", "t": "timestamp", "k": "urlkey", "f": "filename",
}
DEFAULT_LIMIT = 100_000


class Index(Protocol):
    """Captures in key order of which a range can be read."""

    def scan(self, start: str | None = None, end: str | None = None) -> DataFrame: ...


def ordered(*extra: Column, descending: bool = False) -> list[Column]:
    return [*extra, *(F.col(c).desc() if descending else F.col(c) for c in ORDER)]


def asked(url: str, match_type: str = "exact") -> tuple[str, str]:
    """URL and match type of what is asked: ``*.host`` asks for the domain, a trailing ``*`` for the prefix."""
    if url.startswith("*."):
        return url[2:], "domain"
    return (url[:-1], "prefix") if url.endswith("*") else (url, match_type)


def match(captures: DataFrame | Index, url: str, match_type: str = "exact") -> DataFrame:
    """Captures whose key a URL matches, wildcards as in ``asked``; of an index that can ``scan`` a range, its range is read."""
    url, match_type = asked(url, match_type)
    start, end = key_range(url, match_type)
    if hasattr(captures, "scan"):
        captures = captures.scan(start, end)
    if match_type == "exact":
        return captures.where(F.col("urlkey") == start)
    if match_type == "prefix":
        return captures.where(F.col("urlkey").startswith(start))
    return captures.where(in_range(F.col("urlkey"), start, end))


def line(captures: DataFrame) -> Column:
    """The space-joined row, in the fields that the frame has."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FIELDS if c in captures.columns))


def condition(captures: DataFrame, spec: str) -> Column:
    """One filter ``[!][=|~][field:]expression``: contains, equals, or a regular expression anchored at the start.

    A field that a row lacks is the empty string; without a field the whole row is tested.
    """
    m = re.fullmatch(r"(!?)([=~]?)(?:([^:]*?):)?(.*)", spec, re.S)
    negated, mode, field, text = m.groups()
    if field is None:
        value = line(captures)
    else:
        name = ALIASES.get(field, field).replace(".", "_").replace("-", "_")
        value = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in captures.columns else F.lit("")
    if mode == "=":
        test = value == text
    elif mode == "~":
        test = value.rlike(f"(?d)^(?:{text})")
    else:
        test = value.contains(text)
    return ~test if negated else test


def filter_rows(captures: DataFrame, specs: str | Sequence[str]) -> DataFrame:
    """Captures that meet every filter."""
    specs = [specs] if isinstance(specs, str) else list(specs)
    return captures.where(functools.reduce(lambda a, b: a & b, (condition(captures, s) for s in specs))) if specs else captures


def clamp(captures: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Captures between two (partial) times, both included."""
    if start:
        captures = captures.where(F.col("timestamp") >= pad(start))
    if end:
        captures = captures.where(F.col("timestamp") <= pad(end, high=True))
    return captures


def is_revisit(captures: DataFrame) -> Column:
    by_mime = F.col("mime") == "warc/revisit"
    return by_mime | (F.col("filename") == "-") if "filename" in captures.columns else by_mime


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Revisits with mime, status and origin (orig_length, orig_offset, orig_filename) of the first earlier original of
    their digest; ``-`` where there is none. An empty digest resolves nothing; ``-`` is a digest like others.

    The first original of a digest is one minimum, combined before the shuffle; rows join it on the digest. A digest
    that very many rows share (the empty payload) is a skewed join key, which adaptive execution splits.
    """
    origin = ["length", "offset", "filename"]
    place = F.struct(*ORDER)
    revisit = F.coalesce(is_revisit(captures), F.lit(False))
    known = F.col("digest").isNotNull() & (F.col("digest") != "")
    originals = captures.where(~revisit & known).groupBy(F.col("digest").alias("_digest")).agg(
        F.min(F.struct(place.alias("place"), F.struct("mime", "status", *origin).alias("of"))).alias("_first")
    )
    joined = captures.join(originals, revisit & known & (F.col("digest") == F.col("_digest")) & (F.col("_first.place") < place), "left")
    of = F.col("_first.of")
    found = F.col("_first").isNotNull()
    changed = {f"orig_{c}": F.when(found, of[c]).otherwise("-") for c in origin}
    changed |= {c: F.when(found, of[c]).otherwise(F.col(c)) for c in ("mime", "status")}
    return joined.withColumns(changed).drop("_digest", "_first")


def collapse(captures: DataFrame, digits: int, scope: str = "all") -> DataFrame:
    """Drops a capture whose first ``digits`` of time, and status, equal those of the capture just before it.

    The capture before is that of the whole ordered stream, whatever its URL; scope "url" looks at one URL's alone.
    """
    token = F.concat_ws("\x00", F.substring("timestamp", 1, digits), F.coalesce("status", F.lit("")))
    if scope == "url":
        token = F.concat_ws("\x00", token, "urlkey")
    rows = with_previous(captures, token, *ordered())
    return rows.where(F.col("_previous").isNull() | (F.col("_previous") != token)).drop("_previous")


def closest(captures: DataFrame, target: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The captures nearest to a time, earlier first among equals. No limit above zero means no rows."""
    if limit <= 0:
        return captures.limit(0)
    return captures.orderBy(*ordered(distance(F.col("timestamp"), target))).limit(limit)


def last(captures: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The last captures, last first."""
    if limit < 0:
        raise BadRequest("a reversed query needs a limit of zero or more")
    return captures.orderBy(*ordered(descending=True)).limit(limit)


def first(captures: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first captures in order; zero means all, less than zero none."""
    ranked = captures.orderBy(*ordered())
    return ranked if limit == 0 else ranked.limit(max(limit, 0))


def union(sources: dict[str, DataFrame], collection: str | None = None) -> DataFrame:
    """All sources together, each row tagged with the name of its source (before a tag that it has already)."""
    tagged = []
    for name, df in sources.items():
        own = F.concat_ws(":", F.lit(name), F.col("source")) if "source" in df.columns else F.lit(name)
        tagged.append(df.withColumns({"source": own, "source_coll": F.lit(collection if collection is not None else name.split("/", 1)[0])}))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def choose_sources(names: Sequence[str], spec: str = "*") -> list[str]:
    """``a,b`` names sources, ``!a,b`` all others, ``*`` all; ``name:collection`` picks by name."""
    inverted, wanted = spec.startswith("!"), {s.split(":", 1)[0] for s in spec.lstrip("!").split(",")}
    if spec == "*":
        return list(names)
    return [n for n in names if (n in wanted) != inverted]


def first_found(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each value of keys the rows of the first source that has any: later sources stand in for what earlier ones lack."""
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)))
    best = every.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("_rank").alias("_best"))
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return every.join(best, same & (F.col("_rank") == F.col("_best"))).drop("_rank", "_best", *(f"_{k}" for k in keys))


def merge_distinct(*indexes: DataFrame) -> DataFrame:
    """Rows of several indexes, equal ones once."""
    return functools.reduce(lambda a, b: a.unionByName(b), indexes).distinct()


def apply_ops(captures: DataFrame, ops: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Own operators, one after the other."""
    return functools.reduce(lambda df, op: df.transform(op), ops, captures)
