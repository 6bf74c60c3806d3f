"""Capture queries: request parameters to one lazily composed plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import BadRequest, key_range, url_key
from tidemark.operators import access as acl
from tidemark.operators import captures as ops
from tidemark.operators import fuzzy, ingest, timeline
from tidemark.sources.blocks import BlockIndex

_FALSE = ("", "0", "false", "f", "off")


def to_bool(value: object) -> bool:
    return str(value).lower() not in _FALSE if value is not None else False


@dataclass(frozen=True)
class CaptureQuery:
    """What to find, and how to show it. ``parse`` reads request parameters; ``run`` makes the plan."""

    url: str
    match_type: str = "exact"
    filters: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    closest: str | None = None
    reverse: bool = False
    limit: int = ops.DEFAULT_LIMIT
    resolve_revisits: bool = False
    collapse_digits: int | None = None
    fields: tuple[str, ...] = ()
    output: str = "cdxj"
    allow_fuzzy: bool = True
    sources: str = "*"
    page: int | None = None
    page_size: int | None = None
    count_pages: bool = False
    custom: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=(), compare=False)
    after: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=(), compare=False)

    @staticmethod
    def parse(params: Mapping[str, str | Sequence[str]]) -> CaptureQuery:
        one = lambda k, d=None: (v[0] if isinstance(v, (list, tuple)) and v else v) if (v := params.get(k)) is not None else d
        if not one("url"):
            raise BadRequest("a query needs a url")
        url, match = one("url"), one("matchType")
        if match is None:
            match = "domain" if url.startswith("*.") else "prefix" if url.endswith("*") else "exact"
            url = url.removeprefix("*.") if match == "domain" else url.removesuffix("*")
        if match not in ("exact", "prefix", "host", "domain"):
            raise BadRequest(f"unknown match type: {match}")
        filters = params.get("filter") or ()
        filters = (filters,) if isinstance(filters, str) else tuple(filters)
        if one("content_type"):
            filters = ("=mime:" + one("content_type"),)
        output = one("output", "cdxj")
        if output not in ("cdxj", "json", "text", "link"):
            raise BadRequest(f"unknown output: {output}")
        fields = one("fields") or one("fl") or ""
        try:
            numbers = {k: int(one(k)) for k in ("limit", "collapseTime", "page", "pageSize") if one(k) not in (None, "")}
        except ValueError as e:
            raise BadRequest(str(e)) from e
        return CaptureQuery(
            url, match, filters, one("from") or one("from_ts"), one("to"), one("closest"), to_bool(one("reverse")) or one("sort") == "reverse", numbers.get("limit", ops.DEFAULT_LIMIT),
            to_bool(one("resolveRevisits")), numbers.get("collapseTime"), tuple(f for f in fields.split(",") if f), output, to_bool(one("allowFuzzy", "1")), one("sources", "*"), numbers.get("page"), numbers.get("pageSize"),
            to_bool(one("showNumPages")),
        )

    def source(self, captures: DataFrame | ops.Index | Mapping[str, DataFrame | ops.Index]) -> DataFrame:
        """The captures to look in: of indexes the key range, of named sources those chosen, tagged."""
        start, end = key_range(*ops.asked(self.url, self.match_type))
        one = lambda c: c.scan(start, end) if hasattr(c, "scan") else c
        if isinstance(captures, Mapping):
            return ops.union({n: one(captures[n]) for n in ops.choose_sources(list(captures), self.sources)})
        return one(captures)

    def select(self, captures: DataFrame) -> DataFrame:
        """Key range, revisits, filters, clamp, collapse, own operators."""
        rows = ops.match(captures, self.url, self.match_type)
        if self.resolve_revisits:
            rows = ops.resolve_revisits(rows)
        rows = ops.clamp(ops.filter_rows(rows, self.filters), self.start, self.end)
        if self.collapse_digits:
            rows = ops.collapse(rows, self.collapse_digits)
        return ops.apply_ops(rows, self.custom)

    def cut(self, rows: DataFrame) -> DataFrame:
        """closest, else reverse, else limit; then what comes after limits."""
        if self.closest:
            target = datetime.now(UTC).strftime("%Y%m%d%H%M%S") if self.closest == "now" else self.closest
            rows = ops.closest(rows, target, self.limit)
        else:
            rows = ops.last(rows, self.limit) if self.reverse else ops.first(rows, self.limit)
        return ops.apply_ops(rows, self.after)

    def run(self, captures: DataFrame | ops.Index | Mapping[str, DataFrame | ops.Index], rules: Sequence[acl.Rule] = (), user: str | None = None, embargo: acl.Rule | None = None, default: str = "allow", as_of: datetime | None = None, fuzzy_rules: Sequence[fuzzy.FuzzyRule] = fuzzy.DEFAULT_RULES) -> DataFrame:
        """The whole query; access comes last, after limits.

        Indexes read the key range alone; a block index reads the blocks of the ``page`` asked for, and only it has pages.
        """
        if self.page is not None or self.count_pages:
            if not isinstance(captures, BlockIndex):
                raise BadRequest("only a block index has pages")
            start, end = key_range(*ops.asked(self.url, self.match_type))
            if self.count_pages:
                return captures.page_count(start, end, self.page_size)
            found = captures.scan(start, end, self.page, self.page_size)
        else:
            found = self.source(captures)
        rows = self.cut(self.select(found))
        if self.allow_fuzzy and (near := self.fuzzied(fuzzy_rules)) is not None:
            if self.finds(found):
                rows = rows.withColumn("is_fuzzy", F.lit(None).cast("string"))
            else:
                rows = near.cut(near.select(near.source(captures))).withColumn("is_fuzzy", F.lit("1"))
        if rules or embargo:
            rows = acl.control(rows, rules, user, default, embargo, as_of)
        return rows

    def finds(self, captures: DataFrame) -> bool:
        """Whether the query has any row: one row is looked for, without sorts; among originals first, which no resolution changes."""
        if self.after or self.limit < 0 or (self.limit == 0 and (self.closest or self.reverse)):
            return not self.cut(self.select(captures)).isEmpty()
        plain = replace(self, collapse_digits=None)
        if not self.resolve_revisits:
            return not plain.select(captures).isEmpty()
        originals = captures.where(~F.coalesce(ops.is_revisit(captures), F.lit(False)))
        return not (replace(plain, resolve_revisits=False).select(originals).isEmpty() and plain.select(captures).isEmpty())

    def fuzzied(self, rules: Sequence[fuzzy.FuzzyRule] = fuzzy.DEFAULT_RULES) -> CaptureQuery | None:
        """The query that looks for what may stand in: all of this one but its range, filters, closest and reverse."""
        found = fuzzy.rewrite(self.url, rules)
        if found is None:
            return None
        asked, key = F.lit(self.url), F.lit(url_key(self.url))
        general = lambda rows: rows.where(fuzzy.accepts(asked, key, F.col("url"), F.col("urlkey"), F.col("mime"), F.col("status")))
        limit = fuzzy.FUZZY_LIMIT if self.limit == ops.DEFAULT_LIMIT else self.limit
        after = (*self.after, general) if found.rule.prefixes == ("",) else self.after
        return replace(self, url=found.url, match_type=found.match_type, filters=tuple(sorted(found.filters)), closest=None, reverse=False, limit=limit, allow_fuzzy=False, after=after)

    def render(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """One text line (column ``line``) a row."""
        if self.output == "link":
            return timeline.timemap(rows, prefix).select(F.col("link").alias("line"))
        shown = self.fields or tuple(c for c in ops.FIELDS if c in rows.columns)
        if self.output == "text":
            have = rows.withColumns({f: F.lit(None).cast("string") for f in shown if f not in rows.columns})
            return have.select(ingest.text_line(shown).alias("line"))
        shown = tuple(f for f in shown if f in rows.columns)
        if self.output == "json":
            return rows.select(ingest.json_line(shown).alias("line"))
        return rows.select(ingest.cdxj_line(tuple(f for f in shown if f not in ("urlkey", "timestamp"))).alias("line"))
