"""Queries over the standard tables, one for each operator, and the SQL that says what they return."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import payload, rewrite, scanning, scripts, sniffing, times, urls
from tidemark.operators import access, building, captures, fuzzy, ingest, ordering, timeline
from tidemark.operators.access import Rule
from tidemark.plans import views
from tidemark.plans.query import CaptureQuery
from tidemark.sources import archives, blocks, resources, writing
from tidemark.sources import text as lines
from tidemark.streaming import archives as stream_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def contract(sql: str | None) -> Callable:
    def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return register


KEYS = "urlkey, timestamp, seq"
E = f"WITH e AS ({views.EVENTS}) "
D = f"WITH d AS ({views.DOCUMENTS}) "
RESOLVED = f"""WITH e AS ({views.EVENTS}), o AS (
  SELECT *, first_value(CASE WHEN mime <> 'warc/revisit' THEN struct_pack(m := mime, s := status, l := length, o := "offset", f := filename) END IGNORE NULLS)
    OVER (PARTITION BY digest ORDER BY urlkey, timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM e),
r AS (SELECT urlkey, timestamp, seq, CASE WHEN mime = 'warc/revisit' AND x IS NOT NULL THEN x.m ELSE mime END AS mime, CASE WHEN mime = 'warc/revisit' AND x IS NOT NULL THEN x.s ELSE status END AS status,
  CASE WHEN mime = 'warc/revisit' THEN coalesce(x.l, '-') ELSE '-' END AS orig_length, CASE WHEN mime = 'warc/revisit' THEN coalesce(x.o, '-') ELSE '-' END AS orig_offset,
  CASE WHEN mime = 'warc/revisit' THEN coalesce(x.f, '-') ELSE '-' END AS orig_filename FROM o) """


# --- key matches ---------------------------------------------------------------------------------------------------


def _keys(df: DataFrame) -> DataFrame:
    return df.select("urlkey", "timestamp", "seq")


@contract(E + f"SELECT {KEYS} FROM e WHERE urlkey = 'com,example,u12)/view'")
def match_exact(spark, d):
    return _keys(captures.match(views.events(spark, d), "http://www.u12.example.com/view/"))


@contract(E + f"SELECT {KEYS} FROM e WHERE starts_with(urlkey, 'com,example,u12)/s')")
def match_prefix(spark, d):
    return _keys(captures.match(views.events(spark, d), "http://u12.example.com/s*"))


@contract(E + f"SELECT {KEYS} FROM e WHERE starts_with(urlkey, 'com,example,u12)/')")
def match_host(spark, d):
    return _keys(captures.match(views.events(spark, d), "http://u12.example.com/any?x=1", "host"))


@contract(E + f"SELECT {KEYS} FROM e WHERE urlkey >= 'com,example)/' AND urlkey < 'com,example-'")
def match_domain(spark, d):
    return _keys(captures.match(views.events(spark, d), "*.example.com"))


@contract(E + f"SELECT {KEYS} FROM e WHERE urlkey >= 'com,' AND urlkey < 'com-'")
def match_tld(spark, d):
    return _keys(captures.match(views.events(spark, d), "http://com/", "domain"))


# --- filters -------------------------------------------------------------------------------------------------------


@contract(E + f"SELECT {KEYS} FROM e WHERE contains(urlkey, 'sign')")
def filter_contains(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), "urlkey:sign"))


@contract(E + f"SELECT {KEYS} FROM e WHERE status = '404'")
def filter_exact(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), "=statuscode:404"))


@contract(E + f"SELECT {KEYS} FROM e WHERE regexp_matches(mime, '^(?:text/.*ml)') AND NOT regexp_matches(urlkey, '^(?:view)')")
def filter_regex(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), ["~mime:text/.*ml", "!~urlkey:view"]))


@contract(E + f"SELECT {KEYS} FROM e WHERE NOT contains(mime, 'revisit')")
def filter_negated(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), "!mime:revisit"))


@contract(E + f"SELECT {KEYS} FROM e WHERE status = '200' AND NOT contains(urlkey, 'view') AND contains(filename, 'arc-1')")
def filter_multi(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), ["=status:200", "!urlkey:view", "filename:arc-1"]))


@contract(E + f"SELECT {KEYS} FROM e WHERE status = '404'")
def filter_missing_field(spark, d):
    """A field that no row has: a negated filter passes, another does not."""
    return _keys(captures.filter_rows(views.events(spark, d), ["!nosuch:x", "=status:404"]))


@contract(E + f"SELECT {KEYS} FROM e WHERE contains(concat_ws(' ', urlkey, timestamp, url, mime, status, digest, redirect, robotflags, length, \"offset\", filename), 'D7_1 - -')")
def filter_whole_line(spark, d):
    return _keys(captures.filter_rows(views.events(spark, d), "D7_1 - -"))


@contract(E + f"SELECT {KEYS} FROM e WHERE length = '200'")
def filter_alias_length(spark, d):
    """The alias s is the length, not the status."""
    return _keys(captures.filter_rows(views.events(spark, d), "=s:200"))


@contract(E + f"SELECT {KEYS} FROM e WHERE timestamp >= '20240105000000' AND timestamp <= '20240110120000'")
def clamp_range(spark, d):
    return _keys(captures.clamp(views.events(spark, d), "20240105", "20240110120000"))


@contract(E + f"SELECT {KEYS} FROM e WHERE timestamp >= '20240101000000' AND timestamp <= '20240112235959'")
def clamp_partial_pad(spark, d):
    return _keys(captures.clamp(views.events(spark, d), "2024", "20240112"))


# --- revisits, collapse, order -------------------------------------------------------------------------------------

_RESOLVED_COLUMNS = ["urlkey", "timestamp", "seq", "mime", "status", "orig_length", "orig_offset", "orig_filename"]


@contract(RESOLVED + f"SELECT {', '.join(_RESOLVED_COLUMNS)} FROM r")
def resolve_revisits(spark, d):
    return captures.resolve_revisits(views.events(spark, d)).select(*_RESOLVED_COLUMNS)


@contract(RESOLVED + f"SELECT {KEYS}, orig_offset FROM r WHERE mime = 'text/html' AND status = '404'")
def resolve_then_filter(spark, d):
    return captures.filter_rows(captures.resolve_revisits(views.events(spark, d)), ["=mime:text/html", "=status:404"]).select("urlkey", "timestamp", "seq", "orig_offset")


def _collapsed(source: str, digits: int) -> str:
    return f", c AS (SELECT *, lag(substr(timestamp, 1, {digits}) || '|' || status) OVER (ORDER BY urlkey, timestamp, seq) AS p FROM {source}) SELECT {KEYS} FROM c WHERE p IS NULL OR p <> substr(timestamp, 1, {digits}) || '|' || status"


@contract(E.rstrip() + _collapsed("e", 6))
def collapse_global(spark, d):
    return _keys(captures.collapse(views.events(spark, d), 6))


@contract(E.rstrip() + _collapsed("e", 8))
def collapse_days(spark, d):
    return _keys(captures.collapse(views.events(spark, d), 8))


@contract(RESOLVED.rstrip() + _collapsed("r", 6))
def collapse_after_resolve(spark, d):
    return _keys(captures.collapse(captures.resolve_revisits(views.events(spark, d)), 6))


_DISTANCE = "abs(epoch(strptime(timestamp, '%Y%m%d%H%M%S')) - epoch(TIMESTAMP '{0}'))"


@contract(E + f"SELECT {KEYS} FROM e ORDER BY {_DISTANCE.format('2024-01-15 12:00:00')}, urlkey, timestamp, seq LIMIT 25")
def closest_topk(spark, d):
    return _keys(captures.closest(views.events(spark, d), "20240115120000", 25))


@contract(E + f"SELECT {KEYS} FROM e WHERE urlkey = 'com,example,u7)/click' ORDER BY {_DISTANCE.format('2024-01-01 00:00:00')}, urlkey, timestamp, seq LIMIT 3")
def closest_partial_time(spark, d):
    return _keys(captures.closest(captures.match(views.events(spark, d), "u7.example.com/click"), "2024", 3))


@contract("""SELECT r.request_id, e.timestamp, e.seq FROM (SELECT custkey AS request_id, 'com,example,u' || (custkey % 150) || ')/view' AS k, strftime(d, '%Y%m%d%H%M%S') AS w FROM
 (SELECT o_orderkey AS custkey, make_timestamp((1704067200 + (o_orderkey * 7919) % 2592000) * 1000000) AS d FROM orders)) r, LATERAL (SELECT timestamp, seq FROM (""" + views.EVENTS + """) x WHERE x.urlkey = r.k
 ORDER BY abs(epoch(strptime(x.timestamp, '%Y%m%d%H%M%S')) - epoch(strptime(r.w, '%Y%m%d%H%M%S'))), x.timestamp, x.seq LIMIT 1) e""")
def replay_nearest(spark, d):
    """The capture nearest to each request: an as-of join in both directions."""
    o = views.table(spark, d, "orders")
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("o_orderkey") * 7919 % 2_592_000), "yyyyMMddHHmmss")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("com,example,u"), (F.col("o_orderkey") % 150).cast("string"), F.lit(")/view")).alias("urlkey"), at.alias("wanted"))
    return fuzzy.nearest(views.events(spark, d).select("urlkey", "timestamp", "seq"), asked, ["urlkey"], "wanted").select("request_id", "timestamp", "seq")


@contract(E + f"SELECT {KEYS} FROM e ORDER BY urlkey DESC, timestamp DESC, seq DESC LIMIT 40")
def reverse_limit(spark, d):
    return _keys(captures.last(views.events(spark, d), 40))


@contract(E + f"SELECT {KEYS} FROM e ORDER BY urlkey, timestamp, seq LIMIT 40")
def limit_plain(spark, d):
    return _keys(captures.first(views.events(spark, d), 40))


@contract(E + f"SELECT {KEYS} FROM e WHERE urlkey = 'com,example,u3)/error'")
def limit_zero_is_all(spark, d):
    return _keys(captures.first(captures.match(views.events(spark, d), "u3.example.com/error"), 0))


@contract(E + "SELECT concat_ws(' ', urlkey, timestamp, '-', status, filename) AS line FROM e WHERE status = '404'")
def fields_text(spark, d):
    q = CaptureQuery.parse({"url": "*.example.com", "filter": "=status:404", "fields": "urlkey,timestamp,nosuch,status,filename", "output": "text", "limit": "0"})
    return q.render(q.run(views.events(spark, d)))


@contract(E + "SELECT urlkey || ' ' || timestamp || ' ' || '{\"status\":\"' || status || '\",\"filename\":\"' || filename || '\"}' AS line FROM e WHERE starts_with(urlkey, 'com,example,u9)')")
def fields_cdxj(spark, d):
    q = CaptureQuery.parse({"url": "http://u9.example.com/", "matchType": "host", "fl": "status,filename", "limit": "0"})
    return q.render(q.run(views.events(spark, d)))


@contract(E + "SELECT urlkey, timestamp, seq, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS source, 'all' AS source_coll FROM e")
def source_union_tagged(spark, d):
    e = views.events(spark, d)
    return captures.union({"even": e.where("seq % 2 = 0"), "odd": e.where("seq % 2 = 1")}, "all").select("urlkey", "timestamp", "seq", "source", "source_coll")


@contract(E + "SELECT urlkey, timestamp, seq FROM e WHERE seq % 3 <> 0")
def source_exclusion(spark, d):
    e = views.events(spark, d)
    parts = {f"part{k}": e.where(f"seq % 3 = {k}") for k in range(3)}
    return _keys(captures.union({n: parts[n] for n in captures.choose_sources(list(parts), "!part0")}))


@contract(E + f"SELECT DISTINCT {KEYS} FROM e")
def index_merge_distinct(spark, d):
    """Two indexes that hold all captures between them, and a third of them both."""
    e = _keys(views.events(spark, d))
    return captures.merge_distinct(e.where("seq % 3 <> 0"), e.where("seq % 3 <> 1"))


# --- URL and scalar functions --------------------------------------------------------------------------------------


@contract(f"SELECT page_id, {views.surt_sql('url')} AS urlkey FROM pages")
def surt_pages(spark, d):
    return views.table(spark, d, "pages").select("page_id", urls.surt(F.col("url")).alias("urlkey"))


@contract(f"""SELECT page_id, array_to_string(list_reverse(string_split(split_part(k, ')/', 1), ',')), '.') || '/' || substr(k, strpos(k, ')/') + 2) AS url FROM (SELECT page_id, {views.surt_sql('url')} AS k FROM pages)""")
def unsurt_pages(spark, d):
    return views.table(spark, d, "pages").select("page_id", urls.unsurt(urls.surt(F.col("url"))).alias("url"))


@contract("SELECT page_id, regexp_extract(regexp_extract(split_part(url, '?', 1), '[^/]*$', 0), '[^.]\\.([^.]*)$', 1) AS ext FROM pages")
def url_extension(spark, d):
    return views.table(spark, d, "pages").select("page_id", urls.extension(F.col("url")).alias("ext"))


#: Archival URLs by form: text with {u} for a page's URL, and the type, timestamps, modifier and URL that it stands for.
_FORMS = [
    ("20240101{h}/{u}", "replay", "20240101{h}", "", "", "{u}"), ("20240101{h}id_/{u}", "replay", "20240101{h}", "", "id_", "{u}"), ("2014wkrf_/{u}", "replay", "2014", "", "wkrf_", "{u}"),
    ("2014$br:edge-1.0/{u}", "replay", "2014", "", "$br:edge-1.0", "{u}"), ("im_/{u}", "latest_replay", "", "", "im_", "{u}"), ("{u}", "latest_replay", "", "", "", "{u}"), ("2010-2011/{u}", "query", "2010", "2011", "", "{u}"),
    ("2010*2011/{u}", "query", "2010", "2011", "", "{u}"), ("*/{u}*", "url_query", "", "", "", "{u}"), ("2014*/{u}", "query", "2014", "", "", "{u}"), ("vi_/2014*/{u}", "query", "2014", "", "vi_", "{u}"), ("2014///example.com/a", "replay", "2014", "", "", "http://example.com/a"),
    ("2014/example.com/{h}", "replay", "2014", "", "", "http://example.com/{h}"), ("2014/http:/example.com/{h}", "replay", "2014", "", "", "http://example.com/{h}"), ("*/example.com*", "url_query", "", "", "", "http://example.com"),
]


@contract(
    "SELECT page_id, f.type, replace(f.timestamp, '{h}', h) AS timestamp, f.end_timestamp, f.modifier, replace(replace(f.url, '{u}', u), '{h}', h) AS url FROM (SELECT page_id, rtrim(split_part(url, '#', 1), '*') AS u, lpad(CAST(page_id % 24 AS VARCHAR), 2, '0') AS h FROM pages), (VALUES "
    + ", ".join(str(f[1:]) for f in _FORMS) + ") f(type, timestamp, end_timestamp, modifier, url)"
)
def wburl_parse(spark, d):
    p = views.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"\*+$", "").alias("u"), F.lpad((F.col("page_id") % 24).cast("string"), 2, "0").alias("h"))
    texts = p.withColumn("form", F.explode(F.array(*(F.lit(f[0]) for f in _FORMS))))
    text = F.replace(F.replace("form", F.lit("{u}"), F.col("u")), F.lit("{h}"), F.col("h"))
    return texts.select("page_id", urls.archival_url(text).alias("w")).select("page_id", "w.*")


@contract("SELECT event_id, substr(t, 1, 4) AS year, substr(t, 5, 2) AS month, substr(t, 7, 2) AS day, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http_date FROM (SELECT event_id, ts, strftime(ts, '%Y%m%d%H%M%S') AS t FROM events)")
def timestamp_parts(spark, d):
    ts = F.col("timestamp")
    return views.events(spark, d).select(F.col("seq").alias("event_id"), F.substring(ts, 1, 4).alias("year"), F.substring(ts, 5, 2).alias("month"), F.substring(ts, 7, 2).alias("day"), times.http_date(ts).alias("http_date"))


@contract("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unk' ELSE 'text/' || lang END AS mime, CASE WHEN doc_id % 5 = 0 THEN '-' WHEN doc_id % 5 = 1 THEN '-' ELSE '200' END AS status, sha1(text) AS digest FROM documents""")
def mime_status_parse(spark, d):
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("text/"), F.col("lang"), F.lit("; charset=utf-8")))
    line = F.when(k % 5 == 0, "").when(k % 5 == 1, "HTTP/1.1 204 Error").otherwise("HTTP/1.1 200 OK")
    return views.table(spark, d, "documents").select("doc_id", payload.mime_of(kind).alias("mime"), payload.status_of(line).alias("status"), payload.digest_of(F.concat(F.lit("sha1:"), F.sha1("text"))).alias("digest"))


# --- timeline, paging ----------------------------------------------------------------------------------------------

_PARTS = "CAST(substr(timestamp, 1, 4) AS INTEGER) AS year, CAST(substr(timestamp, 5, 2) AS INTEGER) AS month, CAST(substr(timestamp, 7, 2) AS INTEGER) AS day, CAST(floor(CAST(substr(timestamp, 9, 2) AS INTEGER) / 3) + 1 AS INTEGER) AS bucket"


@contract(E + f"SELECT year, month, day, bucket, count(*) AS captures, CASE WHEN count(*) = 1 THEN min(timestamp) END AS only FROM (SELECT *, {_PARTS} FROM e) GROUP BY ROLLUP (year, month, day, bucket)")
def timeline_rollup(spark, d):
    return timeline.rollup(views.events(spark, d))


@contract(E + f"SELECT bucket, count(*) AS captures FROM (SELECT *, {_PARTS} FROM e) GROUP BY bucket")
def timeline_bucket8(spark, d):
    return timeline.parts(views.events(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("captures"))


@contract(D + "SELECT timestamp, seq FROM (SELECT *, lag(t) OVER (ORDER BY t, seq) AS p FROM (SELECT substr(timestamp, 1, 10) AS t, substr(timestamp, 1, 10) AS timestamp, seq FROM d)) WHERE p IS NULL OR p <> t")
def timeline_dedupe(spark, d):
    docs = views.documents(spark, d).select(F.lit("k").alias("urlkey"), F.substring("timestamp", 1, 10).alias("timestamp"), "seq")
    return timeline.dedupe(docs).select("timestamp", "seq")


@contract(E + """, c AS (SELECT urlkey, CAST(strptime(substr(timestamp, 1, 8), '%Y%m%d') AS DATE) AS day, count(*) AS n FROM e GROUP BY ALL)
SELECT s.urlkey, CAST(x AS DATE) AS day, coalesce(n, 0) AS captures FROM (SELECT urlkey, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS x FROM c GROUP BY urlkey) s LEFT JOIN c ON c.day = x AND c.urlkey = s.urlkey""")
def timeline_gapfill(spark, d):
    """Every URL's captures by day, from its first day to its last."""
    return timeline.filled_days(views.events(spark, d), "urlkey")


@contract(E + f"""SELECT year, max(top) AS most_in_day, CAST(max(n) AS BIGINT) AS most_in_month FROM (SELECT year, month, sum(n) AS n, max(n) AS top FROM (SELECT year, month, day, count(*) AS n FROM (SELECT *, {_PARTS} FROM e) GROUP BY ALL) GROUP BY year, month) GROUP BY year""")
def heatmap_max_grandchild(spark, d):
    return timeline.heat(views.events(spark, d))


_BLOCKS = E + ", b AS (SELECT lineno, min(urlkey || ' ' || timestamp) AS first_line_key, count(*) AS lines FROM (SELECT *, (row_number() OVER (ORDER BY urlkey, timestamp, seq) - 1) // 100 AS lineno FROM e) GROUP BY lineno)"
_HIT = ", f AS (SELECT coalesce(max(lineno), 0) AS floor FROM b WHERE first_line_key < 'com,example,u1'), h AS (SELECT b.* FROM b, f WHERE lineno >= floor AND first_line_key < 'com,example,u2')"


@contract(_BLOCKS + " SELECT lineno, first_line_key, lines FROM b")
def block_index(spark, d):
    return timeline.blocks(views.events(spark, d), 100)


@contract(_BLOCKS + _HIT + " SELECT coalesce(max(lineno) - min(lineno), 0) AS blocks, CASE WHEN count(*) = 0 THEN 0 ELSE (max(lineno) - min(lineno)) // 10 + 1 END AS pages, CAST(10 AS BIGINT) AS page_size FROM h")
def page_count(spark, d):
    return timeline.page_count(timeline.blocks(views.events(spark, d), 100), "com,example,u1", "com,example,u2", 10)


@contract(_BLOCKS + _HIT + " SELECT lineno, first_line_key, lines FROM h WHERE lineno - (SELECT min(lineno) FROM h) BETWEEN 4 AND 7")
def page_slice(spark, d):
    return timeline.page(timeline.blocks(views.events(spark, d), 100), "com,example,u1", "com,example,u2", 1, 4)


@contract(E + """SELECT urlkey, timestamp, seq, '<http://archive.example/' || timestamp || '/' || url || '>; rel="memento"; datetime="' || strftime(strptime(timestamp, '%Y%m%d%H%M%S'), '%a, %d %b %Y %H:%M:%S GMT') || '"'
 || CASE WHEN row_number() OVER (ORDER BY urlkey DESC, timestamp DESC, seq DESC) = 1 THEN '' ELSE ',' END AS link FROM e WHERE starts_with(urlkey, 'com,example,u5)/')""")
def timemap_links(spark, d):
    return timeline.timemap(captures.match(views.events(spark, d), "u5.example.com", "host"), "http://archive.example/")


# --- access --------------------------------------------------------------------------------------------------------

_RULES = (
    Rule("com,example,u1", "block"), Rule("com,example,u12)/view", "exclude"), Rule("com,example,u12)/", "allow"), Rule("com,example,u3)/click###", "exclude"), Rule("com,example,u3)/", "block"),
    Rule("com,example,u3)/", "allow", user="staff"), Rule("*,", "allow"), Rule("com,example,u4)/", "block", before="20240110"), Rule("com,example,u5)/", "exclude", newer={"days": 10}), Rule("com,example,u6)/", "block", older={"weeks": 2}),
)
_AS_OF = datetime(2024, 2, 1)
_RULES_SQL = """, r(k, access, usr, exact) AS (VALUES ('com,example,u1', 'block', NULL, FALSE), ('com,example,u12)/view', 'exclude', NULL, FALSE), ('com,example,u12)/', 'allow', NULL, FALSE), ('com,example,u3)/click', 'exclude', NULL, TRUE),
 ('com,example,u3)/', 'block', NULL, FALSE), ('com,example,u3)/', 'allow', 'staff', FALSE), ('', 'allow', NULL, FALSE), ('com,example,u4)/', 'D4', NULL, FALSE), ('com,example,u5)/', 'D5', NULL, FALSE), ('com,example,u6)/', 'D6', NULL, FALSE)),
 m AS (SELECT e.urlkey, e.timestamp, e.seq, arg_max(r.access, length(r.k) * 4 + CASE WHEN exact THEN 2 ELSE 0 END + CASE WHEN usr IS NULL THEN 0 ELSE 1 END) AS a
  FROM e JOIN r ON (CASE WHEN exact THEN e.urlkey = r.k ELSE starts_with(e.urlkey, r.k) END) AND (usr IS NULL OR usr = '{user}') GROUP BY ALL),
 g AS (SELECT urlkey, timestamp, seq, CASE a WHEN 'D4' THEN CASE WHEN timestamp < '20240110000000' THEN 'block' ELSE 'allow' END WHEN 'D5' THEN CASE WHEN timestamp > '20240122000000' THEN 'exclude' ELSE 'allow' END
  WHEN 'D6' THEN CASE WHEN timestamp < '20240118000000' THEN 'block' ELSE 'allow' END ELSE a END AS access FROM m) """


def _access(df: DataFrame) -> DataFrame:
    return df.select("urlkey", "timestamp", "seq", "access")


@contract(E.rstrip() + _RULES_SQL.format(user="nobody") + f"SELECT {KEYS}, access FROM g WHERE access <> 'exclude'")
def acl_best_rule(spark, d):
    return _access(access.control(views.events(spark, d), _RULES, as_of=_AS_OF))


@contract(E.rstrip() + _RULES_SQL.format(user="staff") + f"SELECT {KEYS}, access FROM g WHERE access <> 'exclude'")
def acl_user_rule(spark, d):
    return _access(access.control(views.events(spark, d), _RULES, user="staff", as_of=_AS_OF))


@contract(E.rstrip() + _RULES_SQL.format(user="nobody").replace("('', 'allow', NULL, FALSE),", "('', 'allow', NULL, FALSE), ('com,example,u4', 'D4', NULL, FALSE), ('com,example,u7', 'D7', NULL, FALSE),").replace("ELSE a END", "WHEN 'D7' THEN CASE WHEN timestamp > '20240105000000' THEN 'block' ELSE 'allow' END ELSE a END") + f"SELECT {KEYS}, access FROM g WHERE access <> 'exclude'")
def acl_date_rule(spark, d):
    """All rules over all captures, with two more that hold before or after a date."""
    rules = (*_RULES, Rule("com,example,u4", "block", before="20240110"), Rule("com,example,u7", "block", after="20240105"))
    return _access(access.control(views.events(spark, d), rules, as_of=_AS_OF))


@contract(E + f"SELECT {KEYS}, CASE WHEN timestamp < '20240107000000' THEN 'block' ELSE 'allow' END AS access FROM e")
def embargo_before(spark, d):
    return _access(access.control(views.events(spark, d), (), embargo=Rule("", "block", before="20240107"), as_of=_AS_OF))


@contract(E + f"SELECT {KEYS}, 'allow' AS access FROM e WHERE NOT timestamp < '20240101000000' AND NOT timestamp < '20240115000000'")
def embargo_older_asof(spark, d):
    return _access(access.control(views.events(spark, d), (), embargo=Rule("", "exclude", older={"days": 17}), as_of=_AS_OF))


@contract(E.rstrip() + _RULES_SQL.format(user="nobody") + f"SELECT {KEYS}, CASE WHEN timestamp > '20240120000000' THEN 'block' ELSE access END AS access FROM g WHERE access <> 'exclude'")
def acl_embargo_combined(spark, d):
    return _access(access.control(views.events(spark, d), _RULES, embargo=Rule("", "block", after="20240120"), as_of=_AS_OF))


@contract(E + ", l AS (SELECT * FROM e WHERE starts_with(urlkey, 'com,example,u12)/') ORDER BY urlkey, timestamp, seq LIMIT 60) SELECT urlkey, timestamp, seq, 'allow' AS access FROM l WHERE urlkey <> 'com,example,u12)/view'")
def limit_before_acl(spark, d):
    """Excluded rows use up the limit."""
    q = CaptureQuery.parse({"url": "u12.example.com/", "matchType": "host", "limit": "60"})
    return _access(q.run(views.events(spark, d), _RULES, as_of=_AS_OF))


@contract(E.rstrip() + _RULES_SQL.format(user="nobody") + f"SELECT {KEYS}, access FROM g WHERE access <> 'exclude'")
def acl_joined(spark, d):
    """As acl_best_rule, by the join that rules of any number take."""
    return _access(access.joined_access(views.events(spark, d), _RULES, as_of=_AS_OF).withColumnRenamed("_rule", "access").where("access <> 'exclude'"))


#: A rule for every second user and type of event, a third of them dated, and one for everything else.
_MANY = [
    Rule(f"com,example,u{u})/{kind}" + ("###" if u % 4 == 0 else ""), ("block", "exclude", "allow_ignore_embargo")[(u + k) % 3], **({"before": "20240115"} if (u + k) % 9 == 0 else {"after": "20240115"} if (u + k) % 9 == 1 else {"older": {"days": 17}} if (u + k) % 9 == 2 else {}))
    for u in range(0, 1000, 2) for k, kind in enumerate(("click", "error", "purchase", "signup", "view"))
] + [Rule("*,", "block", after="20240125")]


@contract(E + f""", r AS (SELECT 'com,example,u' || u || ')/' || kind AS k, u % 4 = 0 AS exact, (u + i) % 3 AS a, (u + i) % 9 AS c
  FROM range(0, 1000, 2) x(u), (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) y(i, kind)),
 j AS (SELECT e.*, ['block', 'exclude', 'allow_ignore_embargo'][a + 1] AS given, c FROM e LEFT JOIN r ON r.k = e.urlkey),
 g AS (SELECT *, CASE WHEN given IS NULL THEN CASE WHEN timestamp > '20240125000000' THEN 'block' ELSE 'allow' END WHEN c = 0 THEN CASE WHEN timestamp < '20240115000000' THEN given ELSE 'allow' END
  WHEN c = 1 THEN CASE WHEN timestamp > '20240115000000' THEN given ELSE 'allow' END WHEN c = 2 THEN CASE WHEN timestamp < '20240115000000' THEN given ELSE 'allow' END ELSE given END AS access FROM j)
SELECT {KEYS}, CASE access WHEN 'allow_ignore_embargo' THEN 'allow' ELSE access END AS access FROM g WHERE access <> 'exclude'""")
def acl_2500_rules(spark, d):
    """Rules in number, with dates."""
    return _access(access.control(views.events(spark, d), _MANY, as_of=_AS_OF))


# --- fuzzy ---------------------------------------------------------------------------------------------------------

_NORMAL = "regexp_replace({0}, '[?&]utm_[^=]+=[^&]+', '', 'g')"


@contract(f"SELECT page_id, {_NORMAL.format('k')} AS normal FROM (SELECT page_id, {views.surt_sql('url')} AS k FROM pages)")
def fuzzy_normalize_match(spark, d):
    return views.table(spark, d, "pages").select("page_id", fuzzy.steps(urls.surt(F.col("url")))[1].alias("normal"))


_ASKED = "SELECT page_id AS request_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=x' || page_id ELSE url END AS url FROM pages"


@contract(f"""WITH c AS (SELECT page_id AS seq, url, {views.surt_sql('url')} AS urlkey FROM pages), a AS (SELECT request_id, {views.surt_sql('url')} AS k FROM ({_ASKED})),
 direct AS (SELECT request_id, seq, FALSE AS is_fuzzy FROM a JOIN c ON a.k = c.urlkey), missing AS (SELECT * FROM a WHERE request_id NOT IN (SELECT request_id FROM direct))
SELECT * FROM direct UNION ALL SELECT request_id, seq, TRUE FROM missing JOIN c ON {_NORMAL.format('missing.k')} = {_NORMAL.format('c.urlkey')}""")
def fuzzy_batch_fallback(spark, d):
    p = views.table(spark, d, "pages")
    index = p.select(urls.surt(F.col("url")).alias("urlkey"), F.lit("20240101000000").alias("timestamp"), F.col("page_id").alias("seq"), "url", F.lit("text/html").alias("mime"), F.lit("200").alias("status"))
    noise = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_campaign=x"), F.col("page_id").cast("string"))
    asked = p.select(F.col("page_id").alias("request_id"), F.when(F.col("page_id") % 3 == 0, noise).otherwise(F.col("url")).alias("url"))
    return fuzzy.lookup(index, asked).select("request_id", "seq", "is_fuzzy")


def _noisy(spark, d, noise: str) -> DataFrame:
    """A capture for each event, of one page whose query names the user and carries noise that differs from capture to capture."""
    e = views.events(spark, d)
    url = F.concat(F.lit("http://shop.example.com/item?id="), F.regexp_extract("url", r"//u(\d+)", 1), F.lit("&"), F.replace(F.lit(noise), F.lit("{n}"), F.col("seq").cast("string")))
    return e.withColumns({"url": url, "mime": F.lit("text/html")}).withColumn("urlkey", urls.surt(F.col("url")))


_NOISY = "SELECT timestamp, seq FROM e WHERE user_id = '7' AND timestamp BETWEEN '20240105000000' AND '20240120235959'"
_OF_USER = "WITH e AS (SELECT *, regexp_extract(url, '//u([0-9]+)', 1) AS user_id FROM (" + views.EVENTS + ")) "


@contract(_OF_USER + _NOISY)
def fuzzy_keeps_clamp(spark, d):
    """The search for a stand-in keeps from and to."""
    q = CaptureQuery.parse({"url": "http://shop.example.com/item?id=7&utm_source=me", "from": "20240105", "to": "20240120", "limit": "0"})
    return q.run(_noisy(spark, d, "utm_source={n}")).select("timestamp", "seq")


@contract(_OF_USER + _NOISY)
def fuzzy_jquery(spark, d):
    """Callbacks that a script library numbers are noise."""
    q = CaptureQuery.parse({"url": "http://shop.example.com/item?id=7&back=jquery1_1", "from": "20240105", "to": "20240120", "limit": "0"})
    return q.run(_noisy(spark, d, "back=jquery{n}_1")).select("timestamp", "seq")


@contract(_OF_USER + "SELECT timestamp, seq FROM e WHERE timestamp BETWEEN '20240105000000' AND '20240120235959'")
def fuzzy_no_groups(spark, d):
    """A rule whose expression has no groups says only that it applies: captures of the page with any arguments may stand in."""
    rule = fuzzy.FuzzyRule.of({"url_prefix": "com,example,shop)/", "fuzzy_lookup": "[?&]id=7"})
    q = CaptureQuery.parse({"url": "http://shop.example.com/item?id=7&z=0", "from": "20240105", "to": "20240120", "limit": "0"})
    return q.run(_noisy(spark, d, "z={n}"), fuzzy_rules=(rule,)).select("timestamp", "seq")


@contract(_OF_USER + _NOISY)
def fuzzy_findall(spark, d):
    """A rule of its own takes all matching arguments as filters, and drops others."""
    rule = fuzzy.FuzzyRule.of({"url_prefix": "com,example,shop)/", "fuzzy_lookup": {"match": "[?&](id=[^&]+)", "filter": ["~urlkey:.*[?&]{0}(&|$)"], "re_type": "findall"}})
    q = CaptureQuery.parse({"url": "http://shop.example.com/item?id=7&z=0", "from": "20240105", "to": "20240120", "limit": "0"})
    return q.run(_noisy(spark, d, "z={n}"), fuzzy_rules=(rule, *fuzzy.DEFAULT_RULES)).select("timestamp", "seq")


# --- ingest --------------------------------------------------------------------------------------------------------


@contract(D + """, x AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY timestamp, seq) AS n, first_value(url) OVER (PARTITION BY digest ORDER BY timestamp, seq) AS u, first_value(timestamp) OVER (PARTITION BY digest ORDER BY timestamp, seq) AS t FROM d)
SELECT seq, CASE WHEN n = 1 THEN 'write' ELSE 'revisit' END AS action, CASE WHEN n > 1 THEN u END AS refers_url, CASE WHEN n > 1 THEN t END AS refers_timestamp FROM x""")
def ingest_revisit_policy(spark, d):
    return ingest.dedup_revisits(views.documents(spark, d)).select("seq", "action", "refers_url", "refers_timestamp")


@contract(D + "SELECT url, timestamp, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp, seq) AS n FROM d) WHERE n = 1")
def ingest_skip_policy(spark, d):
    return ingest.dedup_skip(views.documents(spark, d).select("url", "timestamp", "seq"))


@contract(E + """, v AS (SELECT seq, digest, url AS refers_to_uri, strftime(strptime(timestamp, '%Y%m%d%H%M%S') - INTERVAL 36 HOUR, '%Y%m%d%H%M%S') AS refers_to_date, urlkey FROM e WHERE mime = 'warc/revisit'),
 j AS (SELECT v.seq, o."offset" AS o, o.filename AS f, row_number() OVER (PARTITION BY v.seq ORDER BY abs(epoch(strptime(o.timestamp, '%Y%m%d%H%M%S')) - epoch(strptime(v.refers_to_date, '%Y%m%d%H%M%S'))), o.timestamp, o.seq) AS n
  FROM v JOIN e o ON o.urlkey = v.urlkey AND o.digest = v.digest AND o.mime <> 'warc/revisit')
SELECT v.seq, j.o AS payload_offset, j.f AS payload_filename FROM v LEFT JOIN j ON j.seq = v.seq AND j.n = 1""")
def cross_url_revisit(spark, d):
    e = views.events(spark, d)
    before = F.date_format(times.moment(F.col("timestamp")) - F.expr("interval 36 hours"), "yyyyMMddHHmmss")
    revisits = e.where("mime = 'warc/revisit'").select("seq", "digest", F.col("url").alias("refers_to_uri"), before.alias("refers_to_date"))
    return ingest.cross_url(revisits, e.where("mime <> 'warc/revisit'")).select("seq", "payload_offset", "payload_filename")


@contract("""SELECT 'r' || o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'POST' END AS request_method, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'http://ref/' || o_custkey END AS request_referer FROM orders""")
def request_response_join(spark, d):
    o = views.table(spark, d, "orders")
    k, text = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    null = F.lit(None).cast("string")
    url = text("http://site/", k)
    answers = o.select(F.lit("response").alias("record_type"), text("r", k).alias("record_id"), F.when(k % 3 == 1, text("q", k)).alias("concurrent_to"), url.alias("target_uri"), null.alias("method"), null.alias("referer"))
    asks = o.select(F.lit("request").alias("record_type"), text("q", k).alias("record_id"), F.when(k % 3 == 2, text("r", k)).alias("concurrent_to"), url.alias("target_uri"), F.lit("POST").alias("method"), text("http://ref/", F.col("o_custkey")).alias("referer"))
    return ingest.join_requests(answers.unionByName(asks)).select("record_id", "request_method", "request_referer")


@contract("""WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros FROM g GROUP BY ALL""")
def idle_sessions(spark, d):
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "user_id", "ts", 3600).select("user_id", F.col("session").cast("long"), "events", (F.unix_micros("end") - F.unix_micros("start")).alias("micros"))


@contract(D + "SELECT collection, seq, CAST(floor(coalesce(sum(length) OVER (PARTITION BY collection ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS BIGINT) AS file_no FROM d")
def size_rollover(spark, d):
    return ingest.rollover(views.documents(spark, d), 20_000).select("collection", "seq", "file_no")


@contract(E + "SELECT urlkey, timestamp, url, mime, status, digest, length, \"offset\", filename FROM e")
def text_lines_parse(spark, d):
    """Captures written as text, every other one as JSON, and read again."""
    e = views.events(spark, d)
    written = e.select(F.when(F.col("seq") % 2 == 0, ingest.text_line()).otherwise(ingest.cdxj_line()).alias("line"))
    return lines.parse_lines(written).select("urlkey", "timestamp", "url", "mime", "status", "digest", "length", "offset", "filename")


@contract("""SELECT page_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || CASE WHEN page_id % 2 = 0 THEN '__wb_method=POST&n=' || page_id || '&n.2_=x&t=true' ELSE '__wb_method=PUT&a=' || page_id || '&b=c d' END AS url
 FROM (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)""")
def request_keys(spark, d):
    """URLs that requests with JSON and form bodies are keyed by."""
    k = F.col("page_id").cast("string")
    even = F.col("page_id") % 2 == 0
    body = F.when(even, F.concat(F.lit('{"n": '), k, F.lit(', "a": {"n": "x"}, "t": true}'))).otherwise(F.concat(F.lit("a="), k, F.lit("&b=c+d")))
    kind = F.when(even, "application/json").otherwise("application/x-www-form-urlencoded")
    url = F.regexp_replace("url", "#.*$", "")
    return views.table(spark, d, "pages").select("page_id", rewrite.request_key_url(url, F.when(even, "post").otherwise("PUT"), kind, body.cast("binary")).alias("url"))


# --- payload -------------------------------------------------------------------------------------------------------


@contract("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN TRUE WHEN page_id % 4 = 1 THEN FALSE WHEN page_id % 4 = 2 THEN FALSE ELSE TRUE END AS own FROM pages""")
def self_redirect_check(spark, d):
    p, k = views.table(spark, d, "pages"), F.col("page_id")
    status = F.when(k % 4 == 1, "304").otherwise("302")
    location = F.when(k % 4 == 2, "http://elsewhere.example/").when(k % 4 == 3, F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?:", "https:"), F.lit("#x"))).otherwise(F.col("url"))
    return p.select("page_id", payload.is_self_redirect(F.col("url"), status, location).alias("own"))


@contract("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) AS title FROM pages WHERE regexp_matches(html, '(?is)<title[^>]*>.*?</title')")
def html_title(spark, d):
    return views.table(spark, d, "pages").select("page_id", payload.title(F.col("html")).alias("title")).where("title is not null")


@contract("SELECT page_id, md5(regexp_replace(html, '((?:href|src)=[\"''])(https?://)', '\\1http://archive.example/2024/\\2', 'g')) AS digest FROM pages")
def html_links_rewrite(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.md5(payload.rewrite_links(F.col("html"), "http://archive.example/2024/")).alias("digest"))


@contract("SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?is)<head[^>]*>') THEN regexp_replace(html, '(?is)(<head[^>]*>)', '\\1<!-- top -->') ELSE '<!-- top -->' || html END) AS digest FROM pages")
def head_insert(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.md5(payload.insert_head(F.col("html"), "<!-- top -->")).alias("digest"))


@contract("SELECT page_id, 'a{background:url(\"/p/' || split_part(url, '#', 1) || '\")} @import \"/p/' || split_part(url, '#', 1) || '\";' AS css FROM pages")
def css_url_rewrite(spark, d):
    address = F.regexp_replace("url", "#.*$", "")
    css = F.concat(F.lit('a{background:url("'), address, F.lit('")} @import "'), address, F.lit('";'))
    return views.table(spark, d, "pages").select("page_id", payload.rewrite_css(css, "/p/").alias("css"))


@contract("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cb' || page_id ELSE 'jQ_1' END || '({\"a\":' || page_id || '});' AS body FROM pages")
def jsonp_swap(spark, d):
    k = F.col("page_id").cast("string")
    asked = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://x/?callback=cb"), k)).otherwise("http://x/?a=1")
    return views.table(spark, d, "pages").select("page_id", payload.swap_jsonp(F.concat(F.lit('jQ_1({"a":'), k, F.lit("});")), asked).alias("body"))


@contract("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN '[::1]:8080)/p' || page_id WHEN 1 THEN 'com,example,h' || page_id || ')/' WHEN 2 THEN 'com,example,h' || page_id || ':abc)/x' WHEN 3 THEN 'com,example)/a/c/' || page_id
 WHEN 4 THEN 'com,example)/~a/' || page_id || '?a=%c3%a9&b=1' WHEN 5 THEN 'com,example)/p' || page_id || '?a=' || page_id WHEN 6 THEN 'com,example)/100%25/' || page_id ELSE 'com,example,m)/q' || page_id || '.aspx?x=1' END AS urlkey FROM pages""")
def surt_forms(spark, d):
    """Addresses, ports, dot segments, escapes and session ids in keys."""
    k = F.col("page_id").cast("string")
    forms = (
        ("http://[::1]:8080/P", ""), ("\tH", ".example.com:80\n"), ("http://h", ".example.com:abc/x/"), ("http://www.example.com/a/./b/../c//", "#top"), ("http://u:p@example.com/%7Ea/", "?b=1&a=%C3%A9"),
        ("https://example.com:443/p", "?phpsessid=" + "0a" * 16 + "&a="), ("http://example.com/100%/", "/"), ("http://m.example.com/(S(4hqa0555fwsecu455xqckv45))/Q", ".aspx?x=1&"),
    )
    url = F.lit("")
    for n, (head, tail) in enumerate(forms):
        url = F.when(F.col("page_id") % 8 == n, F.concat(F.lit(head), k, F.lit(tail), k if n == 5 else F.lit(""))).otherwise(url)
    return views.table(spark, d, "pages").select("page_id", urls.surt(url).alias("urlkey"))


@contract("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'cb_' || page_id || '({"a": 1})' WHEN 1 THEN '/* c */n({"a": 1})' WHEN 2 THEN 'jq({"a": 1})' WHEN 3 THEN 'jq([1])' WHEN 4 THEN 'jq({"a": 1})' ELSE chr(47) || '/ c' || chr(10) || 'z({"a": 1})' END AS body FROM pages""")
def jsonp_forms(spark, d):
    """Which arguments name a callback, and which bodies have one: comments go before it, an object must follow."""
    k = F.col("page_id")
    forms = (
        ('jq({"a": 1})', F.concat(F.lit("http://x/?callback=cb_"), k.cast("string"))), ('/* c */jq({"a": 1})', F.lit("http://x/?callback=m&jsoncallback=n&b=1")), ('jq({"a": 1})', F.lit("http://x/?jsonp=n&cb=m")),
        ("jq([1])", F.lit("http://x/?callback=n")), ('jq({"a": 1})', F.lit("http://x/?callback=?")), ('// c\njq({"a": 1})', F.lit("http://x/?a=1&callback=z")),
    )
    body, asked = F.lit(forms[5][0]), forms[5][1]
    for n in range(5):
        body, asked = F.when(k % 6 == n, forms[n][0]).otherwise(body), F.when(k % 6 == n, forms[n][1]).otherwise(asked)
    return views.table(spark, d, "pages").select("page_id", payload.swap_jsonp(body, asked).alias("body"))


@contract("""SELECT page_id, sha256(regexp_replace(replace(html, 'track(', 'WB_wombat_top.WB_wombat_location="http://archive.example/web/2024mp_/http://t.example/x";track('), 'href="(/[^"]*)"',
 'href="/web/2024mp_/' || regexp_extract(url, '^https?://[^/?#]+') || '\\1"', 'g')) AS digest FROM pages""")
def html_rewrite(spark, d):
    """Whole pages through the rewriter of pages: links, and a script that sets the top location."""
    html = F.replace(F.col("html"), F.lit("track("), F.lit('top.location="http://t.example/x";track('))
    return views.table(spark, d, "pages").select("page_id", F.sha2(rewrite.rewrite("html", html, "http://archive.example/web/", F.lit("2024"), F.col("url"), scripts="located"), 256).alias("digest"))


@contract("""SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1) || ' location = ((self.__WB_check_loc && self.__WB_check_loc(location, arguments)) || {}).href = "' || url
 || '"; if (a != _____WB$wombat$check$this$function_____(this)) w.__WB_pmw(self).postMessage(' || page_id || '); b = self.eval; return _____WB$wombat$check$this$function_____(this) }' AS script FROM pages""")
def script_rewrite(spark, d):
    """The script of each page, and what reads the global object, as columns of one pass."""
    script = F.concat(F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1), F.lit(' location = "'), "url", F.lit('"; if (a != this) w.postMessage('), F.col("page_id").cast("string"), F.lit("); b = eval; return this }"))
    return views.table(spark, d, "pages").select("page_id", scanning.scan(script, scripts.PROXIED, scripts.archive_link("/web/", F.lit("2024"))).alias("script"))


@contract("""SELECT page_id, CASE WHEN page_id % 4 = 3 AND page_id % 3 <> 2 THEN NULL WHEN page_id % 3 = 1 AND page_id % 4 = 1 THEN CASE WHEN contains(url, '.json') THEN 'json' ELSE 'script' END
 WHEN page_id % 3 = 1 AND page_id % 4 = 2 THEN 'css' WHEN page_id % 3 = 1 THEN NULL ELSE 'html' END AS kind FROM pages""")
def sniffed_types(spark, d):
    """Pages and scripts whose declared types say little, by what they are asked for as."""
    k = F.col("page_id")
    declared = F.when(k % 3 == 0, "text/html").when(k % 3 == 1, "text/plain").otherwise("application/xhtml+xml")
    modifier = F.when(k % 4 == 0, "mp_").when(k % 4 == 1, "js_").when(k % 4 == 2, "cs_").otherwise("im_")
    body = F.when(k % 3 == 1, F.concat(F.lit("body { } /* "), "html")).otherwise(F.col("html"))
    kind = sniffing.kind_of_text(declared, modifier, body, F.col("url"))
    return views.table(spark, d, "pages").select("page_id", kind.alias("kind"))


@contract("SELECT '<' || event_id || '>' AS record_id, 'http://e/' || user_id AS url, sha256(props) AS payload_sha256 FROM events")
def stream_archives(spark, d):
    """All events as records of a stream that is written to archive files, which close by size, by silence, or at its end."""
    path = f"{ordering.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.readStream.schema(views.table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")  # a pattern: a stream takes a path without one for a folder
    rows = e.select(
        F.col("event_type").alias("collection"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.lit("resource").alias("record_type"), F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit(">")).alias("record_id"),
        F.concat(F.lit("http://e/"), F.col("user_id").cast("string")).alias("target_uri"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.lit(None).cast("string").alias("status_line"),
        F.lit(None).cast("array<struct<name:string,value:string>>").alias("headers"), F.col("props").cast("binary").alias("payload"),
    )
    writer = stream_files.ArchiveWriter(path, max_bytes=200_000, lanes=2)
    writer.start(rows, f"{path}/checkpoint").awaitTermination()
    writer.finish(spark, 1 << 20)
    return archives.read_records(spark, f"{path}/files").select("record_id", F.col("target_uri").alias("url"), F.sha2("payload", 256).alias("payload_sha256"))


#: Fixed values, stated here again: headers that keep their name, headers that hold a link, and headers that are put aside.
_PLAIN_HEADERS = (
    "accept-patch", "accept-ranges", "allow", "content-disposition", "content-language", "content-range", "content-type", "link", "proxy-authenticate",
    "www-authenticate", "set-cookie",
)
_LINK_HEADERS = ("content-base", "content-location", "location",)
_ASIDE_HEADERS = (
    "access-control-allow-origin", "access-control-allow-credentials", "access-control-expose-headers", "access-control-max-age", "access-control-allow-methods", "access-control-allow-headers", "age", "alt-svc", "cache-control", "connection", "content-encoding", "content-length", "content-md5",
    "content-security-policy", "content-security-policy-report-only", "date", "etag", "expires", "last-modified", "p3p", "pragma", "public-key-pins",
    "retry-after", "server", "status", "strict-transport-security", "trailer", "transfer-encoding", "tk", "upgrade", "upgrade-insecure-requests", "vary",
    "via", "warning", "x-frame-options", "x-xss-protection",
)
_HEADERS = (*_PLAIN_HEADERS, *_LINK_HEADERS, *_ASIDE_HEADERS, "X-Own", "ETag", "Content-Type")


@contract(
    "SELECT page_id, CASE WHEN kept THEN name ELSE 'X-Archive-Orig-' || name END AS name, CASE WHEN linked THEN 'http://archive.example/' || value ELSE value END AS value FROM (SELECT page_id, 'http://h' || page_id || '.example.com/' AS value FROM pages) CROSS JOIN (VALUES "
    + ", ".join(f"('{n}', {n.lower() not in _ASIDE_HEADERS}, {n in _LINK_HEADERS})" for n in _HEADERS) + ") f(name, kept, linked)"
)
def header_rules(spark, d):
    """Every header that has a rule, and some that do not."""
    value = F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".example.com/"))
    headers = F.array(*(F.struct(F.lit(n).alias("name"), value.alias("value")) for n in _HEADERS))
    return views.table(spark, d, "pages").select("page_id", F.inline(payload.rewrite_headers(headers, "http://archive.example/")))


@contract("""SELECT page_id, substr(html, CAST(page_id % 50 AS BIGINT) + 1, 40) AS part FROM pages""")
def range_slice(spark, d):
    asked = F.concat(F.lit("bytes="), (F.col("page_id") % 50).cast("string"), F.lit("-"), (F.col("page_id") % 50 + 39).cast("string"))
    r = payload.byte_range(asked, F.length("html").cast("long"))
    return views.table(spark, d, "pages").withColumn("r", r).select("page_id", F.expr("substring(html, cast(r.start as int) + 1, cast(r.length as int))").alias("part"))


@contract("SELECT page_id, url, 'memento' AS rel, 'Mon, 01 Jan 2024 00:00:00 GMT' AS datetime FROM pages")
def link_header_rows(spark, d):
    header = F.concat(F.lit("<"), F.col("url"), F.lit('>; rel="memento"; datetime="Mon, 01 Jan 2024 00:00:00 GMT"'))
    return views.table(spark, d, "pages").select("page_id", F.inline(payload.link_rows(header)))


# --- the whole pipeline --------------------------------------------------------------------------------------------


@contract(E + f"SELECT {KEYS}, url, digest FROM e WHERE starts_with(urlkey, 'com,example,u12)/')")
def index_build_sorted(spark, d):
    """A host of an index that is built from all captures, sorted, written and read back."""
    path = f"{ordering.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    building.write_index(views.events(spark, d), path)
    return captures.match(building.read_index(spark, path), "u12.example.com", "host").select("urlkey", "timestamp", "seq", "url", "digest")


@contract(E + "SELECT urlkey, timestamp, url, digest, \"offset\" FROM e WHERE starts_with(urlkey, 'com,example,u12)/') OR starts_with(urlkey, 'com,example,u3')")
def text_index_range(spark, d):
    """A host and a prefix of a sorted text index of all captures, of which their bytes alone are read."""
    path = f"{ordering.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    building.write_text_index(views.events(spark, d), path)
    index = lines.TextIndex(spark, path)
    found = captures.match(index, "u12.example.com", "host").unionByName(index.scan("com,example,u3", "com,example,u4"))
    return found.select("urlkey", "timestamp", "url", "digest", "offset")


def _block_index(spark, d) -> blocks.BlockIndex:
    return blocks.write_block_index(views.events(spark, d), f"{ordering.shared_folder(spark)}/blocks-{uuid.uuid4().hex}", lines=30)


@contract(E + "SELECT urlkey, timestamp, url, digest, \"offset\" FROM e WHERE starts_with(urlkey, 'com,example,u12)/') OR starts_with(urlkey, 'com,example,u3')")
def block_index_range(spark, d):
    """The same of a compressed block index, of which the blocks of the ranges are read."""
    index = _block_index(spark, d)
    found = index.scan(*urls.key_range("u12.example.com", "host")).unionByName(index.scan("com,example,u3", "com,example,u4"))
    return found.select("urlkey", "timestamp", "url", "digest", "offset")


@contract(E + """, n AS (SELECT *, (row_number() OVER (ORDER BY urlkey, timestamp, seq) - 1) // 30 AS block FROM e)
SELECT urlkey, timestamp, "offset" FROM n WHERE block >= 8 AND block < 12""")
def query_page(spark, d):
    """The third page, of four blocks, of all captures."""
    return CaptureQuery.parse({"url": "*.example.com", "page": "2", "pageSize": "4", "limit": "0"}).run(_block_index(spark, d)).select("urlkey", "timestamp", "offset")


@contract(E + """, n AS (SELECT *, (row_number() OVER (ORDER BY urlkey, timestamp, seq) - 1) // 30 AS block FROM e), s AS (SELECT block, min(urlkey) AS first FROM n GROUP BY block),
 b AS (SELECT count(*) AS n FROM s WHERE first < 'com,example,u12*' AND block >= coalesce((SELECT max(block) FROM s WHERE first < 'com,example,u12)/'), 0))
SELECT CAST(ceil(n / 2.0) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS "pageSize", n AS blocks FROM b""")
def query_num_pages(spark, d):
    """How many pages of two blocks a host has."""
    return CaptureQuery.parse({"url": "u12.example.com", "matchType": "host", "showNumPages": "1", "pageSize": "2"}).run(_block_index(spark, d))


@contract(E + """ SELECT urlkey || ' ' || timestamp || ' ' || url || ' ' || mime || ' ' || status || ' ' || digest || ' ' || redirect || ' ' || "offset" || ' ' || filename AS line FROM e""")
def index_nine_fields(spark, d):
    return building.index_lines(views.events(spark, d), 9).select("line")


@contract(E + f"""SELECT {KEYS}, CASE WHEN urlkey LIKE '%)/error' THEN 451 WHEN mime = 'warc/revisit' AND o IS NULL THEN 404 ELSE 200 END AS answer,
 CASE WHEN urlkey LIKE '%)/error' THEN NULL WHEN mime = 'warc/revisit' THEN 'body ' || o ELSE 'body ' || seq END AS body FROM (SELECT e.*, f.m.seq AS o FROM e LEFT JOIN
 (SELECT digest, min(struct_pack(k := urlkey, t := timestamp, seq := seq)) AS m FROM e WHERE mime <> 'warc/revisit' GROUP BY digest) f
 ON f.digest = e.digest AND (f.m.k, f.m.t, f.m.seq) < (e.urlkey, e.timestamp, e.seq))""")
def load_resources(spark, d):
    """Payloads by file and offset: of revisits those of their originals, of blocked captures none."""
    e = views.events(spark, d)
    body = F.concat(F.lit("body "), F.col("seq").cast("string")).cast("binary")
    records = e.select("filename", F.col("offset").cast("long").alias("offset"), F.lit("HTTP/1.1 200 OK").alias("status_line"), F.array(F.struct(F.lit("A").alias("name"), F.lit("b").alias("value"))).alias("headers"), body.alias("payload"))
    given = captures.resolve_revisits(e).withColumn("access", F.when(F.col("urlkey").endswith(")/error"), "block").otherwise("allow"))
    # a resolved revisit has its original's type: what it was is told by its origin
    return building.load_resources(given, records).select("urlkey", "timestamp", "seq", "answer", F.col("payload").cast("string").alias("body"))


def _page_archives(spark, d, revisits: bool) -> tuple[str, DataFrame]:
    """All pages as archive files, and the files' places."""
    pages = views.table(spark, d, "pages")
    html = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value")))
    records = pages.select(
        F.lit("pages").alias("collection"), F.col("page_id").alias("seq"), F.lit("response").alias("record_type"), F.concat(F.lit("<urn:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")), "yyyyMMddHHmmss").alias("timestamp"), F.lit("HTTP/1.1 200 OK").alias("status_line"), html.alias("headers"), F.col("html").cast("binary").alias("payload"),
    )
    path = f"{ordering.shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    files = writing.write_archives(records, path, 400_000, revisits)
    return path, files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.concat(F.lit(f"{path}/"), F.element_at(F.split("path", "/"), -1)).alias("path"), F.lit(0).alias("rank"))


@contract("SELECT '<urn:' || page_id || '>' AS record_id, url, sha256(html) AS payload_sha256 FROM pages")
def archive_records_split(spark, d):
    """All records of archive files that are read in parts of 32 KB."""
    path, _ = _page_archives(spark, d, False)
    return archives.read_records(spark, path, 32 << 10).select("record_id", F.col("target_uri").alias("url"), F.sha2("payload", 256).alias("payload_sha256"))


@contract("SELECT url, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') AS timestamp, 200 AS answer, sha256(html) AS payload_sha256 FROM pages")
def resource_by_offset(spark, d):
    """Payloads of all captures of written archives, read by offset; pages met before are revisits of other URLs too."""
    path, places = _page_archives(spark, d, True)
    index = ordering.materialize(archives.captures_of(archives.read_records(spark, path)))
    found = resources.fetch(captures.resolve_revisits(index), places, index)
    return found.select("url", "timestamp", "answer", F.sha2("payload", 256).alias("payload_sha256"))


@contract("""SELECT event_id, collection FROM (SELECT event_id, 'c' || (user_id % 7) AS collection FROM events) WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND regexp_matches(collection, '^c[1-4]')""")
def recorder_filters(spark, d):
    """Exchanges that neither side asks to skip, of the collections that are recorded."""
    e = views.table(spark, d, "events")
    headers = lambda n: F.array(F.struct(F.lit("Recorder-Skip").alias("name"), F.when(F.col("event_id") % n == 0, "1").otherwise("0").alias("value")))
    rows = e.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("collection"), headers(5).alias("request_headers"), headers(7).alias("response_headers"))
    return building.recorded(rows, ("c[12]", "c3", "c4$")).select("event_id", "collection")


@contract(E + """ SELECT seq, '<' || url || '>; rel="original", <http://a/c/' || url || '>; rel="timegate", <http://a/c/timemap/link/' || url || '>; rel="timemap"; type="application/link-format", <http://a/c/' || timestamp || 'mp_/' || url
 || '>; rel="memento"; datetime="' || strftime(strptime(timestamp, '%Y%m%d%H%M%S'), '%a, %d %b %Y %H:%M:%S GMT') || '"' AS links FROM e""")
def replay_links(spark, d):
    return timeline.replay_links(views.events(spark, d), "http://a/c/").select("seq", "links")


@contract(D + """, s AS (SELECT 0 AS r, * FROM d WHERE collection <> 'src1' UNION ALL SELECT 1, * FROM d)
SELECT url, seq FROM s WHERE (url, r) IN (SELECT url, min(r) FROM s GROUP BY url)""")
def first_source(spark, d):
    """For each URL the captures of the first source that has any."""
    docs = views.documents(spark, d)
    return captures.first_found([docs.where("collection <> 'src1'"), docs], ["url"]).select("url", "seq")


@contract(RESOLVED.rstrip() + """, f AS (SELECT * FROM r WHERE status = '200' AND timestamp >= '20240103000000' AND timestamp <= '20240120235959'),
 c AS (SELECT *, lag(substr(timestamp, 1, 8) || '|' || status) OVER (ORDER BY urlkey, timestamp, seq) AS p FROM f), k AS (SELECT * FROM c WHERE p IS NULL OR p <> substr(timestamp, 1, 8) || '|' || status),
 n AS (SELECT * FROM k ORDER BY """ + _DISTANCE.format("2024-01-10 00:00:00") + """, urlkey, timestamp, seq LIMIT 200)
SELECT urlkey, timestamp, seq, mime, status, CASE WHEN starts_with(urlkey, 'com,example,u12)/') THEN 'allow' WHEN starts_with(urlkey, 'com,example,u1') THEN 'block' WHEN starts_with(urlkey, 'com,example,u3)/') THEN 'block'
 WHEN starts_with(urlkey, 'com,example,u4)/') AND timestamp < '20240110000000' THEN 'block' WHEN starts_with(urlkey, 'com,example,u6)/') AND timestamp < '20240118000000' THEN 'block' ELSE 'allow' END AS access
FROM n WHERE urlkey NOT IN ('com,example,u12)/view', 'com,example,u3)/click') AND NOT (starts_with(urlkey, 'com,example,u5)/') AND timestamp > '20240122000000')""")
def flagship(spark, d):
    """Revisits, filter, clamp, collapse, closest, access: one plan."""
    q = CaptureQuery.parse({"url": "*.example.com", "resolveRevisits": "1", "filter": "=status:200", "from": "20240103", "to": "20240120", "collapseTime": "8", "closest": "20240110", "limit": "200"})
    return q.run(views.events(spark, d), _RULES, as_of=_AS_OF).select("urlkey", "timestamp", "seq", "mime", "status", "access")
