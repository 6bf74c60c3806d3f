"""URL keys: sort-friendly canonical form, key ranges of match types, archival URLs.

A key is the lower-cased URL without scheme, user information, leading ``www.`` label and fragment: host labels reversed
and joined by commas, ``)``, then the path and the query with sorted arguments. Default ports go, other ports stay after the host.
In path and query, escapes of printable ASCII are undone (however often they were made), what is not printable ASCII is escaped; a path
loses its dot segments, doubled and trailing slashes and session ids, a query its session ids and empty arguments. ``urn:``
and other URLs without authority are their own lower-cased key. One table of rules makes the key of one URL and that of a column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import let


class BadRequest(ValueError):
    """A query that cannot be answered as asked."""

    status = 400


# --- rules of keys, read alike by Python and Java -------------------------------------------------------------------

_WHITE = " \t\n\x0b\f\r"
_AUTHORITY = r"^(?:([a-z][a-z0-9+.\-]*):)?//"
_BARE_HOST = r"^[^/?#\s:@]+\.[^/?#\s:@]+(?::\d+)?(?:[/?#]|$)"
_HOST_PORT = r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$"
_HOST = ((r"\.{2,}", "."), (r"^\.|\.$", ""), (r"^www\d*\.", ""))
#: A percent sign that was escaped before what it escapes; one that escapes nothing.
_NESTED, _STRAY = (r"%(?:25)+(?=[0-9a-f]{2})", "%"), (r"%(?![0-9a-f]{2})", "%25")
#: Escapes that are undone: of printable ASCII but for # and %.
_UNDONE = r"%(?!20|23|25|7f)[2-7][0-9a-f]"
_PATH = ((r"/(?:\.?/)+", "/"), (r"/\.$", "/"))
_PARENT, _PARENTS = (r"/(?!\.\./)[^/]+/\.\.(?=/|$)", ""), 16
#: The forms of session ids in paths and queries.
_PATH_END = ((r"^(?:/\.\.)+(?=/|$)", ""), (r"/(?:\((?:[a-z]\([0-9a-z]{24}\))+\)|\([0-9a-z]{24}\))(?=/[^?]+\.aspx)", ""), (r";jsessionid=[0-9a-z]{32}$", ""), (r"/+$", ""))
_QUERY = ((r"(?:^|(?<=&))(?:(?:jsessionid|phpsessid|sid)=[0-9a-z]{32}|aspsessionid[a-z]{8}=[a-z]{24}|cfid=[^&]+&cftoken=[^&]+)(?=&|$)", ""), (r"&{2,}", "&"), (r"^&|&$", ""))


# --- keys, on the driver -------------------------------------------------------------------------------------------


def _ruled(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, new, text)
    return text


def _plain(text: str) -> str:
    """Escapes in their one form."""
    text = re.sub(_UNDONE, lambda m: chr(int(m[0][1:], 16)), re.sub(*_NESTED, text)).lower()
    text = re.sub(*_STRAY, text)
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02x}" for b in c.encode()) for c in text)


def url_key(url: str, surt: bool = True) -> str:
    """Key of one URL."""
    low = re.sub(r"[\t\r\n]", "", url.strip(_WHITE).lower()).split("#", 1)[0]
    m = re.match(_AUTHORITY, low)
    if not m and not re.match(_BARE_HOST, low):
        return low
    scheme, rest = (m[1] or "http", low[m.end() :]) if m else ("http", low)
    authority = re.match(r"^[^/?]*", rest)[0]
    path, _, query = rest[len(authority) :].partition("?")
    host, port = re.match(_HOST_PORT, authority.rpartition("@")[2], re.S).groups()
    host = _ruled(host, _HOST)
    port = "" if port in (None, "", {"http": "80", "https": "443"}.get(scheme)) else ":" + port
    path = _ruled(_plain(path), _PATH)
    for _ in range(_PARENTS):
        path = re.sub(*_PARENT, path)
    path = _ruled(path, _PATH_END) or "/"
    query = _ruled(_plain(query), _QUERY)
    query = "?" + "&".join(sorted(query.split("&"))) if query else ""
    head = ",".join(reversed(host.split("."))) + port + ")" if surt else host + port
    return head + path + query


def unkey(key: str) -> str:
    """Scheme-less URL of a key; a key without ``)/`` is returned as it is."""
    head, sep, tail = key.partition(")/")
    if not sep:
        return key
    host, colon, port = head.partition(":")
    return ".".join(reversed(host.split(","))) + colon + port + "/" + tail


def key_range(url: str, match_type: str, surt: bool = True) -> tuple[str, str]:
    """[start, end) of the keys that a URL matches: exact, prefix, host or domain."""
    start = url_key(url, surt)
    if match_type == "exact":
        return start, start + "!"
    if match_type == "prefix":
        for end in "/?":
            if url.endswith(end) and not start.endswith(end):
                start += end
        return start, start[:-1] + chr(ord(start[-1]) + 1)
    if match_type == "host":
        host = start.split(")/")[0] if surt else urlsplit(url).netloc
        return (host + ")/", host + "*") if surt else (host + "/", host + "0")
    if match_type == "domain":
        if not surt:
            raise BadRequest("domain matches need sorted host labels")
        host = start.split(")/")[0]
        return (host + "," if "," not in host else host + ")/"), host + "-"
    raise BadRequest(f"unknown match type: {match_type}")


# --- keys, as columns ----------------------------------------------------------------------------------------------


def _ruled_column(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def _plain_column(text: Column) -> Column:
    undo = lambda t: F.when(t.rlike(_UNDONE), F.array_join(F.transform(F.split(t, f"(?={_UNDONE})"), lambda x: F.when(x.rlike(f"^{_UNDONE}"), F.concat(F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("long")), F.substring(x, 4, 1 << 30))).otherwise(x)), "")).otherwise(t)
    escape = lambda c: F.when(c.rlike(r"^[!-~]*$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-8"))), "(..)", "%$1"))
    printable = lambda t: F.when(t.rlike(r"^[!-~]*$"), t).otherwise(F.array_join(F.transform(F.split(t, ""), escape), ""))
    return let(F.regexp_replace(F.lower(let(F.regexp_replace(text, *_NESTED), undo)), *_STRAY), printable)


def _path_column(path: Column) -> Column:
    flat = F.aggregate(F.sequence(F.lit(1), F.lit(_PARENTS)), _ruled_column(_plain_column(path), _PATH), lambda p, _: F.when(F.contains(p, F.lit("/..")), F.regexp_replace(p, *_PARENT)).otherwise(p))
    return let(_ruled_column(flat, _PATH_END), lambda p: F.when(p == "", "/").otherwise(p))


def surt(url: Column) -> Column:
    """Key of a URL column."""

    def build(low: Column) -> Column:
        has, bare = low.rlike(_AUTHORITY), low.rlike(_BARE_HOST)
        scheme = F.when(has, F.regexp_extract(low, _AUTHORITY, 1)).otherwise("")
        rest = F.regexp_replace(low, _AUTHORITY, "")
        authority = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"(?s)^.*@", "")
        host, port = (F.regexp_extract(authority, "(?s)" + _HOST_PORT, k) for k in (1, 2))
        default = F.when(scheme.isin("http", ""), "80").when(scheme == "https", "443").otherwise("")
        path, query = F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
        key = F.concat(
            F.array_join(F.reverse(F.split(_ruled_column(host, _HOST), r"\.")), ","), F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)), F.lit(")"), _path_column(path),
            let(_ruled_column(_plain_column(query), _QUERY), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(q, "&")), "&")))),
        )
        return F.when(has | bare, key).otherwise(low)

    return let(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(url, F.lit(_WHITE))), r"[\t\r\n]", ""), r"(?s)#.*$", ""), build)


def unsurt(key: Column) -> Column:
    """Scheme-less URL of a key column."""
    head = F.regexp_extract(key, r"^(.*?)\)/", 1)
    host = F.array_join(F.reverse(F.split(F.regexp_extract(head, r"^[^:]*", 0), ",")), ".")
    return F.when(F.instr(key, ")/") > 0, F.concat(host, F.regexp_extract(head, r":\d*$", 0), F.regexp_extract(key, r"^.*?\)(/.*)$", 1))).otherwise(key)


def in_range(key: Column, start: str, end: str) -> Column:
    """Bytewise range test, which reaches the scan."""
    return (key >= start) & (key < end)


def extension(url: Column) -> Column:
    """Extension of the last path segment, without its dot; empty if there is none."""
    segment = F.regexp_extract(F.regexp_extract(url, r"^[^?]*", 0), r"[^/]*$", 0)
    return F.regexp_extract(segment, r"[^.]\.([^.]*)$", 1)


# --- archival URLs -------------------------------------------------------------------------------------------------


#: The form of a calendar query, ``[modifier/][from]*[to]/url`` (or - for *), and of a replay.
QUERY_FORM = r"(?s)^(?:([\w\-:]+)/)?(\d*)[*-](\d*)/?(.+)$"
REPLAY_FORM = r"(?s)^(\d*)([a-z]+_|[$][a-z0-9:.-]+)?/{1,3}(.+)$"
#: What may stand before the first ``:/`` of a URL that names its scheme.
SCHEME_FORM = r"^[a-zA-Z0-9+-.]+:/"


@dataclass(frozen=True)
class ArchivalUrl:
    """What ``archival_url`` finds, as text again."""

    type: str  # replay, latest_replay, query or url_query
    timestamp: str
    end_timestamp: str
    modifier: str
    url: str

    def __str__(self) -> str:
        if self.type in ("query", "url_query"):
            head = f"{self.modifier}/" if self.modifier else ""
            return f"{head}{self.timestamp}*{self.end_timestamp}/{self.url}" + ("*" if self.type == "url_query" else "")
        head = self.timestamp + self.modifier
        return f"{head}/{self.url}" if head else self.url


def schemed(url: Column) -> Column:
    """A URL with http:// before it if it names no scheme, and with both slashes after the one that it names."""
    return F.when(url.startswith("urn:"), url).when(~url.rlike(SCHEME_FORM), F.concat(F.lit("http://"), F.regexp_replace(url, "^//", ""))).otherwise(F.regexp_replace(url, r"^([a-zA-Z0-9+-.]+:/)(?=[^/])", "$1/"))


def archival_url(text: Column) -> Column:
    """Struct of an archival URL column: type, timestamp, end_timestamp, modifier, url; null where there is no URL in it."""
    s = F.regexp_replace(text, "^/", "")
    asked, replayed = s.rlike(QUERY_FORM), s.rlike(REPLAY_FORM)

    def part(query: int, replay: int) -> Column:
        of = lambda form, k: F.regexp_extract(s, form, k) if k else F.lit("")
        return F.when(asked, of(QUERY_FORM, query)).when(replayed, of(REPLAY_FORM, replay)).otherwise("")

    url = F.when(asked, F.regexp_extract(s, QUERY_FORM, 4)).when(replayed, F.regexp_extract(s, REPLAY_FORM, 3)).otherwise(s)
    kind = F.when(asked, F.when(url.endswith("*"), "url_query").otherwise("query")).when(part(0, 1) != "", "replay").otherwise("latest_replay")
    url = F.when(asked, F.regexp_replace(url, r"\*$", "")).otherwise(url)
    found = F.struct(kind.alias("type"), part(2, 1).alias("timestamp"), part(3, 0).alias("end_timestamp"), part(1, 2).alias("modifier"), schemed(url).alias("url"))
    return F.when(s != "", found)
