"""Column expressions over headers and payload text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import let
from tidemark.functions.urls import surt

#: What a replay does with response headers, by name; headers of other names are kept.
HEADER_RULES = {
    "access-control-allow-origin": "prefix-if-url-rewrite",
    "access-control-allow-credentials": "prefix-if-url-rewrite",
    "access-control-expose-headers": "prefix-if-url-rewrite",
    "access-control-max-age": "prefix-if-url-rewrite",
    "access-control-allow-methods": "prefix-if-url-rewrite",
    "access-control-allow-headers": "prefix-if-url-rewrite",
    "accept-patch": "keep",
    "accept-ranges": "keep",
    "age": "prefix",
    "allow": "keep",
    "alt-svc": "prefix",
    "cache-control": "prefix",
    "connection": "prefix",
    "content-base": "url-rewrite",
    "content-disposition": "keep",
    "content-encoding": "prefix-if-content-rewrite",
    "content-language": "keep",
    "content-length": "content-length",
    "content-location": "url-rewrite",
    "content-md5": "prefix",
    "content-range": "keep",
    "content-security-policy": "prefix",
    "content-security-policy-report-only": "prefix",
    "content-type": "keep",
    "date": "prefix",
    "etag": "prefix",
    "expires": "prefix",
    "last-modified": "prefix",
    "link": "keep",
    "location": "url-rewrite",
    "p3p": "prefix",
    "pragma": "prefix",
    "proxy-authenticate": "keep",
    "public-key-pins": "prefix",
    "retry-after": "prefix",
    "server": "prefix",
    "set-cookie": "cookie",
    "status": "prefix",
    "strict-transport-security": "prefix",
    "trailer": "prefix",
    "transfer-encoding": "transfer-encoding",
    "tk": "prefix",
    "upgrade": "prefix",
    "upgrade-insecure-requests": "prefix",
    "vary": "prefix",
    "via": "prefix",
    "warning": "prefix",
    "www-authenticate": "keep",
    "x-frame-options": "prefix",
    "x-xss-protection": "prefix",
}
ARCHIVED = "X-Archive-Orig-"


def mime_of(content_type: Column) -> Column:
    """Type without parameters; ``unk`` if there is none."""
    first = F.regexp_extract(F.trim(F.coalesce(content_type, F.lit(""))), r"^[^; ]*", 0)
    return F.when(first == "", "unk").otherwise(first)


def status_of(status_line: Column) -> Column:
    """Three-digit status of a status line; ``-`` if there is none, or for 204 with an error text."""
    code = F.regexp_extract(F.coalesce(status_line, F.lit("")), r"^(?:HTTP/\S+ )?(\d{3})\b", 1)
    return F.when((code == "") | ((code == "204") & status_line.contains("Error")), "-").otherwise(code)


def digest_of(header: Column) -> Column:
    """Digest without its algorithm."""
    return F.regexp_replace(header, r"^sha1:", "")


def title(html: Column) -> Column:
    """Text of the first title element, entities and all; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.when(F.rlike(html, F.lit(r"(?is)<title[^>]*>.*?</title")), F.trim(found))


def charset(html: Column) -> Column:
    """Charset that the head names, lower-case; null if none."""
    found = F.lower(F.regexp_extract(F.substring(html, 1, 1024), r"(?i)<meta[^>]*charset=[\"']?([\w\-]+)", 1))
    return F.when(found != "", found)


def rewrite_links(html: Column, prefix: str) -> Column:
    """Absolute http(s) values of href and src put behind a replay prefix."""
    return F.regexp_replace(html, r"((?:href|src)=[\"'])(https?://)", f"$1{prefix}$2")


def insert_head(html: Column, text: str) -> Column:
    """Text put right behind the first head tag, or before everything where there is none."""
    at = F.regexp_extract(html, r"(?is)^(.*?<head[^>]*>)", 1)
    return F.concat(at, F.lit(text), F.substring(html, F.length(at) + 1, F.length(html)))


def rewrite_css(css: Column, prefix: str) -> Column:
    """Absolute addresses of url() and @import put behind a prefix."""
    inside = F.regexp_replace(css, r"(url\(\s*[\"']?)(https?://)", f"$1{prefix}$2")
    return F.regexp_replace(inside, r"(@import\s+[\"'])(https?://)", f"$1{prefix}$2")


def swap_jsonp(body: Column, url: Column) -> Column:
    """A JSONP body (comments, a name, an object in brackets) with its callback named as the requesting URL names it: the
    last argument whose name ends in ``callback``; one that is ``?`` asks for nothing."""
    wanted = F.regexp_extract(url, r"[?].*callback=([^&]+)", 1)
    shape = r"(?m)\A((?:^[ \t]*(?:/\*[^*]*\*/|//[^\n]+\n))*[ \t]*)(\w+)(?=\(\{)"
    named = F.concat(F.regexp_extract(body, shape, 1), wanted, F.regexp_replace(body, shape, ""))
    return F.when((wanted != "") & (wanted != "?") & body.rlike(shape), named).otherwise(body)


def rewrite_headers(headers: Column, prefix: str, urls: bool = True, content: bool = True, cookie: Callable[[Column], Column] | None = None) -> Column:
    """Array of (name, value) as a replay sends them, by HEADER_RULES.

    ``urls``: links are rewritten at all; ``content``: the body is rewritten, so that its length and encoding no longer hold.
    ``cookie`` rewrites the value of a cookie; without it cookies are kept.
    """
    rule = F.create_map(*(F.lit(x) for kv in HEADER_RULES.items() for x in kv))
    away = {"prefix", "transfer-encoding"} | ({"prefix-if-url-rewrite"} if urls else set()) | ({"prefix-if-content-rewrite"} if content else set())

    def sent(h: Column) -> Column:
        name, value = h["name"], h["value"]
        length = (value == "0") | (value.rlike(r"^\d+$") if not content else F.lit(False))

        def by(kind: Column) -> Column:
            aside = kind.isin(*away) | ((kind == "content-length") & ~length)
            out = F.when(kind == "url-rewrite", F.regexp_replace(value, r"^(?=https?://)", prefix)) if urls else F.when(F.lit(False), value)
            out = out.when(kind == "cookie", cookie(value)) if urls and cookie else out
            return F.struct(F.when(aside, F.concat(F.lit(ARCHIVED), name)).otherwise(name).alias("name"), out.otherwise(value).alias("value"))

        return let(F.coalesce(F.try_element_at(rule, F.lower(name)), F.lit("keep")), by)

    return F.transform(headers, sent)


def byte_range(header: Column, size: Column) -> Column:
    """(start, length) of a ``bytes=`` range within a payload; null where it asks for nothing that is there."""
    low, high = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    low_n, high_n = (F.when(x != "", x).cast("long") for x in (low, high))
    start = F.when(low != "", low_n).otherwise(F.greatest(size - high_n, F.lit(0)))
    end = F.when(low == "", size - 1).otherwise(F.least(F.coalesce(high_n, size - 1), size - 1))
    fine = header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (start <= end) & (start < size)
    return F.when(fine, F.struct(start.alias("start"), (end - start + 1).alias("length")))


def is_self_redirect(url: Column, status: Column, location: Column) -> Column:
    """Whether a 3xx (not 304) leads back to its own URL or key."""
    absolute = F.when(location.rlike(r"^[a-z]+://"), location).when(location.startswith("//"), F.concat(F.lit("http:"), location)).when(location.startswith("/"), F.concat(F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), location)).otherwise(location)
    moved = status.rlike(r"^3\d\d$") & (status != "304") & location.isNotNull()
    return F.coalesce(moved & ((absolute == url) | (surt(absolute) == surt(url))), F.lit(False))


def link_rows(header: Column) -> Column:
    """Array of (url, rel, datetime) of a link header."""
    links = F.regexp_extract_all(header, F.lit(r"(<[^>]*>(?:\s*;\s*[\w\-]+=\"[^\"]*\")*)"), F.lit(1))
    field = lambda x, name: F.regexp_extract(x, rf';\s*{name}="([^"]*)"', 1)
    return F.transform(links, lambda x: let(x, lambda y: F.struct(F.regexp_extract(y, r"^<([^>]*)>", 1).alias("url"), field(y, "rel").alias("rel"), field(y, "datetime").alias("datetime"))))
