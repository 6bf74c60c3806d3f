"""Rewriting of captured payloads for replay, and of request bodies into keys.

Plain cases are column expressions in ``payload``. What needs a tolerant HTML parser, relative joins or a body's format is
a small function of one value here, applied by Arrow-batched UDFs. A value that cannot be parsed is returned as it is;
null stays null.
"""

from __future__ import annotations

import base64
import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.parser import BytesParser
from email.policy import HTTP
from html.parser import HTMLParser
from urllib.parse import quote, unquote_plus, urlencode, urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.scanning import Rule
from tidemark.functions.scripts import archive_link, rewrite_inline, rewrite_script, rewrite_scripts

#: URLs that are left alone, and those that are absolute.
UNTOUCHED = ("#", "javascript:", "data:", "mailto:", "about:", "file:", "{")
ABSOLUTE = ("http:", "https:", "ftp:", "mms:", "rtsp:", "wais:")
SCHEME_RELATIVE = ("//", "\\/\\/", "\\\\/\\\\/")
#: Attributes that hold URLs, by tag, with the modifier of what they lead to; "" is the page's own.
ATTRIBUTES = {
    "a": {"href": ""}, "applet": {"codebase": "oe_", "archive": "oe_"}, "area": {"href": ""}, "audio": {"src": "oe_"}, "base": {"href": ""}, "blockquote": {"cite": ""},
    "body": {"background": "im_"}, "button": {"formaction": ""}, "command": {"icon": "im_"}, "del": {"cite": ""}, "embed": {"src": "oe_"}, "iframe": {"src": "if_"},
    "image": {"src": "im_", "xlink:href": "im_", "href": "im_"}, "img": {"src": "im_", "srcset": "im_"}, "ins": {"cite": ""}, "input": {"src": "im_", "formaction": ""}, "form": {"action": ""},
    "frame": {"src": "fr_"}, "link": {"href": "oe_"}, "object": {"codebase": "oe_", "data": "oe_"}, "param": {"value": "oe_"}, "q": {"cite": ""}, "ref": {"href": "oe_"},
    "script": {"src": "js_", "xlink:href": "js_"}, "source": {"src": "oe_", "srcset": "oe_"}, "video": {"src": "oe_", "poster": "im_"},
}
#: Modifiers of what a preload names.
PRELOADED = {
    "script": "js_", "worker": "js_", "style": "cs_", "image": "im_", "document": "if_", "fetch": "mp_", "font": "oe_", "audio": "oe_", "video": "oe_", "embed": "oe_", "object": "oe_", "track": "oe_",
}
#: Fixed value: the frame that takes the place of the topmost one.
TOP_FRAME = "___wb_replay_top_frame"
#: Characters of a request body that become part of a key.
BODY_CHARS = 4096


@dataclass(frozen=True)
class Place:
    """Where a page is replayed: prefix, capture time, modifier and URL."""

    prefix: str
    timestamp: str
    url: str
    modifier: str = ""

    def kind(self, value: str, absolute: bool = False) -> str:
        """What a URL on the page is: kept as it stands, whole, loose (no scheme), or to be joined with the page's own."""
        archived = self.prefix.strip("/") and value.startswith(self.prefix)
        if archived or value.startswith(UNTOUCHED):
            return "kept"
        if value.startswith(ABSOLUTE):
            return "whole"
        if value.startswith(SCHEME_RELATIVE):
            return "loose"
        return "joined" if absolute or value.startswith("/") or "../" in value else "kept"

    def root(self, kind: str) -> str:
        """What a link of a kind starts with: the prefix, without its scheme for loose ones, from the server's root for joined ones."""
        parts = urlsplit(self.prefix)
        if kind == "whole" or not parts.netloc:
            return self.prefix
        return parts.path if kind == "joined" else f"//{parts.netloc}{parts.path}"

    def link(self, value: str, modifier: str | None = None, absolute: bool = False) -> str:
        """A URL found on the page, as it leads on within the archive; relative ones that stay below the page are kept."""
        kind = self.kind(value, absolute)
        if kind == "kept":
            return value
        moment = self.timestamp + (self.modifier if modifier is None else modifier)
        return "".join((self.root(kind), moment, "/" if moment else "", urljoin(self.url, value) if kind == "joined" else value))


def rewrite_css_text(text: str, place: Place) -> str:
    """url() and @import."""
    text = re.sub(r"""(url\(\s*(?:&#39;|&quot;|["'])?)([^)"'&\s]+)""", lambda m: m[1] + place.link(m[2], "oe_" if place.modifier != "" else None), text, flags=re.I)
    return re.sub(r"""(@import\s+["'])([^"']+)""", lambda m: m[1] + place.link(m[2], "cs_" if place.modifier != "" else None), text, flags=re.I)


class _Page(HTMLParser):
    """Writes what it reads, with links rewritten; everything else passes as it stands in the source."""

    def __init__(self, place: Place, head: str, scripts: str = "proxied", extra: tuple[Rule, ...] = ()) -> None:
        super().__init__(convert_charrefs=False)
        self.place, self.head, self.out, self.inside = place, head, [], ""
        self.scripts, self.extra = scripts, extra
        self.text, self.lines = "", [0]

    def read(self, text: str) -> None:
        """The whole of a page."""
        self.text, self.lines = text, [0, *(m.end() for m in re.finditer("\n", text))]
        last = re.match(r"[\w#&]*", text[::-1])[0][::-1]  # the parser loses part of references that the page breaks off in
        end = len(text) - len(last[last.find("&") :] if "&" in last else "")
        self.feed(text[:end])
        self.close()
        if end < len(text):
            self.handle_data(text[end:])

    def _reference(self, body: str) -> None:
        """A reference as it stands: without a semicolon where the page has none."""
        line, column = self.getpos()
        closed = self.text.startswith(";", self.lines[line - 1] + column + len(body))
        self.out.append(body + ";" * closed)

    def _script_link(self, url: str, modifier: str) -> str:
        return self.place.link(url, modifier or None)

    def _insert_head(self, before: str) -> None:
        if self.head and before not in ("html", "head"):
            self.out.append(self.head)
            self.head = ""

    def _value(self, tag: str, name: str, value: str, named: dict[str, str]) -> str:
        place, link = self.place, self.place.link
        if name == "style":
            return rewrite_css_text(value, place)
        if value.startswith("javascript:") or name.startswith("on") and name[2:3] != "-":
            return rewrite_inline(value, self._script_link, self.scripts, self.extra)
        if name == "target":
            return TOP_FRAME if value in ("_blank", "_parent", "_top") else value
        if tag == "meta" and name == "content":
            if named.get("name", "").lower() == "referrer":
                return "no-referrer-when-downgrade"
            if named.get("http-equiv", "").lower() == "refresh" and (m := re.match(r"([\d.]+\s*;\s*url\s*=\s*[\"']?)(.*)", value, re.I | re.S)):
                return m[1] + link(m[2].strip())
            return link(value) if value.startswith(("http://", "https://", "//")) else value
        if name == "srcset":
            return ", ".join(" ".join((link(p[0], ATTRIBUTES.get(tag, {}).get(name)), *p[1:])) for x in re.split(r",\s+|,(?=https?:)", value.strip()) if (p := x.split()))
        if tag == "base" and name == "href":
            new = link(value, absolute=True)
            self.place = Place(place.prefix, place.timestamp, urljoin(place.url, value), place.modifier)
            return new
        if tag == "link" and name == "href":
            rel = named.get("rel", "").lower()
            if rel == "canonical":
                return value
            return link(value, "cs_" if rel == "stylesheet" else PRELOADED.get(named.get("as", "").lower(), "oe_") if rel == "preload" else "oe_")
        modifier = ATTRIBUTES.get(tag, {}).get(name)
        if modifier is not None:
            return link(value, modifier or None)
        return link(value) if name.startswith("data-") and value.startswith(("http://", "https://", "//")) else value

    def _open(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> None:
        self._insert_head(tag)
        named = {n: v or "" for n, v in attrs}
        source, new = self.get_starttag_text() or "", [(n, v if v is None else self._value(tag, n, v, named)) for n, v in attrs]
        off = {"integrity", "crossorigin"} | ({"content"} if tag == "meta" and named.get("http-equiv", "").lower() == "content-security-policy" else set())
        new = [("_" + n if n in off else n, v) for n, v in new]
        if new == attrs:
            self.out.append(source)
            return
        text = "".join(f" {n}" if v is None else f' {n}="{html.escape(v, quote=False).replace(chr(34), "&quot;")}"' for n, v in new)
        self.out.append(f"<{tag}{text}{'/' if closed else ''}>")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs, False)
        kind = next((v or "" for n, v in attrs if n == "type"), "").lower()
        runs = not kind or "javascript" in kind or "ecmascript" in kind
        self.inside = tag if tag == "style" or tag == "script" and runs else ""

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._insert_head("")
        self.inside = ""
        self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._insert_head("")
        if self.inside == "style":
            data = rewrite_css_text(data, self.place)
        elif self.inside == "script" and data:
            data = rewrite_script(data, self._script_link, self.scripts, self.extra)
        self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self._reference(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._reference(f"&#{name}")

    def handle_comment(self, data: str) -> None:
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data: str) -> None:
        self.out.append(f"<?{data}>")

    def unknown_decl(self, data: str) -> None:
        self.out.append(f"<![{data}]>")


def rewrite_html_text(text: str, place: Place, head: str = "", scripts: str = "none", extra: tuple[Rule, ...] = ()) -> str:
    """A page with its links rewritten and ``head`` put before the first element behind the head tag.

    ``scripts`` names the set of rules for its scripts, in elements and attributes; ``extra`` rules come before those.
    """
    page = _Page(place, head, scripts, extra)
    page.read(text)
    page._insert_head("")
    return "".join(page.out)


def best_variant(offers: list[tuple[int, int]], most_pixels: int, most_bandwidth: int) -> int | None:
    """Index of the best (pixels, bandwidth) within the limits: most pixels where both are known, else most bandwidth."""
    best, top_pixels, top_rate = None, 0, 0
    for k, (pixels, rate) in enumerate(offers):
        by_pixels = pixels > 0 and most_pixels > 0
        if (top_pixels < pixels <= most_pixels) if by_pixels else (top_rate < rate <= most_bandwidth):
            best, top_pixels, top_rate = k, pixels, rate
    return best


def prune_hls(text: str, most_pixels: int = 1280 * 720, most_bandwidth: int = 1_000_000_000) -> str:
    """A playlist with its best variant alone; each variant is a line of facts and the line behind it."""
    lines, offers = text.split("\n"), []
    for k, line in enumerate(lines):
        if line.startswith("#EXT-X-STREAM-INF:") and (rate := re.search(r"[:,]BANDWIDTH=(\d+)", line)):
            size = re.search(r"RESOLUTION=(\d+)x(\d+)", line)
            offers.append((k, int(size[1]) * int(size[2]) if size else 0, int(rate[1])))
    best = best_variant([o[1:] for o in offers], most_pixels, most_bandwidth)
    gone = {j for i, o in enumerate(offers) if i != best for j in (o[0], o[0] + 1)}
    return "\n".join(x for k, x in enumerate(lines) if k not in gone)


def prune_dash(text: str, most_pixels: int = 1280 * 720, most_bandwidth: int = 1_000_000_000) -> str:
    """A manifest whose adaptation sets keep their best representation alone."""
    space = "urn:mpeg:dash:schema:mpd:2011"
    ElementTree.register_namespace("", space)
    root = ElementTree.fromstring(text.encode())
    for group in root.iter(f"{{{space}}}AdaptationSet"):
        all_of = group.findall(f"{{{space}}}Representation")
        best = best_variant([(int(r.get("width", "0")) * int(r.get("height", "0")), int(r.get("bandwidth", "0"))) for r in all_of], most_pixels, most_bandwidth)
        for k, r in enumerate(all_of):
            if k != best:
                group.remove(r)
    return "<?xml version='1.0' encoding='UTF-8'?>\n" + ElementTree.tostring(root, encoding="unicode")


def rewrite_xml_text(text: str, place: Place) -> str:
    """Absolute URLs of attributes and elements, namespaces excepted."""
    return re.sub(r"""(?<!\w)(xmlns[\w:]*\s*=\s*["'][^"']*["'])|([>"']\s*)(https?://[^\s"'<>]+)""", lambda m: m[1] or m[2] + place.link(m[3]), text)


def rewrite_cookie(text: str, place: Place, scope: str = "default") -> str:
    """A Set-Cookie value for replay: its path below the archive (default), the collection (coll), or the root (root);
    removeall drops it. Domain goes; so do Secure behind a plain prefix, and dates, which would outlive the page.
    """
    if scope == "removeall":
        return ""
    parts = [p.strip() for p in text.split(";")]
    path = next((p.split("=", 1)[1] for p in parts[1:] if p.lower().startswith("path=")), None)
    prefix = "/" + (place.prefix.split("/", 3) + [""])[3] if place.prefix.startswith(ABSOLUTE) else place.prefix
    dropped = ("path", "domain", "expires", "max-age") + (() if place.prefix.startswith("https:") else ("secure",))
    kept = [p for p in parts[1:] if p.split("=", 1)[0].lower() not in dropped]
    if scope == "root":
        new = "/"
    elif scope == "coll":
        new = prefix or "/"
    else:
        head = place.timestamp + place.modifier
        new = prefix + (head + "/" if head else "") + urljoin(place.url, path or "/")
    return "; ".join((parts[0], f"Path={new}", *kept))


def to_uri(url: str) -> str:
    """An address in ASCII: the host by IDNA, everything else percent-encoded."""
    parts = urlsplit(url)
    host = parts.netloc
    try:
        host = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        host = quote(host, safe=":@.")
    tail = quote(url.split("://", 1)[-1][len(parts.netloc) :], safe="%/:=&?~#+!$,;'@()*[]") if "://" in url else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    return f"{parts.scheme}://{host}{tail}" if "://" in url else tail


def _scalar(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def _leaves(value: object, name: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, name)
    elif name:
        yield name, _scalar(value)


def json_query(text: str | bytes) -> str:
    """Leaves of a JSON document as arguments; the n-th of a name is called ``name.n_``."""
    seen: dict[str, int] = {}
    found = []
    for name, value in _leaves(json.loads(text), ""):
        seen[name] = seen.get(name, 0) + 1
        found.append((name if seen[name] == 1 else f"{name}.{seen[name]}_", value))
    return urlencode(found)


def body_query(method: str | None, content_type: str | None, body: bytes | None) -> str:
    """What a request's method and body add to its URL's arguments; nothing for a plain GET."""
    method, kind = (method or "GET").upper(), content_type or ""
    if method == "GET":
        return ""
    binary = lambda: "__wb_post_data=" + base64.b64encode(body).decode()
    query = ""
    if method in ("POST", "PUT") and body:
        try:
            if kind.startswith("application/x-www-form-urlencoded"):
                query = unquote_plus(body.decode())
            elif kind.startswith("multipart/"):
                parts = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
                query = urlencode([(p.get_param("name", "", "content-disposition"), p.get_payload(decode=True).decode("utf-8", "replace")) for p in parts.iter_parts()]) if parts.is_multipart() else binary()
            elif kind.startswith(("application/json", "text/plain")):
                query = json_query(body)
            else:
                query = binary()
        except (ValueError, RecursionError):
            query = "" if kind.startswith("application/json") else binary()
    return "__wb_method=" + method + ("&" + query[:BODY_CHARS] if query else "")


def with_query(url: str, query: str) -> str:
    return f"{url}{'&' if '?' in url else '?'}{query}" if query else url


# --- columns -------------------------------------------------------------------------------------------------------


def _places(work: Callable[[str, Place], str]) -> Callable[[Column, Column, Column, Column], Column]:
    @F.pandas_udf(StringType())
    def run(text: pd.Series, prefix: pd.Series, timestamp: pd.Series, url: pd.Series) -> pd.Series:
        def one(t: str | None, p: str, ts: str, u: str) -> str | None:
            if t is None:
                return None
            try:
                return work(t, Place(p or "", ts or "", u or "", "mp_" if ts else ""))
            except (ValueError, ElementTree.ParseError, AssertionError):
                return t

        return pd.Series([one(*x) for x in zip(text, prefix, timestamp, url, strict=True)], dtype=object)

    return run


def rewrite(kind: str, text: Column, prefix: str, timestamp: Column, url: Column, head: str = "", scripts: str = "none") -> Column:
    """Payload text of a kind (html, css, xml, hls, dash, cookie, link) rewritten for its replay below ``prefix``."""
    works: dict[str, Callable[[str, Place], str]] = {
        "html": lambda t, p: rewrite_html_text(t, p, head, scripts), "css": rewrite_css_text, "xml": rewrite_xml_text, "hls": lambda t, _: prune_hls(t), "dash": lambda t, _: prune_dash(t),
        "cookie": rewrite_cookie, "link": lambda t, p: p.link(t),
    }
    if kind not in works:
        return text
    return _places(works[kind])(text, F.lit(prefix), timestamp, url)


#: Kinds of text by media type.
KINDS = {
    "text/html": "html", "application/xhtml+xml": "html", "text/css": "css", "text/xml": "xml", "application/xml": "xml", "application/rss+xml": "xml", "image/svg+xml": "html",
    "application/x-mpegurl": "hls", "application/vnd.apple.mpegurl": "hls", "application/dash+xml": "dash", "text/javascript": "script", "application/javascript": "script", "application/x-javascript": "script", "application/ecmascript": "script",
}


def kind_of(mime: Column) -> Column:
    """Kind of text of a media type; ``plain`` for what is not rewritten."""
    kind = F.lit("plain")
    for m, k in KINDS.items():
        kind = F.when(F.lower(mime) == m, k).otherwise(kind)
    return kind


def rewrite_by_type(mime: Column, text: Column, prefix: str, timestamp: Column, url: Column, head: str = "", scripts: str = "none") -> Column:
    """Payload text rewritten as its media type asks; scripts by the set of rules that ``scripts`` names, in pages and alone."""

    def work(t: str, p: Place, kind: str) -> str:
        return rewrite_html_text(t, p, head, scripts) if kind == "html" else rewrite_css_text(t, p) if kind == "css" else rewrite_xml_text(t, p) if kind == "xml" else prune_hls(t) if kind == "hls" else prune_dash(t) if kind == "dash" else t

    @F.pandas_udf(StringType())
    def run(kind: pd.Series, body: pd.Series, ts: pd.Series, u: pd.Series) -> pd.Series:
        def one(k: str, t: str | None, s: str | None, a: str | None) -> str | None:
            try:
                return t if t is None else work(t, Place(prefix, s or "", a or "", "mp_" if s else ""), k)
            except (ValueError, ElementTree.ParseError, AssertionError):
                return t

        return pd.Series([one(*x) for x in zip(kind, body, ts, u, strict=True)], dtype=object)

    alone = rewrite_scripts(text, url, archive_link(prefix, timestamp, "mp_"), scripts)
    return F.when(kind_of(mime) == "plain", text).when(kind_of(mime) == "script", alone).otherwise(run(kind_of(mime), text, timestamp, url))


@F.pandas_udf(StringType())
def request_key_url(url: pd.Series, method: pd.Series, content_type: pd.Series, body: pd.Series) -> pd.Series:
    """The URL that a request is keyed by: its own, and what body_query adds."""
    return pd.Series([None if u is None else with_query(u, body_query(m, c, None if b is None else bytes(b))) for u, m, c, b in zip(url, method, content_type, body, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def ascii_url(url: pd.Series) -> pd.Series:
    """to_uri of a column."""
    return pd.Series([None if u is None else to_uri(u) for u in url], dtype=object)
