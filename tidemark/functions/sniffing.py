"""What a payload is, by its declared type, what it is asked for as, and its first bytes.

Declared types are often wrong where they matter least to browsers: scripts and styles sent as pages, pages sent without a
type. The decision looks at no more than the first 1,024 characters, in column expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import let
from tidemark.functions.scripts import WORKERS

#: Kinds of text by declared type. A ``?`` marks types that say little: text, page or bytes.
DECLARED = {
    "text/html": "?html", "application/xhtml": "html", "application/xhtml+xml": "html", "text/css": "css", "text/javascript": "script", "application/javascript": "script", "application/x-javascript": "script",
    "application/json": "json", "application/vnd.apple.mpegurl": "hls", "application/x-mpegURL": "hls", "application/dash+xml": "dash", "application/x-amf": "amf",
    "text/plain": "?text", "": "?text", "application/octet-stream": "?bytes",
}
#: Modifiers of what is shown as a document, and parts of URLs that ask a script for data.
DOCUMENTS = ("fr_", "if_", "mp_", "bn_", "")
DATA_URLS = ("callback=jQuery", "callback=jsonp", ".json?")
#: A text that begins with a tag; one whose first line has a tag somewhere; one that begins as JSON does.
_TAG_FIRST, _TAG_LATER, _JSON_FIRST = "^\ufeff?\\s*<", r"^[^\n]*<!?\w+[\s>]", r'^\s*[{\[][{"]'


def kind_of_text(content_type: Column, modifier: Column, body: Column, url: Column) -> Column:
    """html, css, script, json, hls, dash, amf or worker; null for what is not rewritten. Null bodies, types and modifiers count as empty."""
    mime = F.regexp_extract(F.coalesce(content_type, F.lit("")), "^[^;]*", 0)
    said = F.lit(None).cast("string")
    for m, k in DECLARED.items():
        said = F.when(mime == m, k).otherwise(said)
    modifier = F.coalesce(modifier, F.lit(""))
    part = modifier.isin("js_", "cs_")
    head = F.substring(F.coalesce(body, F.lit("")), 1, 1024)
    url = F.coalesce(url, F.lit(""))

    def resolved(k: Column) -> Column:
        looked = F.when(head.rlike(_TAG_FIRST) | ((k == "?html") & ~part & head.rlike(_TAG_LATER)), "html").when(modifier == "js_", "script").when(modifier == "cs_", "css").otherwise(k)
        return F.when(modifier.isin(*WORKERS), "worker").when(k.isin("?text", "?html") & (part | modifier.isin(*DOCUMENTS)), looked).when(k.isin("?bytes", "html") & part, looked).when(~F.startswith(k, F.lit("?")), k)

    def data(told: Column) -> Column:
        k = F.when(~F.startswith(told["k"], F.lit("?")), told["k"])
        asks = url.rlike("|".join(x.replace(".", "[.]").replace("?", "[?]") for x in DATA_URLS))
        k = F.when((k == "script") & asks, "json").otherwise(k)
        changed = ~told["said"].eqNullSafe(k) | (k == "html")
        return F.when(k.isNotNull() & changed & url.endswith(".json") & F.substring(head, 1, 56).rlike(_JSON_FIRST), "json").otherwise(k)

    return let(F.struct(said.alias("said"), let(said, resolved).alias("k")), data)
