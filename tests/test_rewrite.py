"""Payload rewriting and request keys."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rewrite as rw

PAGE = rw.Place("http://archive/coll/", "2014", "http://example.com/some/path/page.html", "mp_")


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("http://other.com/x", "http://archive/coll/2014mp_/http://other.com/x"), ("//cdn.com/x", "//archive/coll/2014mp_///cdn.com/x"), ("/top", "/coll/2014mp_/http://example.com/top"), ("other.html", "other.html"),
        ("../up.html", "/coll/2014mp_/http://example.com/some/up.html"), ("#a", "#a"), ("javascript:x()", "javascript:x()"), ("data:x", "data:x"), ("http://archive/coll/x", "http://archive/coll/x"), ("", ""),
    ],
)
def test_links(value, want):
    assert PAGE.link(value) == want


def test_html():
    head = "http://archive/coll/2014"
    page = '<!doctype html><html><head><title>T &amp; t</title><link rel="stylesheet" href="http://a/s.css"></head><body><a href="http://a/b?x=1&amp;y=2">l</a><img srcset="http://a/1 1x, http://a/2 2x"><!-- c --><style>b{background:url(http://a/i.png)}</style><script src="http://a/j.js" integrity="z"></script><p class=x>t</p></body></html>'
    out = rw.rewrite_html_text(page, PAGE, "<i/>")
    assert "<head><i/><title>T &amp; t</title>" in out and f'href="{head}cs_/http://a/s.css"' in out and f'href="{head}mp_/http://a/b?x=1&amp;y=2"' in out
    assert f'srcset="{head}im_/http://a/1 1x, {head}im_/http://a/2 2x"' in out and "<!-- c -->" in out and f"url({head}oe_/http://a/i.png)" in out
    assert f'src="{head}js_/http://a/j.js" _integrity="z"' in out and "<p class=x>t</p>" in out
    plain = "<p>no <b>links</b> &#39;here&#39; &nbsp; <br/> <custom-tag data-x=1>"
    assert rw.rewrite_html_text(plain, PAGE) == plain and rw.rewrite_html_text("", PAGE) == ""
    assert rw.rewrite_html_text('<meta http-equiv="refresh" content="3; url=http://a/">', PAGE) == f'<meta http-equiv="refresh" content="3; url={head}mp_/http://a/">'
    assert f'href="{head}mp_/http://b.com/y/z"' in rw.rewrite_html_text('<base href="http://b.com/y/"><a href="/y/z">', rw.Place("http://archive/coll/", "2014", "http://a/", "mp_")).replace('href="/coll/', 'href="http://archive/coll/')


def test_variants():
    hls = "#EXTM3U\n#EXT-X-STREAM-INF:PROGRAM-ID=1,BANDWIDTH=100,RESOLUTION=320x180\nlow\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=1280x720\nmid\n#EXT-X-STREAM-INF:BANDWIDTH=9000,RESOLUTION=3840x2160\nhigh\n"
    assert rw.prune_hls(hls) == "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=1280x720\nmid\n"
    assert rw.prune_hls("#EXTM3U\nx") == "#EXTM3U\nx"
    dash = '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet><Representation id="1" bandwidth="5"/><Representation id="2" bandwidth="7"/></AdaptationSet></Period></MPD>'
    assert 'id="2"' in rw.prune_dash(dash) and 'id="1"' not in rw.prune_dash(dash)


def test_cookies_and_xml():
    assert rw.rewrite_cookie("a=b; Path=/x; Domain=example.com; Secure; HttpOnly; Max-Age=3", PAGE) == "a=b; Path=/coll/2014mp_/http://example.com/x; HttpOnly"
    assert rw.rewrite_cookie("a=b", PAGE, "root") == "a=b; Path=/" and rw.rewrite_cookie("a=b", PAGE, "coll") == "a=b; Path=/coll/" and rw.rewrite_cookie("a=b", PAGE, "removeall") == ""
    assert rw.rewrite_xml_text('<a xmlns="http://n/" href="http://a/">http://b/</a>', PAGE) == '<a xmlns="http://n/" href="http://archive/coll/2014mp_/http://a/">http://archive/coll/2014mp_/http://b/</a>'


@pytest.mark.parametrize("text", ["<title>x &a</title>", "a &amp b &amp; c", "\r\n&#65<b>&#x41 &#65;</b>\n&a\n&b;", "x &a", "x &#65", "<p>&", "&&lt&#;x;"])
def test_references_stay_as_they_are(text):
    """With and without their semicolons, at the end of a page too."""
    assert rw.rewrite_html_text(text, PAGE) == text


FORM = b"foo=bar&dir=%2Fbaz&do=true"


@pytest.mark.parametrize(
    ("method", "kind", "body", "want"),
    [
        ("POST", "application/x-www-form-urlencoded", FORM, "__wb_method=POST&foo=bar&dir=/baz&do=true"), ("PUT", "application/octet-stream", b"ab", "__wb_method=PUT&__wb_post_data=YWI="), ("GET", None, b"x", ""), ("OPTIONS", "x", b"y", "__wb_method=OPTIONS"),
        ("POST", "application/json", b'{"a": "b", "c": {"a": 2}, "f": true, "g": [false, null], "h": 44.0, "i": 35.7}', "__wb_method=POST&a=b&a.2_=2&f=true&g=false&g.2_=null&h=44&i=35.7"), ("POST", "application/json", b"no json", "__wb_method=POST"),
        ("POST", "text/plain", b"no json", "__wb_method=POST&__wb_post_data=bm8ganNvbg=="), ("POST", "multipart/form-data; boundary=B", b'--B\r\nContent-Disposition: form-data; name="x"\r\n\r\n1 2\r\n--B--\r\n', "__wb_method=POST&x=1+2"),
        ("POST", "multipart/form-data", FORM, "__wb_method=POST&__wb_post_data=Zm9vPWJhciZkaXI9JTJGYmF6JmRvPXRydWU="), ("POST", None, b"", "__wb_method=POST"), ("POST", "application/x-www-form-urlencoded", b"\xff", "__wb_method=POST&__wb_post_data=/w=="),
    ],
)
def test_bodies(method, kind, body, want):
    assert rw.body_query(method, kind, body) == want


def test_columns(spark):
    rows = [("text/html", '<a href="http://a/">', "2014", "http://e/"), ("text/css", "a{background:url(http://a/)}", "2014", "http://e/"), ("image/png", "http://a/", "2014", "http://e/"), ("text/html", None, None, None), ("application/dash+xml", "<broken", "2014", None), (None, "", None, None)]
    df = spark.createDataFrame(rows, "mime string, body string, ts string, url string")
    got = [r[0] for r in df.select(rw.rewrite_by_type(F.col("mime"), F.col("body"), "/coll/", F.col("ts"), F.col("url"))).collect()]
    assert got == ['<a href="/coll/2014mp_/http://a/">', "a{background:url(/coll/2014oe_/http://a/)}", "http://a/", None, "<broken", ""]
    keyed = spark.createDataFrame([("http://e/?a=1", "POST", "application/x-www-form-urlencoded", b"b=2"), ("http://e/", None, None, None), (None, None, None, None)], "u string, m string, c string, b binary")
    assert [r[0] for r in keyed.select(rw.request_key_url("u", "m", "c", "b")).collect()] == ["http://e/?a=1&__wb_method=POST&b=2", "http://e/", None]
    assert [r[0] for r in spark.createDataFrame([("http://bücher.de/ä b",), (None,)], "u string").select(rw.ascii_url("u")).collect()] == ["http://xn--bcher-kva.de/%C3%A4%20b", None]
    assert df.select(rw.rewrite("hls", F.col("body"), "/p/", F.col("ts"), F.col("url"))).count() == len(rows)
