"""Scripts for replay: what their rules do, the column form against the form for one value, and pages with scripts in them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions import rewrite as rw
from tidemark.functions.scanning import IT, Rule, scan, scan_text
from tidemark.functions.scripts import CLOSING, EVAL, INSECURE, LOCATED, LOCATION, OPENING, PROXIED, THIS, archive_link, rewrite_inline, rewrite_script, rewrite_scripts, site_rules, worker_script

PLACE = rw.Place("/web/", "2013", "http://example.com/dir/page.html")
LINK = lambda url, modifier: PLACE.link(url, modifier or None)

LOCATED_CASES = [
    ('location = "https://a.org/x.html"', 'WB_wombat_location = "/web/2013/https://a.org/x.html"'), (r'u = "http:\/\/a.org\/x"', r'u = "http:\/\/a.org\/x"'.replace('"http', '"/web/2013/http')), ('u = "//a.org/x?y=http://b.org/"// note', 'u = "/web/2013///a.org/x?y=http://b.org/"// note'),
    ("location = http://a.org/", "WB_wombat_location = http://a.org/"), ('location = "/x"', 'WB_wombat_location = "/x"'), ('"/location" == v; locations = location', '"/location" == v; locations = WB_wombat_location'), ("$location = c ? a.location: location; location$", "$location = c ? a.WB_wombat_location: WB_wombat_location; location$"),
    ('{location: "location", top: " location "}', '{location: "location", top: " WB_wombat_location "}'), ("w.frameElement", "w.WB_wombat_frameElement"), ("if(parent!=top)", "if(parent!=WB_wombat_top)"), ("A = B;//C", "A = B;//C"), ("w.postMessage(m)", "w.__WB_pmw(self.window).postMessage(m)"), ("", ""),
]
PROXIED_CASES = [
    ("var a = this;  location = b", f"var a = {THIS};  location = {LOCATION}b"), ("a = this.location", f"a = {THIS}.location"), ("x\nthis.top = 1", f"x\n{THIS}.top = 1"), ("a = this.location2", "a = this.location2"), ('F("return this")', f'F("return {THIS}")'), ("return  this }", f"return  {THIS} }}"),
    ("if (a != this) {", f"if (a != {THIS}) {{"), ("function(){} (this)", f"function(){{}} ({THIS})"), ("function(){} )  (this); f(this)", f"function(){{}} )  ({THIS}); f(this)"), ("a || this ;", f"a || {THIS} ;"), ("a||this||b", f"a||{THIS}||b"), ("a||this)", f"a||{THIS})"), ("f(a, this)", f"f(a, {THIS})"),
    ("v = this$", "v = this$"), ("v = $this", "v = $this"), ("|||this|||", "|||this|||"), ("a||this|b", "a||this|b"), ("return this.x", "return this.x"), ("{a: b, this: c}", "{a: b, this: c}"), ("this.$location = 1", "this.$location = 1"), ("this. location = 1", f"this. location = {LOCATION}1"),
    ("location == a", "location == a"), ("eval(a)", f"{EVAL}a)"), ("x eval(a)", f"x {EVAL}a)"), (",eval(a)", ",eval(a)"), ("x = eval; x(a)", "x = self.eval; x(a)"), ("f(a, eval(b))", f"f(a, {EVAL}b))"), ("function eval() {}", "function eval() {}"), ("w.eval(a)", "w.eval(a)"), ("{ eval : 1 }", "{ eval : 1 }"), ("a.postMessage(b)", "a.__WB_pmw(self).postMessage(b)"),
]


@pytest.mark.parametrize(("rules", "cases"), [(LOCATED, LOCATED_CASES), (PROXIED, PROXIED_CASES)])
def test_cases_both_ways(spark, rules, cases):
    assert [scan_text(a, rules, LINK) for a, _ in cases] == [b for _, b in cases]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)] + [(-1, None)], "k int, t string")
    got = {r["k"]: r["o"] for r in df.select("k", scan(F.col("t"), rules, archive_link("/web/", F.lit("2013"))).alias("o")).collect()}
    assert got == {-1: None} | {k: b for k, (_, b) in enumerate(cases)}


def test_both_forms_agree(spark):
    r = random.Random(4)
    words = ["this", "location", "top", " ", "  ", "\n", ".", "=", "==", ",", "||", "&&", "eval", "(", ")", "{", "}", "return ", "window", "postMessage(", "$", "?", ":", '"', "'", "http://a.b/c", "//x.y/", "\\/\\/z.w\\/q/", "é", "ß", "self", "frameElement", "﷐", "﷑", "﷒", "﷒0", "function ", ";", "opener", "\t", " "]
    texts = ["".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    extra = (Rule("self", f"<{IT}|{IT}>"), Rule(r"[$]", "dollar", r"(?<=\?)"), INSECURE)
    for rules in (PROXIED, LOCATED, (*extra, *LOCATED)):
        got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scan(F.col("t"), rules, archive_link("http://h/web/", F.lit("2013"), "mp_")).alias("o")).collect()
        place = rw.Place("http://h/web/", "2013", "http://e/", "mp_")
        want = [scan_text(t, rules, lambda u, m: place.link(u, m or None)) for t in texts]
        assert [x["o"] for x in sorted(got)] == want and sum(a != b for a, b in zip(want, texts, strict=True)) > 100


def test_whole_scripts_workers_and_sites(spark):
    config = [{"url_prefix": ["com,example", "org,x)/"], "rewrite": {"js_regexs": [{"match": "some_func\\(\\).*", "replace": "/*{0}*/"}, {"match": r"\burl\((//[^)]+)\)", "group": 1, "rewrite": True}, {"match": "(a|b)c{2}", "replace": "-"}, {"match": "z", "function": "m:f"}]}}, {"url_prefix": "", "rewrite": {"mixin": "m"}}, {"fuzzy_lookup": "()"}]
    sites = site_rules(config)
    assert list(sites) == ["com,example", "org,x)/"] and len(sites["org,x)/"]) == 3
    df = spark.createDataFrame([("x; some_func(); y", "http://www.example.com/a", "js_"), ("some_func()", "http://other.com/", "wkr_"), ("url(//q.com/z) acc bcc", "http://x.org/1", "sw_"), (None, None, None)], "t string, u string, m string")
    link = archive_link("http://h/web/", F.lit("2013"), "mp_")
    got = [r[0] for r in df.select(rewrite_scripts(F.col("t"), F.col("u"), link, "none", sites)).collect()]
    assert got == ["x; /*some_func(); y*/", "some_func()", "url(//h/web/2013mp_///q.com/z) - -", None]
    whole = [r[0] for r in df.select(rewrite_scripts(F.col("t"), F.col("u"), link)).collect()]
    assert whole[1] == OPENING + "some_func()" + CLOSING and whole[3] is None
    started = [r[0] for r in df.select(worker_script(F.col("t"), F.col("m"), "http://h/web/", "http://h/static/", F.col("u"))).collect()]
    assert started[0] == "x; some_func(); y" and started[3] is None
    assert started[1] == "(function() { self.importScripts('http://h/static/wombatWorkers.js'); new WBWombat({'prefix': 'http://h/web/', 'prefixMod': 'http://h/web/wkrf_/', 'originalURL': 'http://other.com/'}); })();some_func()"
    with pytest.raises(ValueError, match="not plain"):
        site_rules([{"url_prefix": "a", "rewrite": {"js_regexs": [{"match": "(a)(b)", "group": 2}]}}])


def test_attributes():
    assert rewrite_inline("foo()", LINK) == "foo()" and rewrite_inline("javascript:foo()", LINK) == "javascript:foo()"
    assert rewrite_inline("window.x\n= 1", LINK) == (OPENING + "window.x\n= 1" + CLOSING).replace("\n", "")
    assert rewrite_inline("javascript:top.x()", LINK).startswith("javascript:var _____WB")
    assert rewrite_inline("location='/x'", LINK, "located") == "window.WB_wombat_location='/x'" and rewrite_inline("a.location", LINK, "located") == "a.WB_wombat_location"
    assert rewrite_script("x", LINK, "none") == "x"


def test_scripts_in_pages():
    html = lambda text, scripts="located": rw.rewrite_html_text(text, PLACE, scripts=scripts)
    assert html('<script>window.location = "http://a.org/b"</script>') == '<script>window.WB_wombat_location = "/web/2013/http://a.org/b"</script>'
    assert html('<script type="application/json">{"a": "http://a.org/"}</script>') == '<script type="application/json">{"a": "http://a.org/"}</script>'
    assert html('<script type="text/javascript">top</script>') == '<script type="text/javascript">WB_wombat_top</script>'
    assert html("<script>top</script>", "proxied") == f"<script>{OPENING}top{CLOSING}</script>" and html("<script></script>", "proxied") == "<script></script>"
    assert html("<script>x</script>", "none") == "<script>x</script>" and html("<script>a<b && '</p>'</script>") == "<script>a<b && '</p>'</script>"
    assert html('<a onclick="location=1" href="javascript:top.x()">') == '<a onclick="window.WB_wombat_location=1" href="javascript:window.WB_wombat_top.x()">'
    assert html('<a on-x="location=1">') == '<a on-x="location=1">'
    assert html('<a target="_top"><a target="x">') == '<a target="___wb_replay_top_frame"><a target="x">'
    assert html('<img crossorigin="anonymous" integrity="x">') == '<img _crossorigin="anonymous" _integrity="x">'
    assert html('<meta http-equiv="Content-Security-Policy" content="default-src http://a.org">').startswith('<meta http-equiv="Content-Security-Policy" _content=')
    assert html('<meta name="referrer" content="origin">') == '<meta name="referrer" content="no-referrer-when-downgrade">'


def test_scripts_by_type(spark):
    df = spark.createDataFrame([("text/javascript", "location", "http://e/"), ("text/html", "<script>top</script>", "http://e/"), ("text/css", "top", "http://e/"), ("application/javascript", None, "http://e/")], "m string, t string, u string")
    for kind, want in (("located", ["WB_wombat_location", "<script>WB_wombat_top</script>", "top", None]), ("none", ["location", "<script>top</script>", "top", None])):
        assert [r[0] for r in df.select(rw.rewrite_by_type(F.col("m"), F.col("t"), "/web/", F.lit("2013"), F.col("u"), scripts=kind)).collect()] == want


JSONP = [
    ('jQuery_ABC({"foo": "bar"})', "http://e/api?callback=jQuery_123&x=1", 'jQuery_123({"foo": "bar"})'), ('abc({"a": 1})', "http://e/api?jsoncallback=n", 'n({"a": 1})'), ('abc({"a": 1})', "http://e/?jsonp=n", 'abc({"a": 1})'), ('abc({"a": 1})', "http://e/?cb=n", 'abc({"a": 1})'),
    ("abc([1])", "http://e/?callback=n", "abc([1])"), ('// note\n /* more */ abc({"a": 1})', "http://e/?callback=n", '// note\n /* more */ n({"a": 1})'), ('/* x */abc({"a": 1})', "http://e/?a=1&callback=n", '/* x */n({"a": 1})'), ('abc({"a": 1})', "http://e/?callback=?", 'abc({"a": 1})'),
    ('abc({"a": 1})', "http://e/?a=1", 'abc({"a": 1})'), ('{"a": 1}', "http://e/?callback=n", '{"a": 1}'), (None, "http://e/?callback=n", None), ('abc({"a": 1})', None, None), ('abc({"$1": 1})', "http://e/?callback=a$1", 'a$1({"$1": 1})'),
]


def test_jsonp(spark):
    df = spark.createDataFrame([(k, b, u) for k, (b, u, _) in enumerate(JSONP)], "k int, b string, u string")
    got = [r["o"] for r in sorted(df.select("k", payload.swap_jsonp(F.col("b"), F.col("u")).alias("o")).collect())]
    assert got == [w if u is not None else b for b, u, w in JSONP]
