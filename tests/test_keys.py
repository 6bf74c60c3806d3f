"""Keys of URLs: what they are, and the key of a column against that of one URL."""

import random

from pyspark.sql import functions as F

from tidemark.functions.urls import surt, url_key

KEYS = {
    "http://www.Example.com/Path/": "com,example)/path", "http://[::1]:8080/x": "[::1]:8080)/x", "example.com:80": "com,example)/", "http://example.com:abc/x": "com,example:abc)/x", "\thttp://example.com/a\n": "com,example)/a", "https://example.com:443/": "com,example)/",
    "https://example.com:80/": "com,example:80)/", "http://u:p@example.com/?b=2&a=1#f": "com,example)/?a=1&b=2", "http://example.com/a/./b/../c//d/": "com,example)/a/c/d", "http://example.com/../../a": "com,example)/a", "http://example.com/a/..": "com,example)/", "http://example.com/%7Ea%2541": "com,example)/~aa",
    "http://example.com/%41%42?%63=%20": "com,example)/ab?c=%20", "http://example.com/é": "com,example)/%c3%a9", "http://example.com/%C3%A9": "com,example)/%c3%a9", "http://example.com/100%": "com,example)/100%25", "http://example.com/100%25": "com,example)/100%25", "http://example.com/a b": "com,example)/a%20b",
    "http://example.com/p;jsessionid=0123456789abcdef0123456789ABCDEF": "com,example)/p", "http://example.com/(S(4hqa0555fwsecu455xqckv45))/m.aspx": "com,example)/m.aspx", "http://example.com/(4hqa0555fwsecu455xqckv45)/m.aspx?a": "com,example)/m.aspx?a",
    "http://example.com/?PHPSESSID=0123456789abcdef0123456789abcdef&a=1": "com,example)/?a=1", "http://example.com/?a=1&cfid=1&cftoken=2": "com,example)/?a=1", "http://example.com/?": "com,example)/", "http://example.com/?&&a=1&&": "com,example)/?a=1", "http://..example..com./": "com,example)/",
    "urn:X:y": "urn:x:y", "": "", "mailto:a@b.com": "mailto:a@b.com", "//example.com/x": "com,example)/x", "http://www2.example.com?x": "com,example)/?x", "ftp://example.com:80/": "com,example:80)/", "http://1.2.3.4/": "4,3,2,1)/", "example.com/a?b": "com,example)/a?b",
}


def test_keys(spark):
    assert {u: url_key(u) for u in KEYS} == KEYS
    df = spark.createDataFrame([(u,) for u in KEYS] + [(None,)], "u string")
    assert {r[0]: r[1] for r in df.select("u", surt(F.col("u"))).collect()} == {**KEYS, None: None}
    assert all(url_key(f"http://{k.split(')')[0]}/") for k in KEYS.values())


def test_a_key_of_a_key_and_both_functions(spark):
    r = random.Random(6)
    bits = ["http://", "https://", "//", "www.", "www3.", "a.b", "example.com", ":80", ":443", ":8080", ":x", "[::1]", "/", "//", "/./", "/../", "..", ".", "?", "&", "=", "#", "@", "%", "%41", "%2541", "%25", "%c3%a9", "%zz", "é", "ß", "İ", " ", "\t", "\n", "+", ";", "sid=" + "0a" * 16, "&phpsessid=" + "9f" * 16, "x", "Y", "~", "\\", "'", '"', "(", ")", ",", "%2F", "%3f", "%26", "", "\x7f"]
    urls = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(4000)] + ["http://a.com" + "".join(r.choice(bits[12:]) for _ in range(r.randint(1, 9))) for _ in range(2000)]
    got = {x[0]: x[1] for x in spark.createDataFrame([(u,) for u in urls], "u string").select("u", surt(F.col("u"))).collect()}
    assert [(u, got[u]) for u in urls if got[u] != url_key(u)] == []
