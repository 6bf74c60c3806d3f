"""Kinds of payloads against what is declared."""

from pyspark.sql import functions as F

from tidemark.functions.sniffing import kind_of_text

PAGE, JSON, CODE = "<!doctype html><p>", ' {"a": 1}', "var a = 1;"
CASES = [
    ("text/html", "", PAGE, "http://e/", "html"), ("text/html; charset=utf-8", "mp_", "﻿ \n<p>", "http://e/", "html"), ("text/html", "js_", CODE, "http://e/a.js", "script"), ("text/html", "js_", PAGE, "http://e/a.js", "html"), ("text/html", "cs_", "a{}", "http://e/", "css"),
    ("text/html", "mp_", "plain words", "http://e/", None), ("text/html", "mp_", "words <b>bold</b>", "http://e/", "html"), ("text/html", "mp_", "words\n<b>", "http://e/", None), ("text/html", "im_", PAGE, "http://e/", None), ("text/plain", "", PAGE, "http://e/", "html"), ("text/plain", "", "words <b>x</b>", "http://e/", None),
    ("text/plain", "js_", CODE, "http://e/", "script"), (None, None, PAGE, None, "html"), ("", "im_", PAGE, "http://e/", None), ("application/octet-stream", "", PAGE, "http://e/", None), ("application/octet-stream", "cs_", "a{}", "http://e/", "css"), ("application/octet-stream", "js_", PAGE, "http://e/", "html"),
    ("application/xhtml+xml", "", CODE, "http://e/", "html"), ("application/xhtml+xml", "js_", CODE, "http://e/", "script"), ("text/css", "js_", CODE, "http://e/", "css"), ("application/javascript", "", CODE, "http://e/?callback=jQuery1", "json"), ("application/javascript", "", CODE, "http://e/x.json?a", "json"),
    ("application/javascript", "", CODE, "http://e/xjson?a", "script"), ("text/html", "js_", JSON, "http://e/a.json", "json"), ("text/html", "js_", JSON, "http://e/a", "script"), ("application/xhtml+xml", "", JSON, "http://e/a.json", "json"), ("application/json", "", JSON, "http://e/a.json", "json"), ("image/png", "", PAGE, "http://e/", None),
    ("text/html", "wkr_", CODE, "http://e/", "worker"), ("image/png", "sw_", CODE, "http://e/", "worker"), ("text/html", "", None, "http://e/", None), ("text/xml", "mp_", "<a/>", "http://e/", None), ("application/dash+xml", "", "<MPD>", "http://e/", "dash"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, t string, m string, b string, u string")
    got = {r["k"]: r["kind"] for r in df.select("k", kind_of_text(F.col("t"), F.col("m"), F.col("b"), F.col("u")).alias("kind")).collect()}
    assert [(CASES[k], got[k]) for k in range(len(CASES)) if got[k] != CASES[k][4]] == []
