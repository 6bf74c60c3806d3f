"""Keeping a list of access rules, as a table (urlkey, access, user, url): put, remove, import, check, write in order.

A rule is named by its key and its user. Lists of any length are edited by joins on that name, and written in the order in
which rules win: greatest key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import surt
from tidemark.operators.access import ACCESS, ANY, EXACT

#: What a key looks like, as against a URL.
KEY_FORM = r"^([^:.]+[,)])+"


def rule_key(url: Column, exact: Column | bool = False) -> Column:
    """Key of a rule for a URL, or for what is a key already; with ``exact`` for no other URL."""
    key = F.when(url.rlike(KEY_FORM) | (url == ANY), url).otherwise(surt(url))
    return F.concat(key, F.when(exact if isinstance(exact, Column) else F.lit(exact), EXACT).otherwise(""))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["urlkey"] == b["urlkey"]) & a["user"].eqNullSafe(b["user"])


def put(rules: DataFrame, new: DataFrame) -> DataFrame:
    """rules with ``new`` ones in place of those of the same key and user. Of several new ones of one name the greatest access stays."""
    wrong = new.where(~F.coalesce(F.col("access").isin(*ACCESS), F.lit(False)))
    if not wrong.isEmpty():
        raise ValueError(f"access must be one of {', '.join(ACCESS)}")
    once = new.groupBy("urlkey", "user").agg(F.max(F.struct("access", "url")).alias("r")).select("urlkey", "r.access", "user", "r.url")
    return rules.join(once, _same(rules, once), "left_anti").unionByName(once)


def remove(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """rules without those of the keys and users of ``gone``."""
    return rules.join(gone, _same(rules, gone), "left_anti")


def imported(urls: DataFrame, access: str, exact: bool = False, user: str | None = None) -> DataFrame:
    """A rule for each line (``value``) of a list of URLs or keys; blank lines are none."""
    line = F.trim("value")
    return urls.where(line != "").select(rule_key(line, exact).alias("urlkey"), F.lit(access).alias("access"), F.lit(user).cast("string").alias("user"), line.alias("url"))


def ranked(rules: DataFrame, by: Sequence[str] = ("urlkey", "user")) -> DataFrame:
    """rules in the order in which they win."""
    return rules.orderBy(*(F.col(c).desc_nulls_last() for c in by))


def write(rules: DataFrame, path: str) -> None:
    """Writes ``key - {json}`` lines, in order."""
    ranked(rules).select(F.concat_ws(" ", "urlkey", F.lit("-"), F.to_json(F.struct("access", "user", "url"))).alias("line")).write.text(path)
