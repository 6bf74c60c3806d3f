"""Access rules and embargoes over captures.

A rule holds for every key that starts with its key, for exactly one key when it ends in ``###``, or for all keys when it
is ``*,``. Of the rules that hold, the bytewise greatest key wins, then a rule for the acting user over one for everybody;
``*,`` ranks last. A rule's first date condition, of before, after, newer and older, must be met, else the default holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import let
from tidemark.functions.times import moment, pad

EXACT, ANY = "###", "*,"
ACCESS = ("allow", "block", "exclude", "allow_ignore_embargo")
#: Up to so many rules become one literal of the plan; more are joined. Results are the same.
INLINE = 256


@dataclass(frozen=True)
class Rule:
    """``access`` is one of ACCESS."""

    urlkey: str
    access: str
    user: str | None = None
    before: str | None = None
    after: str | None = None
    newer: dict[str, int] | None = None
    older: dict[str, int] | None = None

    def __post_init__(self):
        if self.access not in ACCESS:
            raise ValueError(f"unknown access: {self.access}")


def _interval(delta: dict[str, int]) -> Column:
    return F.make_interval(*(F.lit(delta.get(k, 0)) for k in ("years", "months", "weeks", "days")))


def _met(ts: Column, rule: Rule, as_of: datetime) -> Column | None:
    """Whether a capture time meets the first date condition; None without one. before and after are strict."""
    now = F.lit(as_of).cast("timestamp")
    if rule.before:
        return ts < F.to_timestamp(F.lit(pad(rule.before)), "yyyyMMddHHmmss")
    if rule.after:
        return ts > F.to_timestamp(F.lit(pad(rule.after)), "yyyyMMddHHmmss")
    if rule.newer:
        return ts > now - _interval(rule.newer)
    if rule.older:
        return ts < now - _interval(rule.older)
    return None


def ranking(rules: Sequence[Rule], user: str | None = None) -> list[int]:
    """Indices of the rules that a user is under, the one that wins over all others first; of equal ones the first given."""
    able = [k for k, r in enumerate(rules) if r.user is None or r.user == user]
    return sorted(able, key=lambda k: (rules[k].urlkey != ANY, rules[k].urlkey, rules[k].user is not None), reverse=True)


def best_rule(urlkey: Column, rules: Sequence[Rule], user: str | None = None) -> Column:
    """Index in ``rules`` of the rule that holds for a key; null if none does.

    Rule keys of one length can hold for a key only by equality with its head, so each length is one map lookup.
    """
    ranked = [(k, rules[k]) for k in ranking(rules, user)]
    exact = {r.urlkey.removesuffix(EXACT): k for k, r in reversed(ranked) if r.urlkey.endswith(EXACT)}
    heads: dict[int, dict[str, int]] = {}
    for k, r in reversed(ranked):
        if not r.urlkey.endswith(EXACT) and r.urlkey != ANY:
            heads.setdefault(len(r.urlkey), {})[r.urlkey] = k
    find = lambda m, key: F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), key)
    # an exact key sorts after every head of the same URL but a longer one, and a longer head cannot hold
    tries = [find(exact, urlkey)] if exact else []
    tries += [find(m, F.left(urlkey, F.lit(n))) for n, m in sorted(heads.items(), reverse=True)]
    tries += [F.lit(k) for k, r in ranked if r.urlkey == ANY][:1]
    return F.coalesce(*tries, F.lit(None).cast("int")) if tries else F.lit(None).cast("int")


#: A rule as a row: its access, and its date condition if it has one (which, and the time or the interval that it names).
RULE_ROW = "access string, condition string, stamp string, years int, months int, weeks int, days int"


def _row(rule: Rule) -> tuple:
    condition = next((k for k in ("before", "after", "newer", "older") if getattr(rule, k)), None)
    given = getattr(rule, condition) if condition else None
    spans = [given.get(k, 0) if isinstance(given, dict) else 0 for k in ("years", "months", "weeks", "days")]
    return rule.access, condition, pad(given) if isinstance(given, str) else None, *spans


def _row_access(rule: Column, timestamp: Column, default: str, as_of: datetime | None) -> Column:
    """Access that a rule's row gives a capture time; before, after, newer and older are strict."""
    ts, now = moment(timestamp), F.lit(as_of or datetime.now(UTC)).cast("timestamp")
    bound = F.coalesce(F.to_timestamp(rule["stamp"], "yyyyMMddHHmmss"), now - F.make_interval(rule["years"], rule["months"], rule["weeks"], rule["days"]))
    met = F.when(rule["condition"].isin("before", "older"), ts < bound).otherwise(ts > bound)
    return F.when(rule.isNull(), default).when(rule["condition"].isNull() | met, rule["access"]).otherwise(default)


def rule_access(captures: DataFrame, rules: Sequence[Rule], user: str | None = None, default: str = "allow", as_of: datetime | None = None) -> Column:
    """Access that the rules give a capture, date conditions included: one lookup of the rule, and one of its row."""
    if not rules:
        return F.lit(default)
    names = [c.split()[0] for c in RULE_ROW.split(", ")]
    rows = F.array(*(F.struct(*(F.lit(v).cast(c.split()[1]).alias(n) for v, c, n in zip(_row(r), RULE_ROW.split(", "), names, strict=True))) for r in rules))
    return let(F.get(rows, best_rule(F.col("urlkey"), rules, user)), lambda r: _row_access(r, F.col("timestamp"), default, as_of))


def embargo_access(embargo: Rule | None, as_of: datetime | None = None) -> Column:
    """Access that an embargo gives a capture; null where it says nothing."""
    if embargo is None:
        return F.lit(None).cast("string")
    met = _met(moment(F.col("timestamp")), embargo, as_of or datetime.now(UTC))
    return F.when(met, embargo.access) if met is not None else F.lit(None).cast("string")


def control(captures: DataFrame, rules: Sequence[Rule], user: str | None = None, default: str = "allow", embargo: Rule | None = None, as_of: datetime | None = None) -> DataFrame:
    """Captures with ``access``; excluded ones go. Runs after limits, so excluded rows have used them up.

    An embargo overrides a rule's access unless that is exclude or allow_ignore_embargo, which then prints as allow. Rows
    without a URL pass.
    """
    if len(rules) > INLINE:
        given = joined_access(captures, rules, user, default, as_of)
    else:
        given = captures.withColumn("_rule", rule_access(captures, rules, user, default, as_of))
    held = embargo_access(embargo, as_of)
    access = F.when(F.col("_rule").isin("exclude", "allow_ignore_embargo"), F.col("_rule")).otherwise(F.coalesce(held, "_rule"))
    shown = F.when(access == "allow_ignore_embargo", "allow").otherwise(F.coalesce(F.when(access != "", access), F.lit(default)))
    out = given.withColumn("access", F.when(F.col("url").isNotNull(), shown)).drop("_rule")
    return out.where(F.col("url").isNull() | (F.col("access") != "exclude"))


def joined_access(captures: DataFrame, rules: Sequence[Rule], user: str | None = None, default: str = "allow", as_of: datetime | None = None) -> DataFrame:
    """captures with ``_rule``, the access that rules of any number give: keys are cut at the rules' lengths and joined on equality."""
    places = ranking(rules, user)
    table = [(n, rules[k].urlkey.removesuffix(EXACT), rules[k].urlkey.endswith(EXACT), *_row(rules[k])) for n, k in enumerate(places) if rules[k].urlkey != ANY]
    rows = captures.sparkSession.createDataFrame(table, f"place int, head string, exact boolean, {RULE_ROW}")
    lengths = sorted({len(r[1]) for r in table})
    cuts = captures.select("urlkey").distinct().select("urlkey", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.left("urlkey", n)))).alias("head"))
    hits = cuts.join(rows, "head").where("not exact or head = urlkey")
    best = hits.groupBy("urlkey").agg(F.min(F.struct("place", *(c.split()[0] for c in RULE_ROW.split(", ")))).alias("_best"))
    every = [rules[k] for k in places if rules[k].urlkey == ANY][:1]
    rest = _row_access(F.struct(*(F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(_row(every[0]), RULE_ROW.split(", "), strict=True))), F.col("timestamp"), default, as_of) if every else F.lit(default)
    found = F.when(F.col("_best").isNotNull(), _row_access(F.col("_best"), F.col("timestamp"), default, as_of)).otherwise(rest)
    return captures.join(best, "urlkey", "left").withColumn("_rule", found).drop("_best")
