"""Cookies of a domain, kept for the hosts below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for which a cookie is kept after it was last set.
KEPT = 120


def parent_domains(host: Column, suffix_labels: int = 1) -> Column:
    """Domains above a host, nearest first, down to the one registered below a suffix of ``suffix_labels`` labels."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels) - (suffix_labels + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def cookies_for(requests: DataFrame, cookies: DataFrame, kept: int = KEPT, suffix_labels: int = 1) -> DataFrame:
    """(request_id, domain, name, value): cookies (session, domain, name, value, set_at) for requests (request_id, session, host, at, cookie).

    A cookie set for a domain counts for hosts below it, in its session, within ``kept`` seconds of its last setting (its
    last value), unless the request has one of its name already. Hosts meet cookies by equality on each domain above them.
    """
    asked = requests.withColumn("_domain", F.explode(parent_domains(F.col("host"), suffix_labels)))
    given = cookies.select(F.col("session").alias("_session"), F.regexp_replace(F.lower("domain"), r"^\.", "").alias("domain"), "name", "value", "set_at")
    both = asked.join(given, (F.col("session") == F.col("_session")) & (F.col("_domain") == F.col("domain")))
    valid = both.where("set_at <= at").where(F.unix_micros("at") - F.unix_micros("set_at") <= kept * 1_000_000)
    valid = valid.where(~F.contains(F.coalesce("cookie", F.lit("")), F.concat("name", F.lit("="))))
    return valid.groupBy("request_id", "domain", "name").agg(F.max_by("value", F.struct("set_at", "value")).alias("value"))
