"""Fourteen-digit capture times (YYYYMMDDhhmmss), compared as strings."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _HIGH = "00000101000000", "99991231235959"


def pad(value: str, high: bool = False) -> str:
    """A partial time filled up to its earliest or latest moment; month ends follow the calendar."""
    digits = re.sub(r"\D", "", value)[:14]
    if high and len(digits) == 6:
        year, month = int(digits[:4]), int(digits[4:])
        first = datetime(year + month // 12, month % 12 + 1, 1)
        return digits + f"{(first - datetime(year, month, 1)).days:02d}" + _HIGH[8:]
    return digits + (_HIGH if high else _LOW)[len(digits) :]


def moment(timestamp: Column) -> Column:
    """TIMESTAMP of a capture time; null if it is none."""
    return F.try_to_timestamp(timestamp, F.lit("yyyyMMddHHmmss"))


def seconds(timestamp: Column) -> Column:
    return F.unix_seconds(moment(timestamp))


def distance(timestamp: Column, target: str) -> Column:
    """Absolute seconds to a moment given as a (partial) capture time."""
    at = int(datetime.strptime(pad(target), "%Y%m%d%H%M%S").replace(tzinfo=UTC).timestamp())
    return F.abs(seconds(timestamp) - F.lit(at))


def http_date(timestamp: Column) -> Column:
    """As in HTTP headers."""
    return F.date_format(moment(timestamp), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def from_iso(value: Column) -> Column:
    """Capture time of an ISO 8601 date."""
    return F.rpad(F.substring(F.regexp_replace(value, r"\D", ""), 1, 14), 14, "0")
