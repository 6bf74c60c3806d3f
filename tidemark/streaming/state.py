"""State of streams by key, with expiry in event time: counters of pending requests, cookies of a domain.

State lives in the state store (RocksDB), one entry a key, and goes when the watermark has passed its expiry, so it is as
large as what is alive. Expiry is by event time and not by the clock: a stream that is run again gives the same rows. A
key that very many rows have is added up per second before it is dealt out, so that its task gets a row a second at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.cookies import KEPT, parent_domains

#: Seconds after which a counter that nothing touches is gone.
PENDING_SECONDS = 30
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocks(stream: DataFrame) -> None:
    if "RocksDB" not in stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")


def _only_timer(handle: StatefulProcessorHandle, at: int) -> None:
    """The key's one timer, in milliseconds."""
    for other in handle.listTimers():
        handle.deleteTimer(other)
    handle.registerTimer(at)


class _Pending(StatefulProcessor):
    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "pending long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        pending, last = self.held.get() if self.held.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: r["last"]):
            if last and r["last"] > last + self.kept * 1000:  # it had run out before this touch
                pending = 0
            pending, last = pending + r["change"], max(last, r["last"])
            yield Row(key=key[0], pending=pending, at=last)
        self.held.update((pending, last))
        _only_timer(self.handle, last + self.kept * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.held.clear()
        yield Row(key=key[0], pending=0, at=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def pending(stream: DataFrame, key: str, at: str, change: str, lateness: str = "5 seconds", kept: int = PENDING_SECONDS) -> DataFrame:
    """(key, pending, at) as it changes: the sum of ``change`` (1 as a request opens, -1 as it closes, 0 as it goes on) of each key.

    A counter that nothing touches for ``kept`` seconds ends at 0. ``at`` (a timestamp) is the time of the last touch, or of
    the end. Rows later than the watermark, and those without a key or time, count for nothing.
    """
    _needs_rocks(stream)
    given = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(change), F.lit(0)).cast("long").alias("change"))
    by_second = given.withWatermark("at", lateness).groupBy(F.window("at", "1 second"), "key").agg(F.sum("change").alias("change"), F.max(F.unix_millis("at")).alias("last"))
    rows = by_second.select(F.window_time("window").alias("at"), "key", "change", "last")
    out = rows.groupBy("key").transformWithState(_Pending(kept), "key string, pending long, at long", "Append", "EventTime")
    return out.select("key", "pending", F.timestamp_millis("at").alias("at"))


class _Cookies(StatefulProcessor):
    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "name string", "value string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # in the order of time; what is set at the same moment comes before what asks
        for r in sorted(rows, key=lambda r: (r["ms"], r["request_id"] is not None, r["value"] or "", r["request_id"] or 0)):
            if r["request_id"] is None:
                self.held.updateValue((r["name"],), (r["value"], r["ms"]))
                _only_timer(self.handle, max([r["ms"], *(v[1] for v in self.held.values())]) + self.kept * 1000)
                continue
            for (name,), (value, last) in list(self.held.iterator()):
                if 0 <= r["ms"] - last <= self.kept * 1000 and f"{name}=" not in (r["cookie"] or ""):
                    yield Row(request_id=r["request_id"], domain=key[1], name=name, value=value)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def cookie_cache(requests: DataFrame, cookies: DataFrame, lateness: str = "5 seconds", kept: int = KEPT, suffix_labels: int = 1) -> DataFrame:
    """(request_id, domain, name, value) of streams of requests (request_id, session, host, at, cookie) and of cookies set (session, domain, name, value, set_at).

    As ``cookies_for``, over streams: a cookie counts for the hosts below its domain, in its session, for ``kept`` seconds from
    when it was last set, unless a request has one of its name. A request sees what has come in before it or with it.
    """
    _needs_rocks(requests)
    none = lambda kind: F.lit(None).cast(kind)
    asks = requests.withColumn("domain", F.explode(parent_domains(F.col("host"), suffix_labels))).select(
        "session", "domain", F.col("at").cast("timestamp").alias("at"), F.col("request_id").cast("long").alias("request_id"), F.col("cookie"), none("string").alias("name"), none("string").alias("value")
    )
    sets = cookies.select("session", F.regexp_replace(F.lower("domain"), r"^\.", "").alias("domain"), F.col("set_at").cast("timestamp").alias("at"), none("long").alias("request_id"), none("string").alias("cookie"), "name", "value")
    rows = asks.unionByName(sets).withWatermark("at", lateness).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("session", "domain").transformWithState(_Cookies(kept), "request_id long, domain string, name string, value string", "Append", "EventTime")
