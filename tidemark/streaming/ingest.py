"""Streaming ingestion: archives to index, dedup against all that came before, sessions and windows with late data.

A micro-batch is deduplicated by the batch operators against a table of what came before, not by per-key state: a digest
that a third of all rows share is then a skewed join, which adaptive execution splits, instead of one overloaded state.
The table is kept in buckets by a hash of the key, merged now and then to one file each, and a batch opens the buckets of
its own keys alone, so what a small batch reads does not grow with the number of batches before it.
Every batch writes one folder, replacing what an attempt cut short has left there, so repeats change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.captures import is_revisit
from tidemark.operators.ordering import materialize
from tidemark.sources.archives import captures_of, records_from
from tidemark.sources.store import folders, moved, removed

SEEN = "key string, first struct<timestamp: string, seq: string, url: string>, bucket int"
POLICIES = ("revisit", "skip", "keep")


def archive_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Captures of archive files as they arrive in a folder; files seen before are left out by the checkpoint."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length")
    return captures_of(records_from(files))


def event_time(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """The stream with a watermark; times without zone become UTC moments first, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def windowed(stream: DataFrame, column: str, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Counts of tumbling (or sliding) windows; rows later than the watermark are dropped."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    return stream.groupBy(w.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("captures")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "captures")


def session_counts(stream: DataFrame, column: str, key: str, gap: str) -> DataFrame:
    """Closed sessions of each key. Filter the written result, not this frame: such filters would move below the merge."""
    w = F.session_window(column, gap)
    return stream.groupBy(w.alias("_w"), key).agg(F.count(F.lit(1)).alias("captures")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), key, "captures")


def distinct_within(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: bounded state, for streams whose repeats come close together."""
    return stream.dropDuplicatesWithinWatermark(keys)


@dataclass(frozen=True)
class Ingest:
    """A captures table that streams append to, under a dedup policy.

    revisit: a capture whose digest came before is written as a revisit of the first with it (mime warc/revisit,
    ``refers_url``, ``refers_timestamp``); skip: a capture whose URL came before is dropped; keep: all are written.
    ``before`` means an earlier batch, or an earlier (timestamp, seq) of the same batch: what comes late is judged by
    what is there. Revisits are no originals. Null or empty digests and null URLs equal nothing.
    """

    folder: str
    policy: str = "revisit"
    #: Parts of the table of keys seen, by a hash of the key, and batches after which what they added is merged into one file a part.
    buckets: int = 1024
    merged_every: int = 32

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"unknown dedup policy: {self.policy}")

    @property
    def _key(self) -> str:
        return "digest" if self.policy == "revisit" else "url"

    def _seen(self, spark: SparkSession, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """First capture (url, timestamp) of each key of earlier batches, of some buckets or all; the folders of other buckets are not opened."""
        bases, added = (sorted(k for k in folders(f"{self.folder}/{n}", "batch") if k <= batch_id) for n in ("merged", "seen"))
        since = bases[-1] if bases else 0
        paths = [(f"{self.folder}/merged/batch={since}", since - 1)] if bases else []
        paths += [(f"{self.folder}/seen/batch={k}", k) for k in added if since <= k < batch_id]
        out = None
        for path, k in paths:
            there = folders(path, "bucket")
            own = [f"{path}/bucket={b}" for b in (there if buckets is None else there & set(buckets))]
            if own:
                rows = spark.read.schema(SEEN).option("basePath", path).parquet(*own).select("key", "first", F.lit(k).alias("batch"), "bucket")
                out = rows if out is None else out.unionByName(rows)
        return out

    def _merge(self, spark: SparkSession, batch_id: int) -> None:
        """Writes all keys of batches before this one as one file a bucket; what is merged twice over goes."""
        if not batch_id or batch_id % self.merged_every:
            return
        if batch_id not in folders(f"{self.folder}/merged", "batch"):
            seen = self._seen(spark, batch_id)
            if seen is None:
                return
            whole = seen.groupBy("bucket", "key").agg(F.min_by("first", "batch").alias("first"))
            draft = f"{self.folder}/merged/draft-{batch_id}"
            whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(draft)
            moved(draft, f"{self.folder}/merged/batch={batch_id}")
        old = sorted(k for k in folders(f"{self.folder}/merged", "batch") if k < batch_id)[:-1]
        for k in old:
            removed(f"{self.folder}/merged/batch={k}")
        for k in (x for x in folders(f"{self.folder}/seen", "batch") if old and x < old[-1]):
            removed(f"{self.folder}/seen/batch={k}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch, for foreachBatch; the same id again writes the same."""
        place = lambda name: f"{self.folder}/{name}/batch={batch_id}"
        if self.policy == "keep":
            batch.write.mode("overwrite").parquet(place("captures"))
            return
        usable = F.col(self._key).isNotNull() & (F.col(self._key) != "")
        if self.policy == "revisit":
            usable &= ~F.coalesce(is_revisit(batch), F.lit(False))
        spark = batch.sparkSession
        self._merge(spark, batch_id)
        first = F.min(F.struct("timestamp", "seq", "url")).alias("first")
        mine = batch.where(usable).groupBy(F.col(self._key).alias("key")).agg(first).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        mine = materialize(mine)
        was = self._seen(spark, batch_id, [r[0] for r in mine.select("bucket").distinct().collect()])
        firsts = mine.withColumn("was", F.lit(None).cast("struct<timestamp:string,seq:string,url:string>")) if was is None else mine.join(was.groupBy("key").agg(F.min_by("first", "batch").alias("was")), "key", "left")
        # keys of one task are those of one range of buckets, so that a batch adds few files
        kept = F.struct(F.col("first.timestamp").alias("timestamp"), F.col("first.seq").cast("string").alias("seq"), F.col("first.url").alias("url"))
        new = firsts.where("was is null").select("key", kept.alias("first"), "bucket").repartitionByRange("bucket").sortWithinPartitions("bucket", "key")
        new.write.mode("overwrite").partitionBy("bucket").parquet(place("seen"))
        rows = batch.join(firsts, usable & (F.col(self._key) == F.col("key")), "left")
        again = F.coalesce((F.col("was").isNotNull() | (F.col("first") != F.struct("timestamp", "seq", "url"))) & F.col("key").isNotNull(), F.lit(False))
        if self.policy == "skip":
            rows = rows.where(~again).select(*batch.columns)
        else:
            told = {"mime": F.when(again, "warc/revisit").otherwise(F.col("mime")), "refers_url": F.when(again, F.coalesce("was.url", "first.url")), "refers_timestamp": F.when(again, F.coalesce("was.timestamp", "first.timestamp"))}
            rows = rows.withColumns(told).drop("key", "first", "was", "bucket")
        rows.write.mode("overwrite").parquet(place("captures"))

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Starts the stream; ``availableNow=True`` (the default) takes what is there and ends."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def captures(self, spark: SparkSession) -> DataFrame:
        """All that has been written."""
        return spark.read.option("basePath", f"{self.folder}/captures").parquet(f"{self.folder}/captures").drop("batch")


def each_batch(*steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several writers of one stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            step(batch, batch_id)

    return write
