"""Archive files of a stream of records: files that stay open over batches, and close by size or by silence.

A file that is open is a row of a small table (how many bytes it has, when it was last written to, its parts) and a part
file a batch. A batch numbers its records by running size from where its collection stands, writes them as parts, and joins
the parts of the files that are done: compressed members one after the other are an archive. A file is done when its
records have passed the size, or when the watermark has passed ``idle_seconds`` after its last record and the next record, if any,
comes later than that. All is named by the number of the batch: a batch that is run again writes the same.

A collection that most records belong to is dealt over ``lanes``, each with files of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ordering import materialize
from tidemark.sources.store import Draft, Opened, folders, removed
from tidemark.sources.writing import MAX_BYTES, file_name, numbered, record_bytes, write_files

#: Seconds of silence after which a file closes.
IDLE_SECONDS = 600
OPEN = "collection string, base long, file_no long, total long, last timestamp, parts array<string>, records long"
CLOSED = "collection string, file_no long, path string, records long, bytes long, parts array<string>"


@dataclass(frozen=True)
class ArchiveWriter:
    """Writes records (collection, seq, at, and those of ``record_bytes``) below a folder; ``write`` is for foreachBatch.

    Records without a time never make a file fall silent; those without a collection have files of their own. ``at`` later than the watermark
    ends no silence that has ended already: such records open the next file.
    """

    folder: str
    max_bytes: int = MAX_BYTES
    idle_seconds: int = IDLE_SECONDS
    lateness_seconds: int = 60
    lanes: int = 1

    def _last(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, object]:
        """Files open before a batch, and the latest time seen before it."""
        known = sorted(k for k in folders(f"{self.folder}/open", "batch") if k < batch_id)
        if not known:
            return spark.createDataFrame([], OPEN), None
        rows = spark.read.schema(f"{OPEN}, seen timestamp").parquet(f"{self.folder}/open/batch={known[-1]}")
        seen = rows.agg(F.max("seen")).first()[0]
        return rows.where("parts is not null").drop("seen"), seen

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; the same number again writes the same."""
        spark = batch.sparkSession
        self._sweep(spark, batch_id)
        lane = F.concat_ws("~", F.coalesce("collection", F.lit("")), F.when(F.lit(self.lanes) > 1, F.pmod(F.xxhash64("seq"), F.lit(self.lanes)).cast("string")))
        sized = record_bytes(batch.withColumns({"collection": lane, "at": F.col("at").cast("timestamp")})).select("collection", "seq", "at", "record", "length")
        sized = materialize(sized)
        before, seen = self._last(spark, batch_id)
        mine = materialize(sized.groupBy("collection").agg(F.min("at").alias("begins"), F.max("at").alias("ends"), F.sum("length").alias("more"), F.count(F.lit(1)).alias("n")))
        newest = mine.agg(F.max("ends")).first()[0]
        seen = max((x for x in (seen, newest) if x is not None), default=None)
        # files that have been silent for long enough, before anything of this batch
        silent_at = F.col("last") + F.expr(f"interval {self.idle_seconds} seconds")
        passed = F.lit(seen).cast("timestamp") - F.expr(f"interval {self.lateness_seconds} seconds") > silent_at
        held = materialize(before.join(mine.select("collection", "begins"), "collection", "left").withColumn("silent", F.coalesce(passed & (F.col("begins").isNull() | (F.col("begins") > silent_at)), F.lit(False))))
        # numbers of a collection that has no open file begin anew, with the batch's own, so that no name comes twice
        fresh = batch_id << 20
        carried = held.where("not silent").select("collection", "base", "total")
        parts = write_files(numbered(sized, self.max_bytes, carried, fresh), f"{self.folder}/parts/batch={batch_id}", ".part")
        parts = parts.select("collection", "file_no", F.col("path").alias("part"), F.col("records").alias("n"))
        ends = mine.join(carried, "collection", "left").select("collection", "ends", F.coalesce("base", F.lit(fresh)).alias("to"), (F.col("more") + F.coalesce("total", F.lit(0))).alias("now"))
        together = held.drop("begins").join(parts, ["collection", "file_no"], "full").join(ends, "collection", "left")
        fed, none = F.col("part").isNotNull(), F.array().cast("array<string>")
        full = F.col("now") >= (F.col("file_no") - F.col("to") + 1) * self.max_bytes
        rows = together.select(
            "collection", F.when(fed, F.col("to")).otherwise(F.col("base")).alias("base"), "file_no", F.when(fed, F.col("now")).otherwise(F.col("total")).alias("total"), F.when(fed, F.greatest("last", "ends")).otherwise(F.col("last")).alias("last"),
            F.concat(F.coalesce("parts", none), F.when(fed, F.array("part")).otherwise(none)).alias("parts"), (F.coalesce("records", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("records"),
            (F.coalesce("silent", F.lit(False)) | F.coalesce((F.col("file_no") >= F.col("to")) & full, F.lit(False))).alias("done"),
        )
        rows = materialize(rows)
        self._close(rows.where("done"), batch_id)
        still = rows.where("not done").select("collection", "base", "file_no", "total", "last", "parts", "records")
        marker = spark.createDataFrame([(seen,)], "seen timestamp")
        still.unionByName(marker, allowMissingColumns=True).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch_id}")

    def _close(self, done: DataFrame, batch_id: int) -> None:
        """Joins the parts of files that are done, one task a file, and notes them."""
        folder, tasks = f"{self.folder.rstrip('/')}/files", int(done.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                paths, sizes = [], []
                for name, number, parts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    out = Draft(f"{folder}/{file_name(name, number)}.warc.gz")
                    for part in parts:
                        with Opened(part) as f:
                            for piece in f.through(0):
                                out.write(piece)
                    out.close()
                    paths.append(f"{folder}/{file_name(name, number)}.warc.gz")
                    sizes.append(out.size)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string()), b.column(3), pa.array(sizes, pa.int64()), b.column(2)], names=["collection", "file_no", "path", "records", "bytes", "parts"])

        rows = done.select("collection", "file_no", "parts", "records").repartition(tasks, "collection", "file_no").mapInArrow(join, CLOSED)
        rows.write.mode("overwrite").parquet(f"{self.folder}/closed/batch={batch_id}")

    def _sweep(self, spark: SparkSession, batch_id: int) -> None:
        """Parts of files closed by batches before the last one go: those batches are never run again."""
        for k in sorted(folders(f"{self.folder}/parts", "batch")):
            if k < batch_id - 1 and not self._needs(spark, k, batch_id - 1):
                removed(f"{self.folder}/parts/batch={k}")
        for k in (x for x in folders(f"{self.folder}/open", "batch") if x < batch_id - 2):
            removed(f"{self.folder}/open/batch={k}")

    def _needs(self, spark: SparkSession, k: int, since: int) -> bool:
        known = [x for x in folders(f"{self.folder}/open", "batch") if x <= since]
        if not known:
            return True
        last = [spark.read.schema(OPEN).parquet(f"{self.folder}/open/batch={x}") for x in sorted(known)[-2:]]
        return any(not rows.where(F.exists("parts", lambda p: F.contains(p, F.lit(f"/parts/batch={k}/")))).isEmpty() for rows in last)

    def finish(self, spark: SparkSession, batch_id: int) -> None:
        """Closes all files that are open, as an end of the stream; ``batch_id`` is one after the last."""
        rows, _ = self._last(spark, batch_id)
        self._close(rows, batch_id)
        spark.createDataFrame([], f"{OPEN}, seen timestamp").write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch_id}")

    def files(self, spark: SparkSession) -> DataFrame:
        """(collection, file_no, path, records, bytes, batch) of the files that are done."""
        return spark.read.option("basePath", f"{self.folder}/closed").parquet(f"{self.folder}/closed").drop("parts")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Starts the stream; ``availableNow=True`` (the default) takes what is there and ends."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
