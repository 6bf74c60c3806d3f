"""Lineage cuts and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which contraction gives up; each round at least halves the expected number of labels.
MAX_ROUNDS = 64
#: Edges left at which one task ends the contraction: a bound that no input moves (256 KB). A round costs the driver two queries
#: with all their tasks, and the last rounds would do that for a handful of edges each.
LAST = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    A local master, whose driver and executors are one process, gets a folder of its own where neither is set; any other
    must name one.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns what reads it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Steps:
    """Tables of a run that takes several steps, in a folder of its own below the shared one: written compressed, read back with
    their true size, removed once they are of no more use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written under a name; a name that comes again is another table."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables and lets go of the shuffle files of the steps that made them."""
        for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            remove(self.spark, folder)
        release(self.spark)

    def end(self) -> None:
        """Removes all of them."""
        remove(self.spark, self.folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of finished steps. It does so for what the driver's garbage collector
    finds out of use; a step that moves much more data than the driver holds cannot wait for that to happen by chance.
    Spark's event queues hold on to the last query until the next one, so an empty one is run first; and Python's finalizers
    reach the JVM by a thread that looks once a second."""
    spark.range(1).collect()
    gc.collect()
    time.sleep(1.5)
    spark._jvm.System.gc()


#: Bytes of one Arrow batch of texts; Spark's own bound is eight times that, twice over in the JVM and again in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, from now on and for all its queries: rows of text vary too much for a
    bound on rows alone, and the setting is read when a plan runs, not when it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of each of n nodes' components, pairs taken in as they come."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(old, new) of the few edges left: new is the least label of old's component."""
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = forest(len(names), iter([(at[: len(a)], at[len(a) :])]))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["old", "new"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); equal roots mark one component.

    Each round every label moves to the neighbour (or itself) of least hash, under a fresh hash each round, edges are
    rewritten to labels, and loops and repeats go. Labels shrink by a constant factor a round, whatever the shape of
    the component, so paths and stars both take O(log n) rounds. All steps are grouped or joined on labels; the minima
    combine before the shuffle, so a hub costs no task its whole neighbourhood. What is left at LAST edges or fewer is
    ended by one task.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def table(df: DataFrame) -> DataFrame:
        """df, written and read back with its true size: that of a checkpoint is its plan's guess, which joins multiply round by
        round until the planner does nothing but multiply."""
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    live = table(edges.where("a <> b").distinct())
    steps: list[DataFrame] = []
    while (left := live.count()) > LAST:
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError("connected components did not settle")
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salt = F.lit(len(steps))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("n"))
        step = table(best.select(F.col("a").alias("old"), F.least("m", own)["n"].alias("new")))
        steps.append(step)
        mine, other = step.select(F.col("old").alias("a"), F.col("new").alias("na")), step.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        moved = live.join(mine, "a").join(other, "b").where("na <> nb")
        live = table(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    if left:
        steps.append(table(live.coalesce(1).mapInArrow(_end, "old long, new long")))
    labels = live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    if steps:
        labels = steps[0].select(F.col("old").alias("node"), F.col("new").alias("root"))
    for step in steps[1:]:
        labels = table(labels.join(step, labels["root"] == step["old"], "left").select("node", F.coalesce("new", "root").alias("root")))
    labels = materialize(labels)
    remove(spark, folder)
    return labels
