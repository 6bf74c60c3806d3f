"""Global order without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


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


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns what reads it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sliced(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``_part`` and ``_in``: rows are in global order by these two, whatever the number of partitions."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"))


def with_previous(df: DataFrame, token: Column, *order: Column) -> DataFrame:
    """df with ``_previous``: the token of the row before, in global order; null for the first.

    Inside a slice it is a window of that slice; a slice's first row takes the last token of the nearest slice before
    that has rows. Only one row per slice meets in one task.
    """
    rows = sliced(df.withColumn("_token", F.struct(token.alias("t"))), *order)
    inner = Window.partitionBy("_part").orderBy("_in")
    ends = rows.groupBy("_part").agg(F.max_by("_token", "_in").alias("_end"))
    carried = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_carried"))
    rows = rows.withColumn("_before", F.lag("_token").over(inner)).join(F.broadcast(carried), "_part", "left")
    return rows.withColumn("_previous", F.coalesce("_before", "_carried")["t"]).drop("_token", "_before", "_carried", "_part", "_in")


def with_last(df: DataFrame, value: Column, *order: Column) -> DataFrame:
    """df with ``_last``: the last value that is not null of the rows before, in global order; null if there is none.

    As ``with_previous``: a window inside each slice, and one row a slice carried on.
    """
    rows = sliced(df.withColumn("_value", value), *order)
    inner = Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_in"))).alias("_end"))
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    rows = rows.withColumn("_before", F.last("_value", ignorenulls=True).over(inner)).join(F.broadcast(carried), "_part", "left")
    return rows.withColumn("_last", F.coalesce("_before", "_carried")).drop("_value", "_before", "_carried", "_part", "_in")


def with_running(df: DataFrame, value: Column, keys: list[str], *order: Column) -> DataFrame:
    """df with ``_running``: the sum of value over the rows of its keys before each row; 0 for the first.

    A key's rows may fill many slices: each slice sums its own, and only the keys that reach over a slice's end, two a
    slice at most, carry their sums on.
    """
    rows = sliced(df.withColumn("_value", value), *(F.col(k) for k in keys), *order)
    inner = Window.partitionBy("_part", *keys).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *keys).agg(F.sum("_value").alias("_total"), F.min("_in").alias("_first"))
    starts = totals.groupBy("_part").agg(F.min("_first").alias("_first"), F.max("_first").alias("_last"))
    edge = totals.join(F.broadcast(starts.select(F.col("_part").alias("_p"), F.col("_first").alias("_a"), F.col("_last").alias("_b"))), F.col("_part") == F.col("_p"))
    edge = edge.where("_first = _a or _first = _b")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.withColumn("_carried", F.sum("_total").over(before)).where("_carried is not null and _first = _a").select("_part", "_first", "_carried", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    rows = rows.join(F.broadcast(carried.withColumnRenamed("_part", "_q").drop("_first")), same, "left")
    return rows.withColumn("_running", F.col("_own") + F.coalesce("_carried", F.lit(0))).drop("_value", "_own", "_carried", "_q", *(f"_k{i}" for i in range(len(keys))), "_part", "_in")
