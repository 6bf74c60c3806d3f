"""Column expressions shared by the native operators. They stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The characters that separate words: 0x20 and 0x09-0x0D.
WHITE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D, in order."""
    return let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``_pos``, each row's place from 0 under ``order``; rows that order leaves equal come in any order.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the sizes of the partitions
    before it; only those sizes, one per partition, meet in one task. Equal rows are told apart by a scrambled row place,
    so that they fill as many partitions as others do. df is written once.
    """
    from tidemark.llm.session import materialize

    order = (*order, F.xxhash64(F.monotonically_increasing_id()))
    keys = [f"_o{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_mono", F.monotonically_increasing_id())
    placed = materialize(placed.withColumns({"_part": F.shiftright("_mono", 33), "_in": F.col("_mono").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(shifts), "_part").withColumn("_pos", F.col("_before") + F.col("_in")).drop("_part", "_mono", "_in", "_before")
