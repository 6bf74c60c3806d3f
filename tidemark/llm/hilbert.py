"""Sharding along a Hilbert curve, so that each shard spans a small range of every dimension.

Each dimension is quantised at quantiles of the whole table (numbers by a mergeable sketch; texts exactly, whole values
counted and ordered in Spark), the grid cell's place on the Hilbert curve is computed by JVM expressions, rows are ordered by it, and the order is cut into runs whose
row counts differ by at most one. Rows with equal dimensions are ordered by a hash of id, size and text, and rows equal in
all of these (null ids, copies) by their place, so no value, however common, makes a range partition that cannot be cut. Only the dimensions, the id and the size are
shuffled, never the texts.

Defined results: a null text has no bytes, so size 16 and CRC 0; a null dimension sorts first; rows with equal ids are
placed one by one; fewer rows than shards leave some shards empty; an empty table gives an empty result. doc_id, text,
lang and source must be there; columns other than those are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import positions
from tidemark.llm.session import materialize

SHARDS = 40
#: Bits of each dimension's grid; the grid has 2 ** (BITS * dimensions) cells.
BITS = 5
#: Relative accuracy of the quantile sketch is one over this.
SKETCH = 2_000
#: Bytes that every row counts besides its text.
OVERHEAD = 16


def text_edges(df: DataFrame, dim: str, bits: int = BITS) -> list[str]:
    """The 2**bits - 1 quantiles of a text column over all rows, by whole values.

    Rows are counted by value (combined before the shuffle), the values are ordered in Spark, and only the values at which
    the running count passes a quantile come to the driver: 2**bits - 1 at most.
    """
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ordered = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("part", before.alias("before"), F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    here = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = ordered.withColumn("here", here).join(F.broadcast(shifts), "part")
    passed = lambda c: F.expr(f"(({c}) * {1 << bits}L) div total")
    hit = placed.select("v", passed("before + here - n").alias("low"), passed("before + here").alias("high")).where("low < high").collect()
    return [r["v"] for r in sorted(hit, key=lambda r: r["high"]) for k in range(r["low"], r["high"]) if k + 1 < 1 << bits]


def quantised(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """df with ``_cell``: for each of dims (numbers or text), how many of the table's 2**bits - 1 quantiles lie below the value."""
    shares, texts = [k / (1 << bits) for k in range(1, 1 << bits)], [d for d in dims if df.schema[d].dataType.simpleString() == "string"]
    numbers = [d for d in dims if d not in texts]
    found = df.agg(*(F.percentile_approx(d, shares, SKETCH).alias(d) for d in numbers)).first() if numbers else {}
    edges = {d: [float(x) for x in found[d] or ()] for d in numbers} | {d: text_edges(df, d, bits) for d in texts}
    below = lambda d: F.size(F.filter(F.array(*map(F.lit, edges[d])), lambda x: x < F.col(d)))
    return df.withColumn("_cell", F.array(*(below(d) for d in dims)))


def curve_index(cell: Column, dims: int, bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a grid cell (array of ``dims`` ints below 2**bits), by Skilling's transform."""
    # undo excess work from the highest bit down, one axis at a time
    steps = F.array(*(F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(dims))).cast("array<struct<q:int,i:int>>")

    def undo(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(low)
        flip = F.get(x, s["i"]).bitwiseAND(s["q"]) != 0
        flipped = F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, k: F.when((s["i"] > 0) & ((k == 0) | (k == s["i"])), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(flip, flipped).otherwise(swapped)

    # Gray code: each axis takes the running XOR of those before it
    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(dims - 1))
        mask = F.aggregate(F.array(*(F.lit(1 << q) for q in range(bits - 1, 0, -1))).cast("array<int>"), F.lit(0), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(F.array(mask), lambda m: F.transform(x, lambda v: v.bitwiseXOR(m)))[0]

    def interleave(x: Column) -> Column:
        places = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(dims)))
        bit = lambda s: F.when(F.get(x, s["i"]).bitwiseAND(F.call_function("shiftleft", F.lit(1), s["q"])) != 0, F.lit(1)).otherwise(F.lit(0))
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, s: a * 2 + bit(s))

    once = lambda x, f: F.transform(F.array(x), f)[0]
    return once(once(once(F.aggregate(cell, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(v.cast("int")))), lambda x: F.aggregate(steps, x, undo)), gray), lambda x: interleave(finish(x)))


def assign(rows: DataFrame, dims: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """rows (narrow; numbers or text in dims, and _id, size, text_crc32) with shard, slot and ``_curve``; shards are runs of the curve order, equal in rows."""
    placed = quantised(rows, dims).withColumn("_curve", curve_index(F.col("_cell"), len(dims))).drop("_cell")
    shown = [F.col(c) for c in ("_id", "size", "text_crc32")]
    placed = positions(placed, F.col("_curve"), F.xxhash64(*shown), *shown)
    total = max(placed.count(), 1)
    placed = placed.withColumn("shard", F.expr(f"cast((_pos * {shards}) div {total} as int)"))
    # the first place p with (p * shards) div total = shard
    return placed.withColumn("slot", F.expr(f"_pos - (shard * {total}L + {shards - 1}) div {shards}")).drop("_pos")


def described(docs: DataFrame) -> DataFrame:
    """(_id, size, text_crc32 and the curve's dimensions) of each row."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.octet_length(raw).cast("double").alias("_size"),
        F.col("lang").cast("string").alias("_lang"),
        F.col("source").cast("string").alias("_source"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) by language, source and size."""
    placed = assign(described(docs), ["_lang", "_source", "_size"], shards)
    return placed.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs as one Parquet folder a shard, each ordered along the curve; ids must be unique to be placed."""
    placed = shard_documents(docs, shards).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.join(placed, docs["doc_id"].eqNullSafe(placed["_id"])).drop("_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents in 40 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
