"""Packing into optimal length buckets.

All lengths enter one exact histogram, summed before the shuffle. d distinct lengths need d * d / 2 tokens at least, so it has
fewer than sqrt(2 * tokens) rows: 6 million for 100 TB of text, a few thousand in practice. Dynamic programming over it picks
the bucket bounds of least total padding; as the best cut moves one way only, a bucket costs d log d. Inside a bucket rows are ordered by a hash of their id and cut into batches of as many rows as the token budget
holds at the bucket's bound. Places come from one range-partitioned order of all rows, not from a task per bucket, so
a bucket may hold any share of the corpus. A token is a word here (a run of characters other than 0x20 and 0x09-0x0D);
``pack`` takes any other count, such as that of a byte-level encoder.

Defined results: a null or wordless text has length 0 and is packed like others; a row longer than the budget gets a batch
of its own, whole; rows with equal ids are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import positions, text_of, word_array
from tidemark.llm.session import materialize

#: Padded tokens of one batch, and the number of buckets.
BUDGET, BUCKETS = 65_536, 16


@dataclass(frozen=True)
class Bounds:
    """Greatest length of each bucket, ascending, and rows in each bucket."""

    upper: tuple[int, ...]
    rows: tuple[int, ...]
    padding: int


def _row_minima(cost: np.ndarray, upper: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of cost[i] + upper[j] * (count[j + 1] - count[i]) over i <= j, and the i that has it.

    The i of least cost never falls as j grows, so the middle row of a span bounds the rows on either side; all spans of
    one depth are searched together, which takes a pass over the columns for each halving of the rows.
    """
    n = len(upper)
    best, at = np.full(n, np.inf), np.zeros(n, np.int64)
    spans = np.array([[0, n, 0, n - 1]])  # rows [low, high), columns [first, last]
    while len(spans):
        low, high, first, last = spans.T
        row = (low + high) // 2
        width = np.maximum(np.minimum(last, row) - first + 1, 1)
        starts = np.concatenate(([0], np.cumsum(width)[:-1]))
        span = np.repeat(np.arange(len(spans)), width)
        column = first[span] + np.arange(width.sum()) - starts[span]
        price = cost[column] + upper[row[span]] * (count[row[span] + 1] - count[column])
        best[row] = np.minimum.reduceat(price, starts)
        hits = np.flatnonzero(price == best[row][span])
        _, one = np.unique(span[hits], return_index=True)
        at[row] = column[hits[one]]
        halves = np.concatenate((np.stack([low, row, first, at[row]], 1), np.stack([row + 1, high, at[row], last], 1)))
        spans = halves[halves[:, 0] < halves[:, 1]]
    return best, at


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> Bounds:
    """Bounds of least padding for (length, rows) in ascending order of length; every length may be a bound."""
    if not histogram:
        return Bounds((), (), 0)
    upper = np.array([h[0] for h in histogram], np.float64)
    count = np.concatenate(([0], np.cumsum([h[1] for h in histogram], dtype=np.float64)))
    n = len(upper)
    cost, back = np.full(n + 1, np.inf), []
    cost[0] = 0
    for _ in range(min(buckets, n)):
        least, choice = _row_minima(cost[:-1], upper, count)
        cost = np.concatenate(([np.inf], least))
        back.append(choice)
    cuts, j = [], n
    for choice in reversed(back):
        cuts.append(j)
        j = int(choice[j - 1])
    cuts.reverse()
    bounds = [int(upper[c - 1]) for c in cuts]
    rows = [int(count[c] - count[b]) for b, c in zip([0, *cuts], cuts, strict=False)]
    return Bounds(tuple(bounds), tuple(rows), int(sum(b * r for b, r in zip(bounds, rows, strict=True)) - sum(h[0] * h[1] for h in histogram)))


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> Bounds:
    """Bounds over all rows of ``n_tokens``."""
    rows = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toArrow()
    return best_bounds(sorted(zip(rows["n_tokens"].to_pylist(), rows["rows"].to_pylist(), strict=True)), buckets)


def pack(rows: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """rows (narrow: doc_id, n_tokens long) with bucket, bound, batch (gapless over all buckets), slot and padding."""
    bounds = bucket_bounds(rows, buckets)
    bucket = F.lit(0)
    for b in bounds.upper:
        bucket = bucket + F.when(F.col("n_tokens") > b, 1).otherwise(0)
    fits = [max(1, budget // max(b, 1)) for b in bounds.upper]
    before = np.concatenate(([0], np.cumsum(bounds.rows))).astype(int).tolist()
    batches = np.concatenate(([0], np.cumsum([-(-r // f) for r, f in zip(bounds.rows, fits, strict=True)]))).astype(int).tolist()
    pick = lambda values: F.get(F.array(*(F.lit(int(v)).cast("long") for v in values or [0])), F.col("bucket"))
    others = [c for c in rows.columns if c not in ("doc_id", "n_tokens")]
    placed = positions(rows.withColumn("bucket", bucket), F.col("bucket"), F.xxhash64("doc_id", "n_tokens"), F.col("doc_id"), F.col("n_tokens"))
    placed = placed.withColumns({"bound": pick(bounds.upper), "_at": F.col("_pos") - pick(before[:-1]), "_fit": pick(fits), "_first": pick(batches[:-1])})
    placed = placed.withColumns({"batch": F.expr("_first + _at div _fit"), "slot": F.col("_at") % F.col("_fit"), "padding": F.col("bound") - F.col("n_tokens")})
    return placed.select("doc_id", "n_tokens", "bucket", "bound", "batch", "slot", "padding", *others)


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def pack_documents(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch, slot, padding) of rows packed by the words of their whole texts."""
    rows = docs.select(F.col("doc_id").cast("long"), word_count(text_of()).alias("n_tokens"))
    return pack(materialize(rows), budget, buckets)


def pack_rows(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """docs, whole, with n_tokens, bucket, bound, batch, slot and padding; a column of docs with such a name gives way to ours.

    Rows travel whole, once, to their place in the order, so that no join on ids is needed and equal ids stay apart.
    """
    rows = docs.select(F.col("doc_id").cast("long"), word_count(text_of()).alias("n_tokens"), F.struct(*docs.columns).alias("_row"))
    made = ("n_tokens", "bucket", "bound", "batch", "slot", "padding")
    return pack(materialize(rows), budget, buckets).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in made), *made)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents in batches."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
