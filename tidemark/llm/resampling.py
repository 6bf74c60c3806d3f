"""Target-distribution importance resampling over hashed n-grams, counted and scored through suffix arrays of word ids.

Texts of a partition are taken in blocks. A block's words become ids, its suffixes (cut at the longest n-gram, and at the
end of each text) are sorted, and neighbours that share their first n words form a run: one repeated n-gram. Each run is
spelt out and hashed once, and its bucket scattered back to all its occurrences. Counting adds the buckets of a task into
one array, so a task sends one row a bucket however often a word occurs; scoring sums gains of buckets per text.

A document's weight is the sum over its features of floor(1000 ln(target share / corpus share)) of their buckets, both
shares with one added to each bucket. Adding Gumbel noise from a hash of the id and taking the highest scores draws
without replacement, in proportion to the weights' exponentials; the order is global without a single task.

Defined results: a null, empty or wordless text has no features and weight 0; a null doc_id is hashed as an empty id and
comes last among ties; rows of one doc_id are documents of their own, ties between them by n_features; empty tables give
an empty result (an empty target leaves gains to the corpus alone); texts of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordids
from tidemark.llm.columns import positions
from tidemark.llm.session import materialize, small_batches

#: What stands between words, after A-Z became a-z: ASCII but digits and letters.
BETWEEN = wordids.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
BUCKETS = 10_000
LONGEST = 1
#: Words that a document must have to be drawn, per cent of these that are drawn, and the seed of the noise.
LEAST_WORDS, SHARE, SEED = 20, 10, 2024
#: Bytes of text that share a suffix array; a longer text has one alone.
BLOCK_BYTES = 4 << 20


def runs(block: wordids.Block, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``longest``: (first word, bucket) of every occurrence of every n-gram inside a text."""
    n = len(block.ids)
    left = block.first[1:][block.text_of] - np.arange(n)  # words to the end of the text
    ahead = [np.where(left > k, np.append(block.ids[k:], np.zeros(min(k, n), np.int64)), -1) for k in range(longest)]
    order = np.lexsort(ahead[::-1]) if longest > 1 else np.argsort(block.ids, kind="stable")
    same = np.ones(max(0, n - 1), bool)
    for k in range(longest):
        column = ahead[k][order]
        same &= column[1:] == column[:-1]
        whole = column >= 0
        head = whole.copy()
        head[1:] &= ~same
        at = order[whole]
        run = np.cumsum(head[whole]) - 1
        named = np.array([zlib.crc32(block.said(i, i + k + 1)) % buckets for i in order[head].tolist()], np.int64)
        yield at, named[run] if len(at) else named


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, block in wordids.blocks(b.column(0), BETWEEN, True, BLOCK_BYTES):
                for _, bucket in runs(block, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket's smoothed shares in target and corpus."""
    corpus_all, target_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * corpus_all / ((s + 1) * target_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, block in wordids.blocks(b.column(1), BETWEEN, True, BLOCK_BYTES):
                features, weight = (np.zeros(high - low, np.int64) for _ in range(2))
                for at, bucket in runs(block, longest, len(gain)):
                    sums = np.zeros(len(block.ids) + 1, np.int64)
                    worth, counted = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), np.int64)
                    worth[at], counted[at] = gain[bucket], 1
                    for into, values in ((weight, worth), (features, counted)):
                        np.cumsum(values, out=sums[1:])
                        into += sums[block.first[1:]] - sums[block.first[:-1]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(block.counts), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document; rank is null for those that are not drawn."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = weigh(docs, gain, longest).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    scored = materialize(scored.withColumn("_few", F.col("n_words") < least_words))
    placed = positions(scored, F.col("_few"), -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features"))
    drawn = share * scored.where("not _few").count() // 100
    return placed.withColumn("rank", F.when(F.col("_pos") < drawn, F.col("_pos") + 1)).drop("_few", "_pos")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: weight, score and rank of all documents against the benchmark's distribution."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
