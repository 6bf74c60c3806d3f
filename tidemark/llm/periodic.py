"""Periodic runs of words by the runs theorem, and texts with their repetitions collapsed.

A run is a longest stretch of words with a smallest period p that it holds at least twice. By the runs theorem each run
has a root that is the longest Lyndon word at its start, under the order of words or under its reverse. With the inverse
suffix array, that word ends where the next smaller value stands (next greater, for the reverse order), which gives two
candidates a word. A candidate (i, p) is extended to the right by the longest common prefix of the suffixes i and i + p, and
to the left by that of the reversed text: minima of ranges of the LCP array. Extended to two periods it is a run.

All texts of a block share one suffix array, ordered by text first, so that nothing is compared across texts. It is made by
prefix doubling over the groups still tied; a boundary that doubling opens gets its LCP from the boundaries opened before.
Range minima go through the levels of a sparse table one level at a time, so memory is linear in the words of a block.

Defined results: a null, empty or wordless text has no words and no runs; repeated rows and rows without an id are
documents of their own; empty tables give an empty result; texts of any length are searched whole, in one task each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordids
from tidemark.llm.columns import text_of, word_array
from tidemark.llm.session import small_batches

#: Words that a run has at least, and periods.
LEAST_WORDS, LEAST_PERIODS = 12, 2
_OPEN = np.int64(1) << 62


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, for many ranges at once; a sparse table of which one level is held at a time."""
    out = np.empty(len(low), np.int64)
    if not len(low):
        return out
    level = (np.frexp((high - low + 1).astype(np.float64))[1] - 1).astype(np.int8)
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    table = values
    for k in range(int(level.max()) + 1):
        asked = order[ends[k] : ends[k + 1]]
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k) + 1])
        if k < level.max():
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the next place with a smaller value, or the length; values are not negative. Climbs and descends a tree of minima."""
    tree = [np.append(values, -1)]
    while len(tree[-1]) > 1:
        if len(tree[-1]) % 2:
            tree[-1] = np.append(tree[-1], _OPEN)
        tree.append(np.minimum(tree[-1][0::2], tree[-1][1::2]))
    at = np.arange(len(values))
    node, found = at, []
    for minima in tree[:-1]:
        beside = np.minimum(node + 1, len(minima) - 1)
        hit = (node % 2 == 0) & (minima[beside] < values[at])
        found.append((at[hit], beside[hit]))
        at, node = at[~hit], node[~hit] >> 1
    who = node = np.zeros(0, np.int64)
    for minima, (more, there) in zip(tree[-2::-1], found[::-1], strict=True):
        node = 2 * node
        node = np.append(np.where(minima[node] < values[who], node, node + 1) if len(who) else node, there)
        who = np.append(who, more)
    out = np.empty(len(values), np.int64)
    out[who] = node
    return out


class Suffixes:
    """Ranks of the suffixes of several texts, by text and then by words (an ended suffix is the least), and the LCP of neighbours."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][text]
        key = text * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        opens = np.ones(n, bool)
        opens[1:] = key[order][1:] != key[order][:-1]
        self.lcp = np.where(opens, 0, _OPEN)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        size = 1
        while True:
            tied = ~opens
            tied[:-1] |= ~opens[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return
            here = order[at]
            after = np.where(here + size < self.end[here], self.rank[np.minimum(here + size, n - 1)], -1)
            by = np.argsort(self.rank[here] * (n + 1) + after + 1, kind="stable")
            here, after = here[by], after[by]
            order[at] = here
            group = self.rank[here]
            split = np.flatnonzero((group[1:] == group[:-1]) & (after[1:] != after[:-1])) + 1
            low, high = after[split - 1], after[split]
            common = np.full(len(split), size, np.int64)
            goes = low >= 0
            common[goes] += range_minima(self.lcp, low[goes] + 1, high[goes])
            self.lcp[at[split]] = common
            opens[at[split]] = True
            self.rank[here] = np.maximum.accumulate(np.where(opens[at], at, 0))
            size *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes a and b, other places of one text each, have in common at their starts; b may be its end."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero(b < self.end[a])
        x, y = self.rank[a[inside]], self.rank[b[inside]]
        out[inside] = range_minima(self.lcp, np.minimum(x, y) + 1, np.maximum(x, y))
        return out


def _steps(ids: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, by: int, most: int) -> np.ndarray:
    """How many words in a row agree from a and b on, going by 1 or -1 inside [low, high), up to ``most``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(most):
        x, y = a[live] + by * k, b[live] + by * k
        live = live[(x >= low[live]) & (y < high[live])]
        live = live[ids[a[live] + by * k] == ids[b[live] + by * k]]
        out[live] += 1
    return out


def periodic_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``least`` words and two periods in texts of word ids, by start and then period; text k
    is ids[first[k]:first[k + 1]], and end is the word after the last."""
    n = len(ids)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    ahead = Suffixes(ids, first)
    begin = np.repeat(first[:-1], np.diff(first))
    up, down = np.minimum(next_smaller(ahead.rank), ahead.end), next_smaller(n - 1 - ahead.rank)
    i = np.concatenate((np.arange(n), np.flatnonzero(down < ahead.end)))
    p = np.concatenate((up, down[down < ahead.end])) - i
    # what a run needs beyond one period, of which half the least length at least shows in single steps
    need = np.maximum(p, least - p)
    low, high, few = begin[i], ahead.end[i], (least + 1) // 2
    good = _steps(ids, i, i + p, low, high, 1, few) + _steps(ids, i - 1, i + p - 1, low, high, -1, few) >= few
    i, p, need = i[good], p[good], need[good]
    right = ahead.common(i, i + p)
    # to the left, in the reversed texts of those that are left
    texts = np.unique(np.searchsorted(first, i, side="right") - 1)
    lengths = first[texts + 1] - first[texts]
    turned = np.concatenate(([0], np.cumsum(lengths)))
    back = np.repeat(first[texts + 1] - 1 + turned[:-1], lengths) - np.arange(turned[-1])
    behind = Suffixes(ids[back], turned)
    of = np.searchsorted(texts, np.searchsorted(first, i, side="right") - 1)
    mirror = first[texts + 1][of] - 1 + turned[:-1][of] if len(i) else i
    left = behind.common(mirror - (i + p - 1), mirror - (i - 1)) if len(i) else right
    whole = left + right >= need
    start, end, p = (i - left)[whole], (i + p + right)[whole], p[whole]
    _, once = np.unique(start * (n + 1) + p, return_index=True)
    return start[once], end[once], p[once]


RUNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the columns RUNS of each row's text: its runs, the longest of them, and its words without those that only repeat.

    ``collapsed`` is the kept words joined by one space; a word goes if a run holds it after the run's first period.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, block in wordids.blocks(b.column(1)):
                start, end, period = periodic_runs(block.ids, block.first, least)
                again = np.zeros(len(block.ids) + 1, np.int64)
                np.add.at(again, start + period, 1)
                np.add.at(again, end, -1)
                kept = np.cumsum(again)[:-1] == 0
                of = np.searchsorted(start, block.first)  # runs of each text
                out: list[list] = [[] for _ in range(9)]
                for k in range(high - low):
                    s, e, base = int(of[k]), int(of[k + 1]), int(block.first[k])
                    found = list(zip((start[s:e] - base).tolist(), (end[s:e] - start[s:e]).tolist(), period[s:e].tolist(), strict=True))
                    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
                    words = base + np.flatnonzero(kept[base : int(block.first[k + 1])])
                    text = b" ".join([block.raw[x:y] for x, y in zip(block.starts[words].tolist(), block.ends[words].tolist(), strict=True)])
                    listed = "".join(f"{x},{y},{z}\n" for x, y, z in found)
                    values = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [{"start": x, "length": y, "period": z} for x, y, z in found], text.decode())
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [kind, pa.string()]
                columns = [b.column(0).slice(low, high - low), pa.array(block.counts), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(c.split(" ")[0] for c in RUNS.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, f"doc_id long, {RUNS}")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every tenth document, by a hash of its id, made periodic from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("_g"))
    chosen = chosen.withColumn("_w", F.when(F.col("_g").isNotNull(), word_array(F.col("text")))).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.expr("cast(_g % _n as int)"))).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    again = F.expr("concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, _n - _a))")
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: runs and collapsed text of all documents, some made periodic."""
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
