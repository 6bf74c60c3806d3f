"""Substring dedup by level-wise doubling: short windows first, and only those that repeat are looked at twice as long.

Levels run from a start length (5 words) by doubling to the wanted length (20 words). At the first level each document
offers, of every stretch of start positions that one wanted window covers, the short window of least hash: equal wanted
windows then offer equal short windows, so a wanted window can only repeat where its offered one does. At each further
level only windows around a repeated shorter one are hashed, at twice its length, inside the wanted window. At the last
level the wanted windows left are grouped by a 128-bit hash, and the least document of each is its first place.

Each level is one grouping by hash. A document sends each hash once, and gets back the hashes that it alone has (or, at
the last level, has first); no join runs on a hash, so a passage that a third of all documents share makes no hot key:
its counts and minima combine before the shuffle. Documents of a level come from one exchange of the texts by doc_id.

Defined results: a null or wordless text has no words and keeps the empty text; rows of one doc_id are rows of one
document, and remove nothing from each other; a null doc_id counts as the largest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.session import materialize, small_batches

WINDOW = 20
#: Length of the first level's windows; the wanted length is this times a power of two.
START = 5

#: Keys from here on stand for rows without a doc_id, each its own; ids below are taken as they are.
UNNAMED = 1 << 62
_U = np.uint64


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least (the first of equals) of each ``width`` consecutive values."""
    at, have, out, taken = np.arange(len(values)), 1, None, 0
    while width:
        if width & 1:
            if out is None:
                out, taken = at, have
            else:
                m = min(len(out), len(at) - taken)
                left, right = out[:m], at[taken : taken + m]
                out, taken = np.where(values[left] <= values[right], left, right), taken + have
        width >>= 1
        if width:
            left, right = at[: len(at) - have], at[have:]
            at, have = np.where(values[left] <= values[right], left, right), have * 2
    return out


def _firsts(text_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct (text, hash), for each entry the first's index), entries in order of place."""
    order = np.lexsort((np.arange(len(hashes)), hashes, text_of))
    t, h = text_of[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = order[new][np.cumsum(new) - 1]
    return order[new], of


class Known:
    """For each text of a chunk, the hashes that it alone has at a level; asked in bulk."""

    def __init__(self, lists: pa.Array, low: int, high: int):
        part = lists.slice(low, high - low)
        part = pa.concat_arrays([part.fill_null(pa.scalar([], part.type))]) if part.null_count else pa.concat_arrays([part])
        lengths = np.diff(part.offsets.to_numpy())
        values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
        self.keys = np.sort(words.mix(values ^ words.mix(np.repeat(np.arange(high - low), lengths).astype(_U))))

    def __call__(self, text_of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        keys = words.mix(hashes ^ words.mix(text_of.astype(_U)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys


class Levels:
    """What a chunk of texts has at each level. ``alone[k]``: the hashes that a text alone has at level k."""

    def __init__(self, part: words.Chunk, window: int, start: int):
        self.window, self.sizes = window, [start << k for k in range((window // start).bit_length())]
        if self.sizes[-1] != window:
            raise ValueError("window must be start times a power of two")
        self.words = part.hashes()
        n = len(self.words)
        last = part.first[1:][part.text_of] if n else np.zeros(0, np.int64)  # word after each word's text
        self.begin = np.flatnonzero(np.arange(n) + window <= last)
        self.text_of = part.text_of[self.begin]
        self.place = np.zeros(len(self.begin), np.int64)
        if len(self.begin):
            least = _sliding_least(words.windows(self.words, start), window - start + 1)
            self.place = least[self.begin]  # where each wanted window's offered short window starts
        self.open = np.ones(len(self.begin), bool)

    def at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of level k's windows that open wanted windows ask for."""
        place, begin = self.place[self.open], self.begin[self.open]
        size = self.sizes[k]
        if k:  # grow to the right while inside the wanted window, else to the left
            place = np.where(place + size <= begin + self.window, place, begin + self.window - size)
        return place, self.text_of[self.open]

    def offer(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of level k, each once."""
        place, text = self.at(k)
        if not len(place):
            return text, np.zeros(0, _U)
        hashes = words.windows(self.words, self.sizes[k])[place]
        first, _ = _firsts(text, hashes)
        return text[first], hashes[first]

    def close(self, k: int, alone: Known) -> None:
        """Leaves open the wanted windows whose level-k window repeats, in another document or in this one at another place."""
        place, text = self.at(k)
        if not len(place):
            return
        hashes = words.windows(self.words, self.sizes[k])[place]
        first, of = _firsts(text, hashes)
        lowest, highest = place.copy(), place.copy()
        np.minimum.at(lowest, of, place)
        np.maximum.at(highest, of, place)
        again = (lowest < highest)[of]
        self.open[np.flatnonzero(self.open)] = again | ~alone(text, hashes)


def _lists(rows: DataFrame, value: str, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_key")).agg(F.collect_list(value).alias(f"_{value}"))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def covered(docs: DataFrame, window: int = WINDOW, start: int = START, carried: Sequence[str] = ()) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple[int, words.Chunk, np.ndarray]]]]:
    """(rows, reader). rows has _key, _text, _rest (the carried columns) and level results of every row; reader yields (row, words of a chunk, removed words) of its batches."""
    key: Column = F.col("doc_id").cast("long")
    unnamed = not docs.where(key.isNull()).isEmpty()
    if unnamed:
        key = F.coalesce(key, F.monotonically_increasing_id() + UNNAMED)
    slim = docs.select(key.alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in carried) or (F.lit(0),)).alias("_rest"))
    if unnamed:  # texts are read once for each level; a row's number must not change between them
        slim = materialize(slim)
    levels = (window // start).bit_length()
    small_batches(docs.sparkSession)
    dealt = slim.repartition("_key")
    rows = slim

    def opened(b: pa.RecordBatch, upto: int) -> Iterator[tuple[int, int, words.Chunk, Levels]]:
        for low, high, part in words.chunks(b.column(1)):
            found = Levels(part, window, start)
            for k in range(upto):
                found.close(k, Known(b.column(3 + k), low, high))
            yield low, high, part, found

    def offers(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                for low, _, _, found in opened(b, k):
                    text, hashes = found.offer(k)
                    yield pa.RecordBatch.from_arrays([_long(hashes), pa.array(keys[low + text])], names=["h", "key"])

        return run

    for k in range(levels - 1):
        sent = rows.mapInArrow(offers(k), "h long, key long")
        once = sent.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key")).where("n = 1")
        alone = _lists(once.withColumnRenamed("h", f"h{k}"), f"h{k}", "key")
        rows = (dealt if k == 0 else rows).join(alone, "_key", "left")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for low, _, _, found in opened(b, levels - 1):
                place, text = found.at(levels - 1)
                one, two = (words.windows(found.words, window, seed)[place] if len(place) else np.zeros(0, _U) for seed in (0, 1))
                first, _ = _firsts(text, one)
                yield pa.RecordBatch.from_arrays([_long(one[first]), _long(two[first]), pa.array(keys[low + text[first]])], names=["h", "g", "key"])

    sent = rows.mapInArrow(last, "h long, g long, key long")
    first = sent.groupBy("h", "g").agg(F.min("key").alias("key")).withColumnRenamed("h", "first")
    rows = rows.join(_lists(first, "first", "key"), "_key", "left")

    def reader(b: pa.RecordBatch) -> Iterator[tuple[int, words.Chunk, np.ndarray]]:
        for low, _, part, found in opened(b, levels - 1):
            place, text = found.at(levels - 1)
            removed = np.zeros(len(part.starts) + 1, np.int64)
            if len(place):
                hashes = words.windows(found.words, window)[place]
                first, of = _firsts(text, hashes)
                gone = place[(of != np.arange(len(of))) | ~Known(b.column(2 + levels), low, low + len(part.counts))(text, hashes)]
                np.add.at(removed, gone, 1)
                np.add.at(removed, gone + window, -1)
            yield low, part, np.cumsum(removed)[:-1] > 0

    return rows, reader


def remove_repeats(docs: DataFrame, window: int = WINDOW, start: int = START, carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text, rest) per row; text is what is left, with its own white space between words that stay.

    White space before a removed word goes with it. A row that loses nothing keeps its text as it is. rest is a struct of
    the carried columns.
    """
    rows, reader = covered(docs, window, start, carried)
    kind = rows.schema["_rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, part, gone in reader(b):
                raw, line, digests, removed, texts = part.data.tobytes(), ~gone, [], [], []
                for k in range(len(part.counts)):
                    s, e = int(part.first[k]), int(part.first[k + 1])
                    kept = s + np.flatnonzero(line[s:e])
                    starts, ends = part.starts[kept].tolist(), part.ends[kept].tolist()
                    digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts, ends, strict=True)])).hexdigest())
                    removed.append(e - s - len(kept))
                    if removed[-1]:
                        # each kept word with the white space before it
                        before = np.where(kept > s, part.ends[kept - 1], part.offsets[k]) if len(kept) else kept
                        texts.append(b"".join([raw[x:y] for x, y in zip(before.tolist(), ends, strict=True)]).decode().lstrip(" \t\n\x0b\x0c\r"))
                    else:
                        texts.append(raw[part.offsets[k] : part.offsets[k + 1]].decode())
                n = len(part.counts)
                columns = [b.column(0).slice(low, n), pa.array(part.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), b.column(2).slice(low, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "rest"])

    out = rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, text string, rest {kind}")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < UNNAMED, F.col("doc_id")))


def deduplicate(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """docs with repeats cut out of their texts; rows that had words and lose all of them go. n_chars, if there, follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, window, start, others).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    rest = {c: F.col(f"rest.`{c}`") for c in others}
    if "n_chars" in rest:
        rest["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(rest["n_chars"])
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), **rest}
    return found.select(*(made[c].alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: words removed from each of all documents, and the digest of the rest."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
