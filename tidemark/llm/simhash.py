"""SimHash near-dedup: 64-bit fingerprints, joined within a Hamming radius through vantage-point trees.

A pair within ``radius`` bits differs in at most ``radius // blocks`` bits of at least one of ``blocks`` equal blocks of
the fingerprint. Each block has a vantage-point tree: a node holds a vantage point and a median distance m (both taken
from a bounded sample), fingerprints at block distance <= m go left, the others right. By the triangle inequality a
fingerprint at distance d can have partners on the left only if d - r <= m and on the right only if d + r > m, so it is
stored in one leaf (its shard) and also sent, as a query, to each leaf whose bounds its ball of radius r crosses. All
fingerprints are routed; only the tree's shape comes from the sample. Inside a shard the same splitting goes on until few
are left, which are compared outright. A shard reports a spanning forest of the links that it finds, not every pair.

Defined results: a null or wordless text has fingerprint zero; rows of one doc_id are rows of one document; a null doc_id
takes part, and sorts after all others; an empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import shingles, words
from tidemark.llm.session import connected_components, forest, materialize, small_batches
from tidemark.llm.shingles import NULL_ID

SEED = 42
#: Fingerprints that the trees are shaped on: SAMPLE at least, and one in SHARE of more than SAMPLE * SHARE, so that shards
#: stay as large as they are (12 million fingerprints, 100 MB, reach the driver of 10**11 distinct ones; so for each word).
SAMPLE, SHARE = 32_768, 8_192
#: Wanted fingerprints per shard.
LEAF = 512
#: Fewest sampled fingerprints that a leaf is cut at.
LEAF_SAMPLE = 8
#: Rows compared at once inside a shard.
TILE = 512
_U = np.uint64


def fingerprint_texts(column: pa.Array | pa.ChunkedArray, shingle: int = 3) -> np.ndarray:
    """Signed 64-bit SimHash of each text, from XXH64 of its word shingles, repeats included."""
    out = []
    for low, high, part in words.chunks(column):
        raw = part.data.copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        spans = part.ends - part.starts
        # words of the chunk, one space after each: a shingle is then one slice
        at = np.concatenate(([0], np.cumsum(spans + 1)))
        line = np.full(int(at[-1]), 32, np.uint8)
        keep = ~words.WHITE[raw]
        line[np.arange(keep.sum()) + np.repeat(np.arange(len(spans)), spans)] = raw[keep]
        line, first = line.tobytes(), part.first
        begin, close = at[:-1], at[1:] - 1
        hashes, sizes = [], []
        for k in range(high - low):
            a, b = int(first[k]), int(first[k + 1])
            n = min(b - a, 1) if b - a < shingle else b - a - shingle + 1
            sizes.append(n)
            if n:
                width = min(shingle, b - a)
                hashes += [xxh64_intdigest(line[s:e], SEED) for s, e in zip(begin[a : a + n].tolist(), close[a + width - 1 : a + width - 1 + n].tolist(), strict=True)]
        sizes = np.array(sizes)
        prints = np.zeros(high - low, _U)
        if hashes:
            full = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[full])))
            bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                ones = np.zeros(64, np.int64)
                for x in range(s, e, 1 << 15):
                    ones += np.unpackbits(bits[x : min(e, x + (1 << 15))], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                prints[full[k]] = np.packbits(2 * ones > e - s, bitorder="little").view("<u8")[0]
        out.append(prints)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_texts(b.column(1), shingle))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A vantage-point tree over one block of bits. Arrays of nodes; a negative child -1-k is leaf k."""

    def __init__(self, mask: int, radius: int, sample: np.ndarray, leaf_sample: int):
        self.mask, self.radius = _U(mask), radius
        self.point, self.split, self.left, self.right, self.leaves = [], [], [], [], 0
        self.root = self._grow(sample & self.mask, leaf_sample)
        # arrays, since the trees go to the tasks and Python pickles each numpy scalar of a list with its type
        self.point, (self.split, self.left, self.right) = np.array(self.point, _U), (np.array(x, np.int64) for x in (self.split, self.left, self.right))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, part: np.ndarray, leaf_sample: int) -> int:
        if len(part) < 2 * leaf_sample:
            return self._leaf()
        point, best = vantage(part)
        if best is None:
            return self._leaf()
        d = np.bitwise_count(part ^ point)
        k = len(self.point)
        self.point.append(point), self.split.append(best), self.left.append(0), self.right.append(0)
        self.left[k] = self._grow(part[d <= best], leaf_sample)
        self.right[k] = self._grow(part[d > best], leaf_sample)
        return k

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's own) for each leaf that a ball around a fingerprint reaches."""
        rows, leaves, homes = [], [], []
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at), leaves.append(np.full(len(at), -1 - node)), homes.append(home)
                continue
            d = np.bitwise_count((prints[at] & self.mask) ^ self.point[node]).astype(np.int64)
            m, r = self.split[node], self.radius
            left, right = d - r <= m, d + r > m
            todo += [(self.left[node], at[left], (home & (d <= m))[left]), (self.right[node], at[right], (home & (d > m))[right])]
        return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((rows, np.int64), (leaves, np.int64), (homes, bool)))


def vantage(part: np.ndarray) -> tuple[np.uint64, int | None]:
    """A vantage point of ``part`` and the distance that halves it best; None if no distance splits it."""
    best = (0.0, part[0], None)
    for point in part[np.linspace(0, len(part) - 1, 5).astype(int)]:
        counts = np.cumsum(np.bincount(np.bitwise_count(part ^ point), minlength=65))
        share = np.minimum(counts, len(part) - counts) / len(part)
        m = int(share.argmax())
        if share[m] > best[0]:
            best = (share[m], point, m)
    return (best[1], best[2]) if best[0] >= 0.05 else (best[1], None)


def grow_trees(sample: np.ndarray, total: int, radius: int, blocks: int, leaf: int = LEAF) -> list[Tree]:
    width = 64 // blocks
    least = max(LEAF_SAMPLE, int(leaf * len(sample) / max(total, 1)))
    return [Tree(((1 << width) - 1) << (k * width), radius // blocks, sample, least) for k in range(blocks)]


def links(stored: np.ndarray, asked: np.ndarray, mask: np.uint64, ball: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (stored, asked) within ``radius`` bits, and within ``ball`` bits under ``mask``: further vantage-point splits, then tiles."""
    todo = [(np.arange(len(stored)), np.arange(len(asked)))]
    while todo:
        s, a = todo.pop()
        if not len(s) or not len(a):
            continue
        point, m = vantage(stored[s] & mask) if len(s) > 128 else (None, None)
        under, r = mask, ball
        if m is None and len(s) > 128:  # alike in this block: all bits, with the whole radius
            (point, m), under, r = vantage(stored[s]), ~_U(0), radius
        if m is None:
            for x in range(0, len(s), TILE):
                for y in range(0, len(a), TILE):
                    i, j = np.nonzero(np.bitwise_count(stored[s[x : x + TILE], None] ^ asked[None, a[y : y + TILE]]) <= radius)
                    if len(i):
                        yield s[x + i], a[y + j]
            continue
        ds, da = (np.bitwise_count((v & under) ^ point).astype(np.int64) for v in (stored[s], asked[a]))
        todo += [(s[ds <= m], a[da - r <= m]), (s[ds > m], a[da + r > m])]


def word_edges(prints: DataFrame, words: int, radius: int = 3, blocks: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (word, a, b) over distinct (word int, fp long), word from 0 to words - 1: within a word, the components are those of
    all links within ``radius`` bits. All words' trees are searched by one plan."""
    totals = dict(prints.groupBy("word").count().collect())
    total = max(totals.values(), default=0)
    sample = max(sample, total // SHARE)
    share = min(1.0, sample / max(total, 1))
    picked = prints.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("word", "fp").toArrow()
    of, found = (picked[c].to_numpy().astype(np.int64) for c in ("word", "fp"))
    trees = []
    for k in range(words):
        order = np.sort(found[of == k]).view(_U)
        trees += grow_trees(np.random.default_rng(7).permutation(order), totals.get(k, 0), radius, blocks, leaf)
    bases = np.cumsum([0, *(t.leaves for t in trees)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, every = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for k, tree in enumerate(trees):
                prints = every[of == k // blocks]
                rows, leaves, homes = tree.route(prints.view(_U))
                yield pa.RecordBatch.from_arrays([pa.array(leaves + bases[k]), pa.array(prints[rows]), pa.array(homes)], names=["shard", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        none = pa.table({"word": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if shard.num_rows < 2:
            return none
        k = int(np.searchsorted(bases, shard["shard"][0].as_py(), side="right")) - 1
        tree = trees[k]
        prints = shard["fp"].to_numpy()
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        at = np.flatnonzero(shard["home"].to_numpy(zero_copy_only=False)[order])
        bits = prints.view(_U)
        root = forest(len(bits), ((at[i], j) for i, j in links(bits[at], bits, tree.mask, tree.radius, radius)))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"word": np.full(len(linked), k // blocks, np.int32), "a": prints[root[linked]], "b": prints[linked]}) if len(linked) else none

    routed = prints.select("word", "fp").mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(search, "word int, a long, b long")


def near_edges(distinct: DataFrame, radius: int = 3, blocks: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all links within ``radius`` bits."""
    return word_edges(distinct.select(F.lit(0).alias("word"), "fp"), 1, radius, blocks, sample, leaf).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fp long, root long, component_id long): root names the component, component_id is its least doc_id."""
    prints = materialize(fingerprints(docs, shingle))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_edges(classes, radius, blocks, sample, leaf))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    members = placed.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "root", "component_id")


def one_row(rows: DataFrame, *keys: str) -> DataFrame:
    """``_row`` of one row for each value of keys: of several the one of least hash, whichever task sees it first."""
    return rows.groupBy(*keys).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of texts whose five-word shingles are alike to 0.8 or more, whole: the one of least doc_id
    (null last), of several the one of least hash. The trees bring texts together, their sets are compared, and what lies beyond
    the trees' radius is found by shared shingles (see ``shingles``)."""
    return one_row(shingles.kept_rows(docs, word_edges), "_key", "_cls")


def deduplicate_within(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of docs for each component, whole: the one of least doc_id (null last), of several the one of least hash."""

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    found = near_duplicates(docs, shingle, radius)
    kept = found.groupBy("root").agg(F.min(F.struct(key.alias("_key"), F.col("fp").alias("_fp"))).alias("k")).select("k._key", "k._fp")
    # the row goes as one column, so that no column of docs can clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col("text").cast("string").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprint_texts(b.column(2), shingle))], names=["_row", "_key", "_fp"])

    tagged = rows.mapInArrow(tag, f"_row {kind}, _key long, _fp long")
    return one_row(tagged.join(kept, ["_key", "_fp"], "left_semi"), "_key", "_fp")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprints of all documents and their components."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
