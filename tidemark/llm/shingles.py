"""Near-copies by shared shingles: texts whose sets of five-word shingles have Jaccard similarity SIMILARITY or more.

The SimHash operator searches first: every text class (equal sets) has a signature of SIGNATURE words, each a SimHash of its set,
and all classes go through the vantage-point trees of each word. What they bring together is checked against the sets.
Trees of a bearable radius do not reach all pairs of that similarity (see README), so the rest is found by keys: all
pairs, none missed but by chance of hashes (see FAR). Shingles have one global order, those known to be common last. Two sets that
are similar enough share one of the first n - ceil(0.8 n) + 1 shingles of either (its keys), and those are rare ones, so that
a passage that a third of all texts share brings nobody together.

1. Trees: classes that a word's trees bring together are compared, set with set (``tree_pairs``).
2. Every class goes once, with its set, to the most shared of its keys, in blocks of BLOCK. Inside a block
   components are found outright: a pivot is compared with all that are unassigned, those that it links are pivots in turn,
   and distances to the first pivot rule pairs out by the triangle inequality (Jaccard distance is a metric).
3. Keys whose classes still lie apart link one class of each component with the key's head.
4. What then still shares a key from different components, and did not meet in a block, is compared: pair by pair where the
   key has few classes, else by sending what lies beside the key's main component to those blocks of the others that hold a
   class which sizes and signatures allow.
Listed pairs whose sizes or SimHash signatures (256 bits) rule the similarity out are dropped before sets are fetched.

Defined results: letters A-Z are lower-cased; a text of fewer than five words is one shingle; wordless texts are copies of
each other; rows of one doc_id are rows of one document; a null doc_id sorts after all others; an empty table gives an
empty result. Sets hold 32-bit hashes, so a similarity is off by the share of shingles that collide: 1 in 10**5 for a text of
10**5 words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.session import Steps, connected_components, materialize, release, small_batches

SHINGLE, SEED = 5, 17
#: Similarity from which texts link, as a fraction.
UP, DOWN = 4, 5
#: Most common shingles that are known as such: a bound on what reaches the driver and the tasks (1 MB).
COMMON = 1 << 16
#: 64-bit words of a SimHash signature, and the bits at which it rules a pair out: at the least similarity two signatures differ in
#: 39 of 256 bits with a deviation of 5.7, so a pair is lost with a probability of 1 in 10**9.
SIGNATURE, FAR = 4, 73
#: Classes compared in one block.
BLOCK = 1_024
#: Classes of a key up to which its pairs are listed; those of larger keys meet in their blocks.
PAIRED = 64
#: Classes of a larger key on either side of a cell, compared by their signatures; and guests of a cell that are compared at once.
CELL, TILE = 4_096, 256
#: Pairs whose sets are fetched at once: 2 GB on the way, for texts of 250 words.
ROUND = 1 << 20
#: Stands for a null doc_id where ids are ordered.
NULL_ID = (1 << 63) - 1

#: Edges (word, a, b) over distinct fingerprints (word, fp) of so many words: within a word, the components are those of all links
#: within the operator's radius.
Search = Callable[[DataFrame, int], DataFrame]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, bounds) of a few texts at a time: the distinct shingles of text k are hashes[bounds[k]:bounds[k + 1]]."""
    for low, high, part in words.chunks(column):
        part = words.Chunk(_LOWER[part.data], part.offsets)
        hashes = part.hashes()
        found = words.windows(hashes, SHINGLE, SEED)
        inside = np.flatnonzero(part.text_of[: len(found)] == part.text_of[SHINGLE - 1 :][: len(found)])
        grams, at = [found[inside]], [part.text_of[inside]]
        for n in range(1, SHINGLE):
            short = np.flatnonzero(part.counts == n)
            if len(short):
                grams.append(words.windows(hashes, n, SEED)[part.first[short]]), at.append(short)
        grams, at = np.concatenate(grams), np.concatenate(at)
        order = np.lexsort((grams, at))
        grams, at = grams[order], at[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
        grams, at = grams[new], at[new]
        yield grams, np.searchsorted(at, np.arange(high - low + 1))


def class_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each text's set; 0 for no shingles."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(grams, 3), dtype=np.uint64)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """The COMMON shingles that most texts have, commonest first, as far as several texts of one batch have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [grams for grams, _ in shingle_sets(b.column(0))]
            grams, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often])], names=["gram", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()["gram"].to_numpy().astype(np.int64).view(np.uint64)


def first_keys(grams: np.ndarray, bounds: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[pa.ListArray, np.ndarray]:
    """(keys of each text, its number of shingles). common: sorted hashes and the place of each among the commonest."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.zeros(len(grams), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], grams), len(common[0]) - 1)
        place = np.where(common[0][at] == grams, COMMON - common[1][at], 0)
    order = np.lexsort((grams, place, text))
    rank = np.arange(len(grams)) - np.repeat(bounds[:-1], sizes)
    take = rank < np.repeat(sizes - (UP * sizes + DOWN - 1) // DOWN + 1, sizes)
    kept = np.bincount(text[take], minlength=len(sizes))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), pa.array(grams[order][take].view(np.int64))), sizes


def _join(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def classes_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return _join([pa.array(class_of(*x)) for x in shingle_sets(column)], pa.int64())


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each text's set, as SIGNATURE signed words of 64 bits: a bit is 1 if it is in over half the shingles' hashes."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), SIGNATURE), np.int64)
    for k in range(SIGNATURE if len(full) else 0):
        ones = np.unpackbits(words.mix(grams, 11 + k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(ones, bounds[full], axis=0, dtype=np.int32)
        out[full, k] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_key"), F.col("text").cast("string").alias("_text"))


def text_classes(docs: DataFrame) -> DataFrame:
    """(cls, least, size, sig, keys) of each distinct shingle set: its hash, least doc_id, size, signature and keys."""
    found = common_shingles(docs)
    order = np.argsort(found)
    common = found[order], order

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[pa.Array]] = [[], [], [], []]
            for x in shingle_sets(b.column(1)):
                keys, sizes = first_keys(*x, common)
                for part, new in zip(parts, (pa.array(class_of(*x)), pa.array(sizes), pa.FixedSizeListArray.from_arrays(pa.array(signatures(*x).ravel()), SIGNATURE).cast(pa.list_(pa.int64())), keys), strict=True):
                    part.append(new)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(_join, parts, kinds)], names=["_key", "cls", "size", "sig", "keys"])

    marked = _named(docs).mapInArrow(mark, "_key long, cls long, size long, sig array<long>, keys array<long>")
    return marked.groupBy("cls").agg(F.min("_key").alias("least"), *(F.first(c).alias(c) for c in ("size", "sig", "keys")))


def placed_sets(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """(cls, home, block, grams) of each placed class: its sorted 32-bit hashes. Sets of other classes are never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sets = [], []
            for grams, bounds in shingle_sets(b.column(1)):
                names.append(pa.array(class_of(grams, bounds)))
                sets += [np.unique((grams[s:e] >> np.uint64(32)).astype(np.uint32)).tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_join(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "grams"])

    rows = _named(docs).mapInArrow(run, "cls long, grams binary").join(homes.select("cls"), "cls", "left_semi")
    return rows.groupBy("cls").agg(F.first("grams").alias("grams")).join(homes, "cls").select("cls", "home", "block", "grams")


def alike(both: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of n and m shingles with ``both`` in common are similar enough."""
    return (UP + DOWN) * both >= UP * (n + m)


class Sets:
    """Sorted sets end to end, to be compared with one of them or with another."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.grams = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint32)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def shared(self, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of ``mine`` (not empty) each of the ``others`` (indices of sets, none empty) has."""
        wide = self.sizes[others]
        starts = np.concatenate(([0], np.cumsum(wide)[:-1]))
        values = self.grams[np.repeat(self.bounds[others] - starts, wide) + np.arange(wide.sum())]
        hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
        return np.add.reduceat(hit, starts, dtype=np.int64)

    def near(self, size: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose size allows the similarity to a set of ``size``."""
        sizes = self.sizes[others]
        return others[DOWN * np.minimum(sizes, size) >= UP * np.maximum(sizes, size)]


def block_links(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sorted sets, as (pivot, other)."""
    every = Sets(sets)
    sizes, left = every.sizes, np.flatnonzero(every.sizes)
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        far = np.zeros(len(sets))  # distance to the first pivot
        both = every.shared(sets[first], left)
        far[left] = 1 - both / (sizes[first] + sizes[left] - both)
        good = alike(both, sizes[first], sizes[left])
        todo = left[good].tolist()
        yield from ((first, k) for k in todo)
        left = left[~good]
        while todo and len(left):
            pivot = todo.pop()
            near = every.near(sizes[pivot], left[np.abs(far[left] - far[pivot]) <= 1 - UP / DOWN + 1e-9])
            if not len(near):
                continue
            found = near[alike(every.shared(sets[pivot], near), sizes[pivot], sizes[near])]
            yield from ((pivot, k) for k in found.tolist())
            todo += found.tolist()
            left = left[~np.isin(left, found)]


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets (cls, grams) are similar enough. Only sets of a pair leave their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                close = DOWN * min(len(x), len(y)) >= UP * max(len(x), len(y))
                good.append(bool(close and alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    small_batches(pairs.sparkSession)
    side = lambda c, grams: sets.select(F.col("cls").alias(c), F.col("grams").alias(grams)).join(pairs.select(c).distinct(), c, "left_semi")
    return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def compared(steps: Steps, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """``similar`` over a table of the pairs, in rounds of ROUND, so that sets on their way never fill the disk."""
    listed = steps.table(pairs, f"{name}-pairs")
    release(steps.spark)
    rounds = -(-listed.count() // ROUND)
    out = listed.limit(0)
    for k in range(rounds):
        part = listed if rounds == 1 else steps.table(listed.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k), f"{name}-round")
        out = out.unionAll(steps.table(similar(part, sets), name))
        release(steps.spark)
    return out


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, cls, n) of the keys that several classes share, n of them."""
    spread = classes.select(F.explode("keys").alias("key"), "cls")
    return spread.join(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def block_places(members: DataFrame) -> DataFrame:
    """(cls, home, block): each class's most shared key, and a block of that key's classes."""
    homes = members.groupBy("cls").agg(F.max(F.struct("n", F.xxhash64("key").alias("h"), "key")).alias("m"))
    return homes.select("cls", F.col("m.key").alias("home"), F.pmod(F.xxhash64("cls"), F.floor((F.col("m.n") - 1) / BLOCK) + 1).alias("block"))


def beyond_blocks(members: DataFrame, homes: DataFrame) -> DataFrame:
    """(key, cls) of the keys whose classes lie in several blocks."""
    place = F.struct("home", "block")
    placed = members.select("key", "cls").join(homes, "cls").select("key", place.alias("p"))
    wide = placed.groupBy("key").agg(F.min("p").alias("_a"), F.max("p").alias("_b")).where("_a <> _b").select("key")
    return members.select("key", "cls").join(wide, "key", "left_semi")


def settled(sets: DataFrame) -> DataFrame:
    """(a, b): the links found inside blocks of the placed sets."""

    def settle(block: pa.Table) -> pa.Table:
        block = block.sort_by("cls")
        names = block["cls"].to_numpy()
        pairs = np.array(list(block_links([np.frombuffer(x.as_buffer(), np.uint32) for x in block["grams"]])), np.int64).reshape(-1, 2)
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return sets.groupBy("home", "block").applyInArrow(settle, "a long, b long")


def still_apart(wide: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cls, root) of wide, for the keys whose classes lie in several components of the edges."""
    roots = connected_components(edges)
    now = wide.select("key", "cls").join(roots, wide["cls"] == roots["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
    return now.join(mixed, "key", "left_semi")


#: Columns of a class, as those of the other class of a pair.
_SIDE = ("cls", "home", "block", "size", "sig")


def _other(c: str) -> str:
    return f"{c}2"


def feasible(rows: DataFrame) -> DataFrame:
    """(a, b) of rows with two classes whose sizes and signatures allow the similarity."""
    apart = " + ".join(f"bit_count(sig[{k}] ^ sig2[{k}])" for k in range(SIGNATURE))
    sizes = f"{DOWN} * least(size, size2) >= {UP} * greatest(size, size2)"
    kept = rows.where(f"cls <> cls2 and {sizes} and {apart} <= {FAR}")
    return kept.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def plausible(rows: DataFrame) -> DataFrame:
    """``feasible`` pairs that did not meet in a block."""
    return feasible(rows.where("not (home = home2 and block = block2)"))


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b) with what is known of both classes, as ``plausible`` asks for it; facts: home, block, size and sig of each cls."""
    other = facts.select(*(F.col(c).alias(_other(c)) for c in _SIDE if c in facts.columns))
    return pairs.join(facts, pairs["a"] == facts["cls"]).join(other, pairs["b"] == other["cls2"])


def tree_pairs(steps: Steps, classes: DataFrame, search: Search) -> DataFrame:
    """(a, b): classes that the SimHash operator brings together by any word of their signatures, if sizes and signatures allow it.

    All words go through one search, so that the plan does not grow with their number.
    classes: cls, size and sig of every class.
    """
    prints = classes.select("cls", F.posexplode("sig").alias("word", "fp"))
    heads = steps.table(prints.groupBy("word", "fp").agg(F.min("cls").alias("head")), "prints")
    side = lambda c: heads.select("word", F.col("fp").alias(c), F.col("head").alias(f"_{c}"))
    near = search(heads.select("word", "fp"), SIGNATURE).join(side("a"), ["word", "a"]).join(side("b"), ["word", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = prints.join(heads, ["word", "fp"]).where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    return feasible(with_facts(near.unionAll(same).distinct(), classes))


def head_pairs(now: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): for each key, one class of each component with one class of the key."""
    chosen = now.groupBy("key", "root").agg(F.min(F.struct(F.xxhash64("cls", "key").alias("h"), "cls")).alias("m"))
    heads = chosen.groupBy("key").agg(F.min("m").alias("o"))
    pairs = chosen.join(heads, "key").where("m.cls <> o.cls").select(F.least("m.cls", "o.cls").alias("a"), F.greatest("m.cls", "o.cls").alias("b")).distinct()
    return plausible(with_facts(pairs, facts))


def key_mains(now: DataFrame) -> DataFrame:
    """(key, main, n, beside): the component that most classes of a key are in, the number of its classes, and how many lie beside it."""
    found = now.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("n"))
    return found.select("key", F.col("m.root").alias("main"), "n", (F.col("n") - F.col("m.count")).alias("beside"))


def rest_pairs(now: DataFrame, mains: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): all pairs of one key of up to PAIRED classes from different components that did not meet in a block."""
    few = now.join(mains.where(f"n <= {PAIRED}"), "key").join(facts, "cls")
    right = few.select("key", *(F.col(c).alias(_other(c)) for c in (*_SIDE, "root")))
    beside = few.where("root <> main").join(right, "key")  # what lies in the key's main component meets the others only
    return plausible(beside.where("root <> root2 and (root2 = main or cls < cls2)"))


def callers(now: DataFrame, mains: DataFrame, facts: DataFrame) -> DataFrame:
    """(home, block, cls, root, guest): who meets in which block, by keys of more than PAIRED classes: the guests, and the classes placed there.

    What lies beside a key's main component is compared with all classes of the key, in cells of CELL by CELL, by sizes and
    signatures alone: a class costs a cell some 100 bytes, its set stays where it is. Only what could be similar, lies in another
    component and has not met in a block calls on the other's block.
    """
    large = now.join(mains.where(f"n > {PAIRED}"), "key").join(facts, "cls")
    many = lambda c: F.ceil(F.col(c) / CELL)
    part = lambda c: F.pmod(F.xxhash64("cls", F.lit(c)), many(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), many(c) - 1))
    own = ("key", *_SIDE, "root")
    # side: 0 and 1 are hosts in and beside the key's main component, 2 a guest
    beside = F.col("root") != F.col("main")
    hosts = large.where("beside > 0").select(*own, beside.cast("int").alias("side"), part("n").alias("row"), each("beside").alias("column"))
    guests = large.where(beside).select(*own, F.lit(2).alias("side"), each("n").alias("row"), part("beside").alias("column"))

    def meet(cell: pa.Table) -> pa.Table:
        cls, root, home, block, size, side = (cell[c].to_numpy() for c in ("cls", "root", "home", "block", "size", "side"))
        sig = cell["sig"].combine_chunks().flatten().to_numpy().reshape(-1, SIGNATURE)
        _, first, place = np.unique(np.stack((home, block)), axis=1, return_index=True, return_inverse=True)
        place = place.reshape(-1)
        host, guest = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        called, at, to = np.zeros(len(host), bool), [], []
        for x in range(0, len(guest), TILE):
            g = guest[x : x + TILE, None]
            apart = np.zeros((len(g), len(host)), np.int16)
            for k in range(SIGNATURE):
                apart += np.bitwise_count((sig[host, k] ^ sig[g, k]).view(np.uint64))
            good = (apart <= FAR) & (root[host] != root[g]) & (place[host] != place[g]) & ((side[host] == 0) | (cls[host] < cls[g]))
            i, j = np.nonzero(good & (DOWN * np.minimum(size[host], size[g]) >= UP * np.maximum(size[host], size[g])))
            called[j] = True
            visits = np.zeros((len(g), len(first)), bool)
            visits[i, place[host[j]]] = True
            i, j = np.nonzero(visits)
            at.append(g[i, 0]), to.append(first[j])
        host = host[called]
        who, to = np.concatenate((host, *at)), np.concatenate((host, *to))
        return pa.table({"home": home[to], "block": block[to], "cls": cls[who], "root": root[who], "guest": np.arange(len(who)) >= len(host)})

    met = hosts.unionByName(guests).groupBy("key", "row", "column")
    return met.applyInArrow(meet, "home long, block long, cls long, root long, guest boolean").distinct()


def visited(calls: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of guests with classes of the blocks that they call on (see ``callers``).

    A guest visits a block set and all, so that pairs are compared where they are and never listed; a block's guests come in
    parties of BLOCK. One link a guest and component.
    """
    sets = sets.join(calls.select("cls").distinct(), "cls", "left_semi")
    guests, hosts = (calls.where(c).drop("guest") for c in ("guest", "not guest"))
    parties = guests.groupBy("home", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parties"))
    guests = guests.join(parties, ["home", "block"]).withColumn("party", F.pmod(F.xxhash64("cls"), "parties")).drop("parties")
    hosts = hosts.join(parties, ["home", "block"]).withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parties") - 1))).drop("parties")

    def meet(host: pa.Table, guest: pa.Table) -> pa.Table:
        a, b = [], []
        if host.num_rows and guest.num_rows:
            arrays = lambda column: [np.frombuffer(x.as_buffer(), np.uint32) for x in column]
            every, names, roots = Sets(arrays(host["grams"])), host["cls"].to_numpy(), host["root"].to_numpy()
            full = np.flatnonzero(every.sizes)
            for name, root, mine in zip(guest["g_cls"].to_pylist(), guest["g_root"].to_pylist(), arrays(guest["g_grams"]), strict=True):
                near = every.near(len(mine), full[roots[full] != root])
                if len(mine) and len(near):
                    found = near[alike(every.shared(mine, near), len(mine), every.sizes[near])]
                    _, one = np.unique(roots[found], return_index=True)
                    b += names[found[one]].tolist()
                    a += [name] * len(one)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ("home", "block", "party")
    guests = guests.join(sets, "cls").select(*(F.col(c).alias(f"g_{c}") for c in (*by, "cls", "root", "grams")))
    return hosts.join(sets, "cls").groupBy(*by).cogroup(guests.groupBy(*(f"g_{c}" for c in by))).applyInArrow(meet, "a long, b long")


def near_classes(docs: DataFrame, search: Search) -> DataFrame:
    """(cls, least, root): each set's hash, its least doc_id, and the component of its links. search: see ``Search``."""
    steps = Steps(docs.sparkSession)
    whole = steps.table(text_classes(docs), "classes")
    classes = steps.table(whole.select("cls", "least", "size", "sig"), "facts")
    near = steps.table(tree_pairs(steps, classes.select("cls", "size", "sig"), search), "trees")
    release(docs.sparkSession)
    members = steps.table(shared_keys(whole), "members")
    steps.drop(whole)
    homes = steps.table(block_places(members), "homes")
    wide = steps.table(beyond_blocks(members, homes), "wide")
    steps.drop(members)
    placed = steps.table(placed_sets(docs, homes), "sets")
    release(docs.sparkSession)
    sets = placed.select("cls", "grams")
    # a class that shares no key is similar to none: its pairs find no set
    edges = compared(steps, near, sets, "trees").unionAll(steps.table(settled(placed), "found"))
    release(docs.sparkSession)
    now = steps.table(still_apart(wide, edges), "now")
    if not now.isEmpty():
        facts = homes.join(classes.select("cls", "size", "sig"), "cls")
        edges = edges.unionAll(compared(steps, head_pairs(now, facts), sets, "heads"))
        steps.drop(now)
        now = steps.table(still_apart(wide, edges), "now")
        steps.drop(wide)
        mains = key_mains(now)
        edges = edges.unionAll(compared(steps, rest_pairs(now, mains, facts), sets, "rest"))
        calls = steps.table(callers(now, mains, facts), "calls")
        steps.drop(now)
        if not calls.isEmpty():
            edges = edges.unionAll(steps.table(visited(calls, sets), "visits"))
    roots = connected_components(edges)
    out = materialize(classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root")))
    steps.end()
    release(docs.sparkSession)
    return out


def kept_rows(docs: DataFrame, search: Search) -> DataFrame:
    """(_row, _key, _cls) of the rows of docs, whole, that stay: the least doc_id of each component. search: see ``Search``."""
    found = near_classes(docs, search)
    release(docs.sparkSession)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("least").alias("_key"), F.col("cls").alias("_cls"))).alias("k")).select("k._key", "k._cls")
    # the row goes as one column, so that no column of docs can clash with ours
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col("text").cast("string").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), classes_of(b.column(2))], names=["_row", "_key", "_cls"])

    return rows.mapInArrow(tag, f"_row {kind}, _key long, _cls long").join(kept, ["_key", "_cls"], "left_semi")
