"""Embedding near-dedup by product quantisation: coarse inverted lists, residual codes, table-lookup distances, exact rerank.

Coarse centroids and, on the residuals, one small codebook per subspace are fitted on a bounded sample. Every distinct
vector is then coded: its list, a byte per subspace, and the length of what the code leaves out. A vector is compared with
its own list and with later ones among its nearest centroids, unless the plane between the two centroids is further away
than a partner can be. How many nearest ones are sufficient is measured, on sampled vectors and on partners made for
them at exactly the wanted cosine, so that PROBED of these are reached from either side: partners away from them in any
direction, in directions that the data vary in, and towards vectors of their own list, so that data of few directions or
of clusters are measured as they are. Because only later lists are visited, a pair is met
at most once. In a list, the asymmetric distance (exact vector to coded vector, summed from
per-subspace tables) less the coding error bounds the true distance from below, so pairs that it rules out are no links;
all others are settled by their cosine in double precision.

Equal vectors are one class with a multiplicity. Lists are cut into tiles, and the vectors that visit a large list into
blocks, so a task holds a bounded part of any dense group; tasks report link counts and a spanning forest, never pairs.

Vectors are scaled by a power of two before lengths are taken, so that finite components of any size can be compared.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and stay; vectors of
different lengths do not link, and each length has its own index. Rows with equal vectors link with each other. Rows of one vec_id are counted one by
one. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import connected_components, materialize
from tidemark.llm.simhash import forest

#: Vectors that the index is fitted on; all vectors are indexed.
SAMPLE = 8_192
#: Wanted vectors per list, and most lists.
LIST, LISTS = 256, 2_048
SUBSPACES, CODES = 8, 256
#: Share of sampled partners at the least cosine whose list the probes must reach.
PROBED = 0.9995
#: Per cent of the measured probes that are made.
SPARE = 130
#: Vectors whose random mixture is a direction that the data vary in.
MIXED = 16
TILE, BLOCK = 2_048, 8_192


def _nearest(x: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    out, own = np.empty((len(x), count), np.int64), (centres * centres).sum(1)[None, :]
    for k in range(0, len(x), 1_024):
        d = own - 2 * x[k : k + 1_024] @ centres.T
        out[k : k + 1_024] = d.argmin(1)[:, None] if count == 1 else np.argsort(d, axis=1, kind="stable")[:, :count]
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between 1/2 and 1, exactly but for what is 2**1000 times smaller."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    half = power // 2  # in two steps: the factor itself may overflow
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


@dataclass
class Index:
    """Coarse centroids, codebooks (subspace, code, part), how many nearest lists to probe, and how far off a partner can be."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    reach: float

    def borders(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How far each vector is from the plane between its list's centroid and each other one; 0 for its own."""
        own = self.centres[home]
        squares = (self.centres * self.centres).sum(1)
        far = squares[None, :] - 2 * unit @ self.centres.T
        apart = np.sqrt(np.maximum((own * own).sum(1)[:, None] + squares[None, :] - 2 * own @ self.centres.T, 1e-30))
        out = (far - np.take_along_axis(far, home[:, None], 1)) / (2 * apart)
        out[np.arange(len(unit)), home] = 0
        return out

    def ranks(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """How many lists are nearer to each vector than the one named for it."""
        out = np.empty(len(unit), np.int64)
        squares = (self.centres * self.centres).sum(1)
        for k in range(0, len(unit), 1_024):
            far = squares[None, :] - 2 * unit[k : k + 1_024] @ self.centres.T
            out[k : k + 1_024] = (far < np.take_along_axis(far, lists[k : k + 1_024, None], 1)).sum(1)
        return out

    def visited(self, unit: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """For each vector the later lists that it is compared with."""
        near = _nearest(unit, self.centres, min(self.probes, len(self.centres)))
        good = (near > home[:, None]) & (np.take_along_axis(self.borders(unit, home), near, 1) <= self.reach)
        return [n[g] for n, g in zip(near, good, strict=True)]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the coding error) of unit vectors."""
        home = _nearest(unit, self.centres)[:, 0]
        residual = unit - self.centres[home]
        codes = np.stack([_nearest(p, b)[:, 0] for p, b in zip(self.parts(residual), self.books, strict=True)], axis=1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return home, codes, np.linalg.norm(residual - coded, axis=1)

    def distances(self, unit: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to the coded vectors of a list, from per-subspace tables."""
        residual = unit - self.centres[home]
        total = np.zeros((len(unit), len(codes)), np.float32)
        for j, (part, book) in enumerate(zip(self.parts(residual), self.books, strict=True)):
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None, :]
            total += table.astype(np.float32)[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def fit(sample: np.ndarray, total: int, cosine: float) -> Index:
    """An index for ``total`` vectors from sampled ones (rows of doubles, none zero)."""
    unit = units(sample)
    lists = int(max(1, min(LISTS, total // LIST, max(1, len(unit) // 4))))
    centres = _kmeans(unit, lists, 8, 1)
    own = _nearest(unit, centres)[:, 0]
    residual = unit - centres[own]
    books = [_kmeans(p, CODES, 6, 2 + j) for j, p in enumerate(np.array_split(residual, min(SUBSPACES, unit.shape[1]), axis=1))]
    index = Index(centres, books, 1, float(np.sqrt(2 - 2 * cosine)) + 1e-9)
    index.probes = _sufficient(index, unit, own, cosine)
    return index


def _sufficient(index: Index, unit: np.ndarray, own: np.ndarray, cosine: float) -> int:
    """How many nearest lists to probe so that PROBED of partners at exactly the least cosine are met, whichever of the two visits."""
    rng = np.random.default_rng(9)
    tried = rng.choice(len(unit), min(4_096, len(unit)), replace=False)
    by_list = np.argsort(own, kind="stable")
    first, size = np.searchsorted(own[by_list], own[tried]), np.bincount(own, minlength=len(index.centres))[own[tried]]
    local = by_list[first + (rng.random(len(tried)) * size).astype(np.int64)]
    mixed = sum(unit[rng.integers(0, len(unit), len(tried))] * rng.standard_normal((len(tried), 1)) for _ in range(MIXED))
    probes = 1
    for away in (rng.standard_normal(unit[tried].shape), mixed, unit[local]):
        away = away - (away * unit[tried]).sum(1)[:, None] * unit[tried]
        norms = np.linalg.norm(away, axis=1)
        some = norms > 1e-9
        if some.any():
            partner = cosine * unit[tried][some] + np.sqrt(1 - cosine * cosine) * away[some] / norms[some, None]
            other = _nearest(partner, index.centres)[:, 0]
            ranks = np.maximum(index.ranks(unit[tried][some], other), index.ranks(partner, own[tried][some]))
            probes = max(probes, int(np.quantile(ranks, PROBED, method="higher")) + 1)
    return -(-probes * SPARE // 100)  # centroids are nearer to the vectors that they were fitted on than to others


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def near_vectors(rows: DataFrame, cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding)."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    given = given.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding")).alias("v"))
    classes = given.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    alone = given.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    widths = classes.groupBy(F.size("v").alias("width")).count().collect()
    if not widths:
        return alone
    found = reduce(DataFrame.unionAll, (near_classes(classes.where(F.size("v") == r["width"]), r["width"], r["count"], cosine, sample) for r in sorted(widths)))
    counts = found.where("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    roots = connected_components(found.where("edge").select("a", "b")).withColumnRenamed("node", "cid")
    placed = classes.select("cid", "v", "least", "copies").join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    members = placed.join(named, "root").select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    joined = given.where("v is not null").join(members, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.unionByName(alone)


def near_classes(classes: DataFrame, width: int, total: int, cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """Over ``total`` distinct vectors (cid, v, copies) of one width: (edge, a, b), where an edge joins two cids and the other rows
    count, for cid a, b linked vectors; counts come in parts. An index of its own is fitted for them."""
    picked = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()["v"].combine_chunks()
    index = fit(picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), width), total, cosine)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            home, codes, error = index.code(units(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _bytes(x), pa.array(home), _bytes(codes), pa.array(error)], names=["cid", "copies", "x", "home", "codes", "error"])

    coded = materialize(classes.select("cid", "v", "copies").mapInArrow(code, "cid long, copies long, x binary, home long, codes binary, error double"))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("home").count().collect():
        sizes[r["home"]] = r["count"]
    tiles = np.maximum(1, -(-sizes // TILE))
    blocks = np.maximum(1, -(-4 * sizes // BLOCK))
    # a cell is a tile of a list with a block of its visitors; cells of a list follow each other
    first = np.concatenate(([0], np.cumsum(tiles * blocks)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, home, cid = _matrix(b.column(2), "f8"), b.column(3).to_numpy(), b.column(0).to_numpy()
            near = index.visited(units(x), home)
            mixed = (cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows_, cells, stays = [], [], []
            for k in range(b.num_rows):
                h, m = home[k], int(mixed[k])
                tile = m % tiles[h]
                own = first[h] + tile * blocks[h]
                held = range(own, own + blocks[h])  # stored once for each block of visitors
                seen = [first[h] + t * blocks[h] + m // 7 % blocks[h] for t in range(tile + 1, tiles[h])]
                seen += [first[n] + t * blocks[n] + m // 7 % blocks[n] for n in near[k] for t in range(tiles[n])]
                rows_ += [k] * (len(held) + len(seen))
                cells += [*held, *seen]
                stays += [True] * len(held) + [False] * len(seen)
            picked = b.take(pa.array(rows_, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(stays, pa.bool_()), *picked.columns], names=["cell", "stays", "cid", "copies", "x", "home", "codes", "error"])

    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-5

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("cid")
        stays = cell["stays"].to_numpy(zero_copy_only=False)
        cid, copies = cell["cid"].to_numpy(), cell["copies"].to_numpy()
        none = pa.table({"edge": pa.array([], pa.bool_()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        held = np.flatnonzero(stays)
        if not len(held) or len(cid) < 2:
            return none
        key = cell["cell"][0].as_py()
        home = int(np.searchsorted(first, key, side="right")) - 1
        whole = (key - first[home]) % blocks[home] == 0  # this block also settles the tile's inner pairs
        x = scaled(_matrix(cell["x"], "f8"))
        norm = np.linalg.norm(x, axis=1)
        codes, error = _matrix(cell["codes"], "u1")[held], cell["error"].to_numpy()[held]
        asked = np.arange(len(cid)) if whole else np.flatnonzero(~stays)
        links = np.zeros(len(cid), np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in range(0, len(asked), 256):
                q = asked[k : k + 256]
                i, j = np.nonzero(index.distances(x[q] / norm[q, None], home, codes) <= reach + error[None, :])
                a, b = q[i], held[j]
                fresh = ~stays[a] | (a < b)  # inner pairs once
                a, b = a[fresh], b[fresh]
                for s in range(0, len(a), 1 << 16):
                    p, r = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    good = np.einsum("ij,ij->i", x[p], x[r]) / (norm[p] * norm[r]) >= cosine
                    p, r = p[good], r[good]
                    np.add.at(links, p, copies[r])
                    np.add.at(links, r, copies[p])
                    if len(p):
                        yield p, r

        root = forest(len(cid), pairs())
        linked, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        if not len(linked):
            return none
        edge = np.zeros(len(linked) + len(joined), bool)
        edge[len(linked) :] = True
        return pa.table({"edge": edge, "a": np.concatenate((cid[linked], cid[joined])), "b": np.concatenate((links[linked], cid[root[joined]]))})

    cells = coded.mapInArrow(route, "cell long, stays boolean, cid long, copies long, x binary, home long, codes binary, error double")
    return materialize(cells.groupBy("cell").applyInArrow(compare, "edge boolean, a long, b long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
