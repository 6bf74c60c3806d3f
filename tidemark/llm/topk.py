"""Exact top-k by inner product: candidates by descending length, partial sums after an SVD rotation, Cauchy-Schwarz bounds.

Vectors are quantised to integers, and equal ones are one candidate that keeps its k + 1 least ids (no other can be among a
query's k best). Candidates get their place by descending length, per number of components, and are cut into bands. Bands
are taken in turns, the first one first, then twice as many each turn: a query is sent to a band only if its own length times
the band's greatest reaches the score of the k-th best that it already has. In a band, candidates are again taken longest
first, in chunks. Queries and candidates are rotated by the right singular vectors of a sample, so that a few leading
components hold most of a product; after each group of components the product is bounded by the sum so far plus the
product of the lengths left (Cauchy-Schwarz), and pairs below the query's score are dropped. What is left is scored
with integers. The rotation only prunes: results are exact whatever it is.

A task holds one band and one block of queries, whose sizes are fixed; only one row a band comes to the driver. Candidates are
copied once for each block of queries that reaches their band, so the work grows as queries times candidates where
lengths are alike and nothing can be pruned.

Defined results: vectors that are null or hold null or non-finite components (after scaling) take no part, as queries
or candidates; vectors of different lengths are not compared; a vector without components scores 0 with others like it. Quantised
components are held within +-2^b, the largest power at which no score overflows a long (2^28 for 64 components). Rows with equal
vectors or equal ids are candidates one by one; a query leaves out its own row alone. A null id is no query and comes last among
ties. Fewer candidates than k give them all; empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import positions
from tidemark.llm.session import materialize

K, SCALE, EVERY = 5, 256, 50
#: Candidates of a band and queries of a block, fewer where vectors are wide; and vectors that rotations are fitted on.
BAND, BLOCK, CELL_BYTES, SAMPLE = 8_192, 4_096, 32 << 20, 4_096
#: Candidates that are compared before queries are looked at again.
CHUNK = 512
#: Rounding of a bound, as a share of the product of lengths.
SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def rotations(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """By number of components, the right singular vectors of the sampled vectors as columns."""
    out = {}
    for width in {len(v) for v in sample}:
        rows = np.array([v for v in sample if len(v) == width], np.float64)
        out[width] = np.linalg.svd(rows.T @ rows, hermitian=True)[0] if width else np.zeros((0, 0))
    return out


def groups(width: int) -> list[tuple[int, int]]:
    """Groups of rotated components, summed one after the other."""
    cuts = sorted({0, min(width, max(4, width // 8)), width // 2, width})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Best:
    """The ``keep`` best candidates of each query: by score, ties to the smaller least id, then to the smaller candidate."""

    def __init__(self, queries: int, keep: int, floor: np.ndarray):
        self.keep, self.floor = keep, floor
        self.score = np.full((queries, keep), _LEAST)
        self.least, self.cid = np.full((queries, keep), _LAST), np.full((queries, keep), _LAST)

    def add(self, q: np.ndarray, score: np.ndarray, least: np.ndarray, cid: np.ndarray) -> None:
        """Takes in pairs, and raises the queries' floors."""
        good = score >= self.floor[q]
        q, score, least, cid = q[good], score[good], least[good], cid[good]
        some = np.unique(q)
        if not len(some):
            return
        old = np.repeat(some, self.keep)
        q = np.concatenate((q, old))
        score, least, cid = (np.concatenate((new, table[some].ravel())) for new, table in ((score, self.score), (least, self.least), (cid, self.cid)))
        order = np.lexsort((cid, least, -np.maximum(score, -_LAST), q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        kept = order[place < self.keep]
        for table, new in ((self.score, score), (self.least, least), (self.cid, cid)):
            table[some] = new[kept].reshape(len(some), self.keep)
        self.floor[some] = np.maximum(self.floor[some], self.score[some, -1])


def compare(x: np.ndarray, least: np.ndarray, cid: np.ndarray, q: np.ndarray, best: Best, rotation: np.ndarray) -> int:
    """Takes candidates x (integers, longest first) into the best of queries q; returns the pairs that had to be scored."""
    width = x.shape[1]
    fx, fq = x.astype(np.float64), q.astype(np.float64)
    nx, nq = np.sqrt((fx * fx).sum(1)), np.sqrt((fq * fq).sum(1))
    exact = width * float(np.abs(fx).max(initial=0)) * float(np.abs(fq).max(initial=0)) < 2.0**53  # products of doubles are exact integers
    rx, rq, parts, scored = fx @ rotation, fq @ rotation, groups(width), 0
    left = lambda r: [np.sqrt((r[:, e:] ** 2).sum(1)) for _, e in parts]  # noqa: E731  lengths after each group
    lx, lq = left(rx), left(rq)
    for k in range(0, len(x), CHUNK):
        c = slice(k, k + CHUNK)
        live = np.flatnonzero(nq * nx[k] * (1 + SLACK) >= best.floor)
        if not len(live):
            break
        slack = SLACK * nq[live] * nx[k]
        i, j, total = np.repeat(np.arange(len(live)), len(nx[c])), np.tile(np.arange(len(nx[c])), len(live)), None
        for g, (s, e) in enumerate(parts):
            if g == 0:
                sums = rq[live, s:e] @ rx[c, s:e].T
                i, j = np.nonzero(sums + lq[g][live][:, None] * lx[g][c][None, :] + slack[:, None] >= best.floor[live][:, None])
                total = sums[i, j]
            elif e < width:  # the last group is left to the integers
                total = total + np.einsum("ij,ij->i", rq[live[i], s:e], rx[k + j, s:e])
                good = total + lq[g][live[i]] * lx[g][k + j] + slack[i] >= best.floor[live[i]]
                i, j, total = i[good], j[good], total[good]
            if len(i) * 4 > len(live) * len(nx[c]):
                break  # too many are left for pair by pair
        scored += len(i)
        if not len(i):
            continue
        a, b = live[i], k + j
        if not exact:
            score = np.einsum("ij,ij->i", x[b].astype(np.int64), q[a].astype(np.int64))
        elif len(i) * 4 > len(live) * len(nx[c]):
            score = np.rint(fq[live] @ fx[c].T).astype(np.int64)[i, j]
        else:
            score = np.rint(np.einsum("ij,ij->i", fx[b], fq[a])).astype(np.int64)
        best.add(a, score, least[b], cid[b])
    return scored


def top_k(rows: DataFrame, asked: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of (vec_id, embedding) for each row that ``asked``, a condition on vec_id, names."""
    spark = rows.sparkSession
    given = rows.select(F.col("vec_id").cast("long"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("e"))
    usable = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    bits = F.floor((62 - F.ceil(F.log2(F.greatest(F.size("e"), F.lit(2))))) / 2)
    most = F.least(F.pow(F.lit(2), bits), F.lit(2.0**30)).cast("long")
    given = given.where(F.coalesce(usable, F.lit(False))).withColumn("_most", most)
    given = given.select("vec_id", F.transform("e", lambda x: F.greatest(F.least(F.floor(x), F.col("_most")), -F.col("_most")).cast("int")).alias("v"), F.coalesce(asked, F.lit(False)).alias("ask"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x)
    first = F.row_number().over(Window.partitionBy("v", "ask").orderBy(F.col("vec_id").asc_nulls_last()))
    some = given.withColumn("_n", first).where(F.col("_n") <= k + 1)
    ids = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("last"), "vec_id"))), 1, k + 1), lambda x: x["vec_id"])
    classes = some.groupBy("v").agg(ids.alias("ids"), F.max("ask").alias("ask")).withColumn("norm", norm)
    placed = positions(classes, F.size("v"), -F.col("norm"), F.xxhash64("v")).withColumns({"width": F.size("v"), "cid": F.col("_pos")})
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    widest = placed.agg(F.max("width").alias("w"), F.count_if("ask").alias("n")).first()
    if widest["w"] is None or not widest["n"]:
        return nothing
    fitting = max(64, CELL_BYTES // (8 * max(1, widest["w"])))
    band, block = min(BAND, fitting), min(BLOCK, fitting)
    placed = placed.withColumn("band", F.expr(f"_pos div {band}")).drop("_pos")
    blocks = -(-widest["n"] // block)
    sample = placed.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].to_pylist()
    turned = rotations([np.array(v, np.float64) for v in sample])
    bands: dict[int, list[tuple[int, int, float]]] = {}
    for r in placed.groupBy("width", "band").agg(F.sqrt(F.max("norm").cast("double")).alias("high")).collect():
        bands.setdefault(r["width"], []).append((r["width"], r["band"], r["high"]))
    turns: dict[int, list[tuple[int, int, float]]] = {}
    for of_width in bands.values():
        for n, one in enumerate(sorted(of_width, key=lambda b: b[1]), 1):
            turns.setdefault(n.bit_length(), []).append(one)
    keep = k + 1

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("cid")
        asks, width = cell["asks"].to_numpy(zero_copy_only=False), cell["width"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for w in np.unique(width[asks]).tolist():
            x, q = (cell.filter(pa.array((width == w) & side)) for side in (~asks, asks))
            if not x.num_rows:
                continue
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, w)  # noqa: B023, E731
            best = Best(q.num_rows, keep, q["floor"].to_numpy().copy())
            qid, cid = q["cid"].to_numpy(), x["cid"].to_numpy()
            compare(matrix(x), x["least"].to_numpy(), cid, matrix(q), best, turned.get(w, np.eye(w)))
            a, b = np.nonzero(best.score > _LEAST)
            for column, values in zip(out, (qid[a], best.score[a, b], best.cid[a, b], best.least[a, b]), strict=True):
                column.append(values)
        return pa.table([np.concatenate([np.zeros(0, np.int64), *c]) for c in out], names=["qid", "score", "cid", "least"])

    queries = placed.where("ask").select("cid", "v", "width", "norm")
    least = F.coalesce(F.col("ids")[0], F.lit(_LAST))
    best = None
    for turn in sorted(turns):
        tonight = F.broadcast(spark.createDataFrame(turns[turn], "width int, band long, high double"))
        sent = queries.withColumn("floor", F.lit(_LEAST)) if best is None else queries.join(_floors(best, keep), "cid", "left").withColumn("floor", F.coalesce("floor", F.lit(_LEAST)))
        sent = sent.join(tonight, "width").where(F.sqrt(F.col("norm").cast("double")) * F.col("high") * (1 + SLACK) >= F.col("floor"))
        sent = sent.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)))
        reached = sent.select("width", "band", "block").distinct()
        met = placed.join(reached, ["width", "band"]).select("band", "block", F.lit(False).alias("asks"), "width", "cid", "v", F.lit(_LEAST).alias("floor"), least.alias("least"))
        cells = met.unionAll(sent.select("band", "block", F.lit(True), "width", "cid", "v", "floor", F.lit(_LAST)))
        found = cells.groupBy("band", "block").applyInArrow(search, "qid long, score long, cid long, least long")
        best = materialize(_best(found if best is None else best.unionAll(found), keep))
    # at most k + 1 candidates of k + 1 ids for each distinct query
    listed = best.join(placed.select("cid", "ids"), "cid").select("qid", F.col("score"), F.explode("ids").alias("vec_id"))
    listed = listed.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("vec_id").isNull().alias("last"), "vec_id"))).alias("all"))
    answers = queries.select(F.col("cid").alias("qid"), "v", "norm").join(listed, "qid")
    asking = given.where("ask").join(answers, "v")
    own = F.array_position("all", F.struct((-F.col("norm")).alias("less"), F.col("vec_id").isNull().alias("last"), "vec_id"))
    others = F.when(own > 0, F.concat(F.slice("all", 1, (own - 1).cast("int")), F.slice("all", (own + 1).cast("int"), k))).otherwise(F.col("all"))
    ranked = asking.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "found"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "found.vec_id", (-F.col("found.less")).alias("score"))


def _best(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "least", "cid"))
    return found.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def _floors(best: DataFrame, keep: int) -> DataFrame:
    """(cid of a query, score of its last) of queries that have as many as they can keep."""
    return best.groupBy(F.col("qid").alias("cid")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == keep).drop("n")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the five greatest inner products of every fiftieth vector with all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
