"""Exact top-k, importance resampling and periodic runs against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic, quantised, resampling, topk, wordids

DOCS = "doc_id long, text string, start long, _w string, _pos long, rank string, score string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abCdeéß9") for _ in range(r.randint(1, 5))) for _ in range(40)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [prose(r.randint(0, 90)) for _ in range(40)]
    out += [" ".join([prose(p)] * k) + " " + prose(5) for p, k in ((1, 12), (1, 30), (2, 9), (3, 5), (5, 2), (7, 3), (11, 2), (40, 2))]
    out += [None, "", " \n\t ", "one", "a a a a a a a a a a a a", "a a a a a a a a a a a", "x y " * 3000, prose(5000), out[3], out[41], "{a}|B~c\x7fD\x1ce  ÀÉ"]
    return out


def table(spark, texts):
    rows = [(k, t, 1, "w", 2, "r", "s") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], (2, "another text of a known id", *rows[0][2:]), (None, texts[41], *rows[0][2:]), (None, None, None, None, None, None, None)], DOCS).repartition(5)


# --- words as ids ---------------------------------------------------------------------------------------------------


def test_word_ids(texts):
    import pyarrow as pa

    for limit in (1, 100, 1 << 20):
        for low, high, block in wordids.blocks(pa.array(texts), limit=limit):
            ids = {}
            for k in range(low, high):
                words = re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")
                a, b = block.first[k - low], block.first[k - low + 1]
                assert block.said(a, b).decode().split(" ") == (words or [""])
                for word, i in zip(words, block.ids[a:b].tolist(), strict=True):
                    assert ids.setdefault(word, i) == i
            assert len(set(ids.values())) == len(ids)


# --- exact top-k ----------------------------------------------------------------------------------------------------


def plain_top(rows, k, every):
    kept = []
    for n, (vec_id, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * 256) for x in e):
            most = 1 << min(30, (62 - math.ceil(math.log2(max(2, len(e))))) // 2)
            kept.append((n, vec_id, [max(-most, min(most, math.floor(256 * x))) for x in e]))
    out = []
    for n, vec_id, e in kept:
        if vec_id is not None and vec_id % every == 0:
            scores = [(-sum(a * b for a, b in zip(e, f, strict=True)), other is None, other) for m, other, f in kept if m != n and len(f) == len(e)]
            out += [(vec_id, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(3)
    low = r.standard_normal((5, 24))
    out = [(k, (r.standard_normal(5) @ low * r.exponential()).tolist()) for k in range(400)]
    same = out[7][1]
    out += [(1000 + k, same) for k in range(60)] + [(50, same), (50, same), (100, out[3][1])]
    out += [(2000, None), (2050, [None] * 24), (2100, [float("nan")] * 24), (2150, [float("inf")] + [0.0] * 23), (2200, [0.0] * 24), (2250, [1e-170] * 24), (2300, [1e200] * 24), (2350, [-1e9] * 24), (2400, [1e308] * 24)]
    out += [(None, same), (None, out[9][1]), (3000, [1.0, 2.0]), (3050, [3.0, -1.0]), (3001, [-0.0, 0.001]), (3100, []), (3150, []), (4000, [5.0] * 7), (-50, out[11][1])]
    return out


@pytest.mark.parametrize("band", [40, topk.BAND])
def test_top_k(spark, monkeypatch, band):
    monkeypatch.setattr(topk, "BAND", band)
    monkeypatch.setattr(topk, "BLOCK", band)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, ids int, cid int").repartition(4)
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str)
    assert got == plain_top(rows, 5, 50)
    assert topk.top_k(df.where("vec_id % 50 = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_prune():
    """Long candidates and a few leading directions leave few pairs to score, and the result is that of all pairs."""
    r = np.random.default_rng(5)
    x = np.floor(r.standard_normal((4000, 3)) @ r.standard_normal((3, 32)) * 100 * r.exponential(size=(4000, 1)) + r.standard_normal((4000, 32))).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(1), kind="stable")]
    q = x[::40]
    best = topk.Best(len(q), 5, np.full(len(q), np.iinfo(np.int64).min))
    scored = topk.compare(x, np.arange(len(x)), np.arange(len(x)), q, best, topk.rotations(list(x[:500]))[32])
    every = q @ x.T
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), every.shape), -every), axis=1)[:, :5]
    assert (best.cid == order).all() and (best.score == np.take_along_axis(every, order, 1)).all()
    assert scored < every.size / 4


# --- embedding near-duplicates: any size of components, any shape of data -------------------------------------------


def test_vectors_of_any_size_link(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base * 3 + 0.01 * r.standard_normal(base.shape)]))]
    alone = {r["vec_id"]: r["n_links"] for r in quantised.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    sizes = [(100, [1e-170] * 16), (101, [3e-170] * 15 + [2.9e-170]), (102, [1e200] * 16), (103, [1e308] * 8 + [1.1e308] * 8), (104, [5e-324] * 16), (105, [0.0] * 16), (106, (base[3] * 1e-200).tolist()), (107, (base[3] * 1e250).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantised.near_vectors(spark.createDataFrame(rows + sizes, "vec_id long, embedding array<double>")).collect()}
    assert alone == dict.fromkeys(range(24), 1)
    assert {k: got[k][0] for k in range(24)} == {k: 3 if k in (3, 15) else 1 for k in range(24)}
    assert [got[k] for k in (100, 101, 102, 103, 104)] == [(4, 100)] * 5 and got[105] == (0, 105) and got[106] == got[107] == (3, 3)


@pytest.mark.parametrize("shape", ["spread", "few directions", "clusters"])
def test_links_at_the_least_cosine_are_found(shape):
    """Of pairs between 0.95 and 0.96, with lists of the production size."""
    r = np.random.default_rng(7)
    n = 20_000
    if shape == "few directions":
        x = r.standard_normal((n, 4)) @ r.standard_normal((4, 64))
    elif shape == "clusters":
        x = r.standard_normal((300, 64))[r.integers(0, 300, n)] + 0.3 * r.standard_normal((n, 64))
    else:
        x = r.standard_normal((n // 2, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        away = r.standard_normal(x.shape)
        away -= (away * x).sum(1)[:, None] * x
        x = np.concatenate([x, 0.953 * x + np.sqrt(1 - 0.953**2) * away / np.linalg.norm(away, axis=1)[:, None]])
    u = quantised.units(x)
    index = quantised.fit(x[r.choice(n, quantised.SAMPLE, replace=False)], n, 0.95)
    home = index.code(u)[0]
    i, j = np.nonzero(np.triu((c := u[:6000] @ u.T) >= 0.95, 1) & (c < 0.96))
    i, j = i[: 200_000], j[: 200_000]
    low, high = np.where(home[i] <= home[j], i, j), np.where(home[i] <= home[j], j, i)
    visits = index.visited(u[low], home[low])
    met = (home[low] == home[high]) | np.array([h in v for h, v in zip(home[high].tolist(), visits, strict=True)])
    assert len(met) > 100 and met.mean() >= 0.999


# --- importance resampling ------------------------------------------------------------------------------------------


def grams(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 50)])
def test_resampling(spark, texts, longest, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 300)
    docs = table(spark, texts)
    wanted = [texts[1], "the words asked for", None, ""]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    rows = [(r["doc_id"], *grams(r["text"], longest)) for r in docs.collect()]
    corpus, target = Counter(bucket(g) for r in rows for g in r[2]), Counter(bucket(g) for t in wanted for g in grams(t, longest)[1])
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    gain = [math.floor(1000 * math.log((target[k] + 1) * s_all / ((corpus[k] + 1) * t_all))) for k in range(buckets)]
    scored = []
    for doc_id, n, found in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        scored.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k, r in enumerate(scored) if r[1] >= 20), key=lambda k: (-scored[k][4], scored[k][0] is None, scored[k][0] or 0, scored[k][2]))
    rank = {k: n for n, k in enumerate(order[: len(order) // 10], 1)}
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in wanted], "text string"), longest, buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*r, rank.get(k))) for k, r in enumerate(scored))


def test_resampling_empty(spark, texts):
    docs = table(spark, texts)
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert resampling.resample(docs, docs.limit(0)).where("rank is not null").count() > 0


# --- periodic runs --------------------------------------------------------------------------------------------------


def plain_runs(w, least):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            if i - s >= p and e - s >= least and not any(all(w[t] == w[t + q] for t in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_ids():
    r = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(0, 4)):
            k, n = r.choice([1, 2, 2, 3, 5]), r.choice([0, 1, 5, 20, 60, 120])
            w = [r.randrange(k) for _ in range(n)]
            p, a = r.randint(1, n // 3 + 1), r.randrange(n or 1)
            docs.append([w[i] if i < a else w[a + (i - a) % p] for i in range(n)] if r.random() < 0.4 and a + p <= n else w)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        for least in (2, 5, 12):
            got = list(zip(*(x.tolist() for x in periodic.periodic_runs(np.array([x for d in docs for x in d], np.int64), first, least)), strict=True))
            assert got == [(int(first[k]) + s, int(first[k]) + s + n, p) for k, d in enumerate(docs) for s, n, p in plain_runs(d, least)]


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_texts(spark, texts):
    docs = table(spark, texts)
    got, want = periodic.find_runs(periodic.planted(docs)).drop("runs", "collapsed", "n_words"), []
    for r in docs.collect():
        words = plant(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        found = plain_runs(words, 12)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if found else None
        want.append((r["doc_id"], len(found), *best, exponent, digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sum(x[1] > 0 for x in want) > 8
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_a_long_text_and_its_runs(spark):
    """A text of two million words that repeats itself, whole."""
    one = periodic.find_runs(spark.sql("select 1 doc_id, repeat('a b c ', 600000) || 'd' text")).first()
    assert (one["n_words"], one["n_runs"], one["start"], one["length"], one["period"], one["collapsed"]) == (1_800_001, 1, 0, 1_800_000, 3, "a b c d")


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    """Every pair is compared, however few go in one round."""
    from tidemark.llm import session, shingles

    monkeypatch.setattr(shingles, "ROUND", 4)
    sets = spark.createDataFrame([(k, bytearray(np.arange(k % 2, 20, dtype=np.uint32).tobytes())) for k in range(6)] + [(9, bytearray(np.arange(90, 99, dtype=np.uint32).tobytes()))], "cls long, grams binary")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in (*range(a + 1, 6), 9)], "a long, b long")
    steps = session.Steps(spark)
    found = {tuple(r) for r in shingles.compared(steps, pairs, sets, "x").collect()}
    assert found == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    steps.end()


def test_trees_bring_near_copies_together(spark, monkeypatch):
    """Near copies meet through the trees of the SimHash operator alone, and only those similar enough stay linked."""
    from tidemark.llm import shingles, simhash

    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    texts = []
    for changed in (1,) * 20 + (130,) * 20:  # words of 400 at the end: similarity over 0.99, and about 0.5
        base = [word() for _ in range(400)]
        texts += [" ".join(base), " ".join(base[: 400 - changed] + [word() for _ in range(changed)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shingles, "settled", lambda sets: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(shingles, "still_apart", lambda wide, edges: wide.withColumn("root", wide["cls"]).limit(0))
    kept = {x["doc_id"] for x in simhash.deduplicate(docs).collect()}
    assert kept == {k for k in range(80) if k >= 40 or k % 2 == 0}


@pytest.mark.parametrize("cell", [3, 4096])
def test_only_what_could_be_similar_calls_on_a_block(spark, monkeypatch, cell):
    """Classes of a large key, in cells of any size: those with a partner in another block and component are found, nobody else moves."""
    from tidemark.llm import shingles

    monkeypatch.setattr(shingles, "PAIRED", 4)
    monkeypatch.setattr(shingles, "CELL", cell)
    monkeypatch.setattr(shingles, "TILE", 2)
    r = np.random.default_rng(6)
    sets = []
    for k in range(30):
        base = r.integers(1, 1 << 63, 50).astype(np.uint64) if k % 3 == 0 else sets[k // 3 * 3]
        sets.append(np.sort(np.concatenate((base[3:], r.integers(1, 1 << 63, 3).astype(np.uint64))) if k % 3 else base))
    sets += [np.sort(r.integers(1, 1 << 63, 50).astype(np.uint64)) for _ in range(20)]
    root, block = [0 if k < 4 else k for k in range(50)], [k % 2 for k in range(50)]
    sig = shingles.signatures(np.concatenate(sets), np.arange(0, 50 * 51, 50))
    now = spark.createDataFrame([(key, k, root[k]) for key in (1, 2) for k in range(50)], "key long, cls long, root long")
    facts = spark.createDataFrame([(k, 1, block[k], 50, sig[k].tolist()) for k in range(50)], "cls long, home long, block long, size long, sig array<long>")
    grams = spark.createDataFrame([(k, bytearray(np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes())) for k, x in enumerate(sets)], "cls long, grams binary")
    alike = [(a, b) for a in range(50) for b in range(a) if root[a] != root[b] and block[a] != block[b] and shingles.alike(len(np.intersect1d(sets[a], sets[b])), 50, 50)]
    calls = shingles.callers(now, shingles.key_mains(now), facts)
    assert len(alike) > 10 and {x["cls"] for x in calls.collect()} == {k for pair in alike for k in pair}
    found = {frozenset((root[a], root[b])) for a, b in shingles.visited(calls, grams).collect()}
    assert found == {frozenset((root[a], root[b])) for a, b in alike}


def test_texts_that_share_passages_stay_where_they_are(spark, monkeypatch):
    """Texts that share passages and are not alike: their sets are not sent to each block of each passage."""
    from tidemark.llm import shingles, simhash

    for name, value in (("PAIRED", 4), ("BLOCK", 8), ("COMMON", 0)):
        monkeypatch.setattr(shingles, name, value)
    r = np.random.default_rng(9)
    words = lambda n: ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(n)]
    passages = [words(60) for _ in range(8)]
    texts = [" ".join(sum((passages[k] for k in r.permutation(8)[:3]), words(180))) for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    assert simhash.deduplicate(docs).count() == 240
    assert shuffled() - before < 10 * sum(map(len, texts))
