"""Byte-level BPE by corpus-level merge replay, and decoding.

A task takes its texts in chunks. The distinct pieces of a chunk that it has not met yet are split by the tokenizer's
pattern, and the distinct matches become one small corpus of words held as linked byte positions. An inverted index
maps the rank of each adjacent token pair to the positions where such a pair stands; ranks are taken in order, every
listed position still holding a pair of that rank is merged, and only its two neighbours' pairs enter the index. A merge
may create a pair of lower rank than the one at hand; its word then takes such pairs first, so that each word sees
exactly the merges, in exactly the order, of a loop over that word alone.

A piece ends before a single space or newline that stands between two characters which are not white space: the pattern
always starts a match there, and no earlier match looks past it. Results for pieces are kept in the Python worker, up
to a bound, and dropped all at once beyond it, so memory does not grow with the corpus.

Defined results: a null text is the empty text, which has no tokens; rows are independent, so repeated rows, ids that
are null and empty tables need no rule. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import small_batches

#: Pieces whose ids a worker keeps.
KEEP_PIECES = 1_000_000
#: Token pairs whose rank a worker keeps.
KEEP_PAIRS = 2_000_000
#: Characters of text whose new pieces are replayed together.
CHUNK_CHARS = 1 << 24
#: Places of one rank that are merged together, not one by one.
BULK = 48
#: Tokens decoded at once.
BLOCK = 1 << 16


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}  # rank of two adjacent tokens' concatenation, -1 if it is no token
        self.find = regex.compile(pattern).findall
        self.whole: dict[str, tuple[int, ...]] = {}  # ids of pieces given whole
        self.spaced: dict[str, tuple[int, ...]] = {}  # and of those given without their space
        self.words: dict[str, tuple[int, ...]] = {}
        self.digits = {rank: str(rank) for rank in self.tokens}

    def rank(self, pair: tuple[int, int]) -> int:
        """Rank of the pair's merge, -1 if there is none."""
        found = self.pairs.get(pair)
        if found is None:
            found = self.ranks.get(self.tokens[pair[0]] + self.tokens[pair[1]], -1)
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = found
        return found

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word (none empty), by merging all words together in rank order."""
        n = sum(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        # one buffer each, for single places (as an array) and for many at once (as numpy)
        text = np.frombuffer(b"".join(words), np.uint8)
        token = array("i", np.array(self.bytes, np.int32)[text].tobytes())
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        pair_at = array("i", bytes(4 * n))  # rank of the pair that starts at a place, -1 if none
        tokens, afters, befores, pairs_at = (np.frombuffer(x, np.int32) for x in (token, after, before, pair_at))
        afters[bounds[1:] - 1], befores[bounds[:-1]] = -1, -1
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        few: dict[int, list[int]] = {}  # the inverted index: rank of a pair, and places where it stood, singly
        many: dict[int, list[np.ndarray]] = {}  # and in bulk
        heap: list[int] = []
        rank_of, pair_rank = self.rank, self.pairs.get

        def note(i: int, r: int) -> None:
            pair_at[i] = r
            if r >= 0:
                if r in few:
                    few[r].append(i)
                else:
                    few[r] = [i]
                    heapq.heappush(heap, r)

        def note_all(places: np.ndarray, ranks: np.ndarray) -> None:
            pairs_at[places] = ranks
            kept = ranks >= 0
            places, ranks = places[kept], ranks[kept]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist()]
            for r, s, e in zip(ranks[starts].tolist() if len(ranks) else (), starts, [*starts[1:], len(ranks)], strict=False):
                if e - s < BULK // 4:
                    if r in few:
                        few[r].extend(places[s:e].tolist())
                    else:
                        few[r] = places[s:e].tolist()
                        heapq.heappush(heap, r)
                elif r in many:
                    many[r].append(places[s:e])
                else:
                    many[r] = [places[s:e]]
                    heapq.heappush(heap, r)

        def settle(i: int, below: int) -> None:
            """Merges what ranks below ``below`` in the word around i, lowest and leftmost first."""
            while before[i] >= 0:
                i = before[i]
            while True:
                best, at, k = below, -1, i
                while k >= 0:
                    if 0 <= pair_at[k] < best:
                        best, at = pair_at[k], k
                    k = after[k]
                if at < 0:
                    return
                merge(at, best)

        def merge(i: int, rank: int) -> bool:
            """Merges the pair at i; whether a pair of lower rank came of it."""
            j = after[i]
            token[i], token[j], pair_at[j] = rank, -1, -1
            after[i] = right = after[j]
            left, lower = before[i], False
            if right >= 0:
                before[right] = i
                pair = (rank, token[right])
                r = pair_rank(pair)
                if r is None:
                    r = rank_of(pair)
                pair_at[i] = r
                if r >= 0:
                    lower = r < rank
                    if r in few:
                        few[r].append(i)
                    else:
                        few[r] = [i]
                        heapq.heappush(heap, r)
            else:
                pair_at[i] = -1
            if left >= 0:
                pair = (token[left], rank)
                r = pair_rank(pair)
                if r is None:
                    r = rank_of(pair)
                pair_at[left] = r
                if r >= 0:
                    lower = lower or r < rank
                    if r in few:
                        few[r].append(left)
                    else:
                        few[r] = [left]
                        heapq.heappush(heap, r)
            return lower

        def neighbours(beside: np.ndarray, rank: int, first: bool) -> np.ndarray:
            """Ranks of the pairs that places' new token makes with the tokens at ``beside`` (-1: no token there)."""
            out = np.full(len(beside), -1, np.int32)
            there = np.flatnonzero(beside >= 0)
            if len(there):
                kinds, which = np.unique(tokens[beside[there]], return_inverse=True)
                ranks = np.array([rank_of((rank, t) if first else (t, rank)) for t in kinds.tolist()], np.int32)
                out[there] = ranks[which]
            return out

        def merge_all(i: np.ndarray, rank: int) -> list[int]:
            """Merges the pair at each place that stands clear of the others; returns the places left for one-by-one merging."""
            j = afters[i]
            right, left = afters[j], befores[i]
            make_right, make_left = neighbours(right, rank, True), neighbours(left, rank, False)
            # words in which merges touch, or bring a lower rank, go one by one
            odd = ((make_right >= 0) & (make_right < rank)) | ((make_left >= 0) & (make_left < rank))
            odd[:-1] |= (j[:-1] == i[1:]) | (right[:-1] == i[1:])
            rest: list[int] = []
            if odd.any():
                words_odd = np.isin(word_of[i], word_of[i[odd]])
                rest = i[words_odd].tolist()
                clear = ~words_odd
                i, j, right, left, make_right, make_left = (x[clear] for x in (i, j, right, left, make_right, make_left))
            tokens[i], tokens[j], pairs_at[j], afters[i] = rank, -1, -1, right
            befores[right[right >= 0]] = i[right >= 0]
            note_all(i, make_right)
            note_all(left[left >= 0], make_left[left >= 0])
            return rest

        if n:
            table = np.full((256, 256), -1, np.int32)
            firsts, seconds = text[:-1].astype(np.int32), text[1:]
            seen = np.zeros((256, 256), bool)
            seen[firsts, seconds] = True
            for x, y in np.argwhere(seen).tolist():
                table[x, y] = rank_of((self.bytes[x], self.bytes[y]))
            ranks = np.full(n, -1, np.int32)
            ranks[:-1] = table[firsts, seconds]
            ranks[bounds[1:] - 1] = -1
            note_all(np.arange(n, dtype=np.int32), ranks)
        while heap:
            rank = heapq.heappop(heap)
            places, bulk = few.pop(rank, []), many.pop(rank, [])
            if len(places) + sum(map(len, bulk)) >= BULK:
                every = np.unique(np.concatenate([np.array(places, np.int32), *bulk]))
                places = merge_all(every[pairs_at[every] == rank], rank)
            else:
                for part in bulk:
                    places += part.tolist()
                places.sort()
            for i in places:
                if pair_at[i] == rank and merge(i, rank):
                    settle(i, rank)
        left = tokens >= 0
        ids, counts = tokens[left].tolist(), np.add.reduceat(left, bounds[:-1]).tolist() if n else []
        out, at = [], 0
        for count in counts:
            out.append(tuple(ids[at : at + count]))
            at += count
        return out

    def learn(self, new: list[tuple[dict[str, tuple[int, ...]], str, str]]) -> None:
        """Replays the distinct pattern matches, of (where it is kept, key, piece) not met before, that are not known either."""
        known, find = self.words, self.find
        split = [(kept, key, find(piece)) for kept, key, piece in new]
        words = list({w for _, _, found in split for w in found if w not in known})
        gc.disable()  # the index is many small lists and no cycles
        try:
            known.update(zip(words, self.replay([w.encode() for w in words]), strict=True))
            for kept, key, found in split:
                kept[key] = known[found[0]] if len(found) == 1 else tuple(t for w in found for t in known[w])
        finally:
            gc.enable()

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text, in order."""
        low, whole, spaced = 0, self.whole, self.spaced
        while low < len(texts):
            high, size, needed, needed_spaced = low, 0, set(), set()
            while high < len(texts) and (high == low or size + len(texts[high]) <= CHUNK_CHARS):
                size += len(texts[high])
                first, rest = pieces(texts[high])
                needed.update(first)
                needed_spaced.update(rest)
                high += 1
            if len(whole) + len(spaced) + len(needed - whole.keys()) + len(needed_spaced - spaced.keys()) > KEEP_PIECES:
                whole.clear(), spaced.clear(), self.words.clear()
            new = [(whole, x, x) for x in needed - whole.keys()]
            new += [(spaced, x, x if x[0] == "\n" else " " + x) for x in needed_spaced - spaced.keys()]
            self.learn(new)
            for text in texts[low:high]:
                first, rest = pieces(text)
                ids = list(chain.from_iterable(map(whole.__getitem__, first)))
                ids.extend(chain.from_iterable(map(spaced.__getitem__, rest)))
                yield ids
            low = high

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def pieces(text: str) -> tuple[list[str], list[str]]:
    """(pieces given whole, pieces given without their leading space) of the text, in order: it is cut before each single
    space or newline that has no white space on either side; a piece that begins with a newline is given whole either way."""
    if not text:
        return [], []
    if text[0] in SPACES or text[-1] in SPACES or any(x in text for x in _RAGGED):
        return _ragged_pieces(text), []
    parts = text.replace("\n", " \n").split(" ")
    return parts[:1], parts[1:]


#: Every character that Python or Unicode counts as white space, and what keeps the plain cut from being right.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RAGGED = ("  ", "\n\n", " \n", "\n ", *(c for c in SPACES if c not in " \n"))


def _ragged_pieces(text: str) -> list[str]:
    out, whole, sep = [""], False, ""
    for line in text.split("\n"):
        for part in line.split(" "):
            if part and whole and not part[0].isspace():
                out.append(sep + part)
                whole = not part[-1].isspace()
            else:
                out[-1] += sep + part
                whole = part != "" and not part[-1].isspace()
            sep = " "
        sep = "\n"
    return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; vocabularies are read from ``path``, which every executor must have."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def digest(tool: Encoder, ids: list[int]) -> tuple[str, str]:
    """SHA-256 of the decimal ids joined by commas, and of the bytes that they decode to."""
    listed, decoded = hashlib.sha256(), hashlib.sha256()
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK]
        listed.update((("," if k else "") + ",".join(map(tool.digits.__getitem__, block))).encode())
        decoded.update(tool.decode(block))
    return listed.hexdigest(), decoded.hexdigest()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows' doc_id with ``ids`` (array of int), in place of all other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tool.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text binary) of rows with ``ids``; bytes, since ids may stop inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.decode(ids or []) for ids in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text in one pass, keeping digests alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [(len(ids), *digest(tool, ids)) for ids in tool.encode(texts)]
            counts, listed, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents encoded and decoded."""
    import public_tokenizers as public

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
