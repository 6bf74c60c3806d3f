"""Chat formatting by token-level assembly.

A turn is START role SEP text END. The three marks are reserved token ids beyond the vocabulary; role and text are
encoded each on its own, so no content can merge with, or turn into, a mark. Inside content every control string, and the
escape sign itself, carries an escape sign, so the decoded text can be taken apart again as the ids can. Segment lengths
are summed up to offsets, and the loss mask is the running sum of +1 where an assistant's text begins and -1 where it ends.

Rows of a conversation are ordered by turn (null first), then role, then text. A conversation is one row of output, so it
is put together in one task; conversations of any number are spread by id.

Defined results: null text or role is the empty string; rows with equal turns stay apart; each row of a null
conv_id is a conversation of its own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.session import small_batches

#: What the reserved ids stand for in text, in order from the first id beyond the vocabulary.
MARKS = ("### ", ": ", "</turn>\n")
ESCAPE = "\\"
LEARNER = "assistant"

_text_controls = re.compile(r"\\|###|</turn>")
_role_controls = re.compile(r"\\|###|</turn>|:")
_escaped = re.compile(r"\\(.)", re.S)
_rendered = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>\n))*)</turn>\n", re.S)


def escape(text: str, controls: re.Pattern = _text_controls) -> str:
    return controls.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted text of (role, text) turns."""
    start, sep, end = MARKS
    return "".join(start + escape(role, _role_controls) + sep + escape(text) + end for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(unescape(m[1]), unescape(m[2])) for m in _rendered.finditer(formatted)]


class Template:
    def __init__(self, tool: bpe.Encoder):
        self.tool, self.base = tool, max(tool.tokens) + 1
        self.start, self.sep, self.end = (self.base + k for k in range(3))

    def assemble_all(self, chats: list[list[tuple[str, str]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of each chat's (role, text) turns; segments of all chats are encoded together, each on its own."""
        encoded = self.tool.encode([x for turns in chats for role, text in turns for x in (escape(role, _role_controls), escape(text))])
        for turns in chats:
            yield self.assemble(turns, [np.array(next(encoded), np.int32) for _ in range(2 * len(turns))])

    def assemble(self, turns: list[tuple[str, str]], segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of (role, text) turns, given the ids of each role and text."""
        marks = [np.array([m], np.int32) for m in (self.start, self.sep, self.end)]
        pieces = [p for k in range(len(turns)) for p in (marks[0], segments[2 * k], marks[1], segments[2 * k + 1], marks[2])]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64))).astype(np.int64)
        ids = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        change = np.zeros(len(ids) + 1, np.int64)
        learn = np.array([role == LEARNER for role, _ in turns], bool)
        np.add.at(change, offsets[3:-1:5][learn], 1)
        np.add.at(change, offsets[4:-1:5][learn], -1)
        return ids, np.cumsum(change)[:-1].astype(bool)

    def decode(self, ids: np.ndarray) -> str:
        """The formatted text; reserved ids become their marks."""
        known, marks = self.tool.tokens, [m.encode() for m in MARKS]
        return b"".join(known[t] if t < self.base else marks[t - self.base] for t in ids.tolist()).decode()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
        """(turns, texts under the mask) back from ids and mask."""
        turns, learned = [], []
        starts, seps, ends = (np.flatnonzero(ids == m) for m in (self.start, self.sep, self.end))
        for a, b, c in zip(starts.tolist(), seps.tolist(), ends.tolist(), strict=True):
            turns.append((unescape(self.tool.decode(ids[a + 1 : b].tolist()).decode()), unescape(self.tool.decode(ids[b + 1 : c].tolist()).decode())))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            learned.append(unescape(self.tool.decode(ids[a:b].tolist()).decode()))
        return turns, learned


def _grouped(conversations: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    conv = F.col("conv_id").cast("long")
    alone = F.when(conv.isNull(), F.monotonically_increasing_id())
    found = conversations.select(conv.alias("conv_id"), alone.alias("alone"), turn.alias("t")).groupBy("conv_id", "alone")
    return found.agg(F.array_sort(F.collect_list("t")).alias("turns")).drop("alone")


def _turns(b: pa.RecordBatch) -> Iterator[list[tuple[str, str]]]:
    for turns in b.column(1).to_pylist():
        yield [(t["role"], t["text"]) for t in turns]


def format_chats(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, ids array of int, loss_mask array of boolean, text) of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(bpe.encoder(path, pattern))
        for b in batches:
            ids, masks = [], []
            for one, mask in template.assemble_all(list(_turns(b))):
                ids.append(one), masks.append(mask)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array([template.decode(x) for x in ids], pa.string())], names=["conv_id", "ids", "loss_mask", "text"])

    small_batches(conversations.sparkSession)
    return _grouped(conversations).mapInArrow(run, "conv_id long, ids array<int>, loss_mask array<boolean>, text string")


def digest_chats(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Formats each conversation and returns digests of what is read back from the ids and the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(bpe.encoder(path, pattern))
        for b in batches:
            rows = []
            for ids, mask in template.assemble_all(list(_turns(b))):
                turns, learned = template.read(ids, mask)
                told, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in turns:
                    told.update(f"{role}\n{text}\n".encode())
                for text in learned:
                    loss.update(text.encode())
                rows.append((len(turns), told.hexdigest(), sum(map(len, learned)), loss.hexdigest(), len(template.decode(ids)), len(ids), int(mask.sum())))
            columns = [pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True) if rows else [()] * 7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"])

    small_batches(conversations.sparkSession)
    return _grouped(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all conversations and one made of control strings."""
    import public_tokenizers as public

    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    return digest_chats(rows, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).drop("n_tokens", "n_loss_tokens")
