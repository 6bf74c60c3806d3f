"""Words of whole texts as numbers: equal words of a block get equal ids, told apart by their bytes and not by a hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte value, whether it separates words; ranges include both ends."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: 0x20 and 0x09-0x0D.
SPACES = separators((0x09, 0x0D), (0x20, 0x20))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Block:
    """Words of a few consecutive texts: byte bounds, ids, first word of each text (one more than texts), and the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray):
        word = ~between[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] | edge[1:n]
        closes[:-1] &= ~word[1:] | edge[1:n]
        self.data = data
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.raw = data.tobytes()
        if not len(self.starts):
            self.ids = np.zeros(0, np.int64)
            return
        bounds = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        spelt = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[word])])
        self.ids = spelt.dictionary_encode().indices.to_numpy().astype(np.int64)

    def said(self, low: int, high: int) -> bytes:
        """Words low to high - 1, joined by one space."""
        return b" ".join([self.raw[s:e] for s, e in zip(self.starts[low:high].tolist(), self.ends[low:high].tolist(), strict=True)])


def blocks(column: pa.Array, between: np.ndarray = SPACES, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, their words) of a string column. Texts are taken together up to ``limit`` bytes, a longer
    one alone and whole; null counts as empty; lower turns A-Z into a-z."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low, n = 0, len(column)
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1))
        part = data[bounds[low] : bounds[high]]
        yield low, high, Block(_LOWER[part] if lower else part, bounds[low : high + 1] - bounds[low], between)
        low = high
