"""Words of whole texts, hashed with numpy over Arrow buffers. A word is a run of bytes other than 0x20 and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is taken alone, whole.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values, so that sums of powers become usable hashes."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, grown as texts ask for it."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
        if n > 8 * CHUNK_BYTES:  # not kept for one very long text
            out = _powers[0], _powers[1]
            _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            return out
    return _powers[0], _powers[1]


class Chunk:
    """Words of a few consecutive texts: byte bounds, the text each belongs to, and first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~WHITE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # one more than texts
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        up, down = _table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, their words) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks() of none
        return
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, side="right")) - 1)
        high = min(high, n)
        yield low, high, Chunk(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        low = high


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, by doubling; runs may cross texts, which the caller masks."""
    base = pow(0xA0761D6478BD642F, 2 * seed + 1, 1 << 64)
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out, have = mix(hashes, seed), 1
    units, done = out, None
    taken = 0
    while size:
        if size & 1:  # append a run of `have` words after the `taken` ones so far
            if done is None:
                done, taken = out, have
            else:
                m = min(len(done), len(out) - taken)
                done = done[:m] * np.uint64(pow(base, have, 1 << 64)) + out[taken : taken + m]
                taken += have
        size >>= 1
        if size:
            m = len(out) - have
            out = out[:m] * np.uint64(pow(base, have, 1 << 64)) + out[have : have + m]
            have *= 2
    return mix(done[: len(units) - taken + 1], seed + 7)
