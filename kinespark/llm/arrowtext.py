"""Vectorised text handling for Arrow batches.

Every function works on the raw UTF-8 buffer of a batch, a few megabytes at a time, so
memory per Python worker stays flat whatever the size of a partition. A word is a
maximal run of bytes other than 0x20 and 0x09-0x0D; as these bytes never occur inside
a multi-byte character, that equals the regex ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTES = [np.random.RandomState(seed).randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240229, 20250301)]
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_CHAR_POWERS = [_Powers(b) for b in _BASES]
_WINDOW_POWERS = (_Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64), on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row makes a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, i + 20_000)
        yield i, j
        i = j


@dataclass
class Words:
    """The words of some rows: byte spans, and the word range of each row."""

    raw: np.ndarray
    offsets: np.ndarray  # bytes, by row
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # words, by row: row i has words rows[i]:rows[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, a function of its bytes only; the two lanes have nothing in common."""
        up, down = _CHAR_POWERS[lane].get(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[lane][self.raw] * up[:-1], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of the rows whose bytes are ``raw[offsets[i]:offsets[i + 1]]``."""
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(raw, offsets, zero, zero, np.zeros(len(offsets), np.int64))
    gap = space[raw]
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = True, gap
    edge = offsets[(offsets >= 0) & (offsets < n)]
    before[edge] = True
    starts = np.flatnonzero(before[:n] & ~gap)
    after = np.empty(n, dtype=bool)
    after[:-1], after[-1] = gap[1:], True
    after[edge[edge > 0] - 1] = True
    ends = np.flatnonzero(after & ~gap) + 1
    return Words(raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each ``k`` consecutive items of ``h`` (``len(h) - k + 1`` of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _WINDOW_POWERS[lane].get(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum((h if not lane else mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF))) * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


def inside(rows: np.ndarray, k: int) -> np.ndarray:
    """Of the windows of ``k`` words over all rows, whether each lies in one row."""
    total = int(rows[-1])
    if total < k:
        return np.zeros(0, bool)
    out = np.ones(total, dtype=bool)
    for back in range(1, k):  # the last k - 1 words of a row start no window
        at = rows[1:] - back
        out[at[at >= rows[:-1]]] = False
    return out[: total - k + 1]


def each_text(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, of: str | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their text, a column or, with ``of``, a field of that struct column."""
    for batch in batches:
        raw, offsets = utf8(batch.column(column) if of is None else batch.column(of).field(column))
        for i, j in chunks(offsets, limit):
            yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
