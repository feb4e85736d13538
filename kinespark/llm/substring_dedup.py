"""Removal of word passages that occur more than once, found through difference-cover anchors.

A passage is a window of ``window`` consecutive words of one document; a word goes if a
window that covers it has the same words as a window that starts anywhere else, in
another row or at another place of the same row. All occurrences go, judged on the input.

Hashing every window of the corpus and shuffling it would move several times the input.
Instead, shorter windows are hashed only at positions whose remainder modulo a period is
in a difference cover: for any two positions there is a shift below the period that puts
both on the cover, so two equal long windows always share an anchor at equal offsets.
Anchors that occur once are dropped in one exchange; around the rest the match is
extended to whole windows in a second one. Windows are held equal if two fingerprints agree,
of 64 and 32 bits, over word hashes that are made from the bytes independently. A hash that
repeats inside a task's batch is settled there and sent on once, so a passage that a third
of all rows share costs one entry a batch, not one a row, in the task of its hash. The hash
space is cut into parts by the bytes of the texts, so what a task holds of it doesn't grow.

Defined results: null and empty texts have no words and lose none; rows that are repeated
as a whole count as two places; of a passage's places none is kept, so there are no ties;
ids may be of any type, may be null and may repeat; a text of any length is read whole; an
empty table gives an empty table. Other columns, whatever their names, are ignored by
``judge`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import clear_of, groups_for, named, packed, stored

WINDOW = 35
#: Perfect difference sets: each remainder is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
BYTES_A_PART = 24 << 20
_FLUSH = 600_000
_BLOB = "part int, known boolean, a binary, b binary, place binary, per binary, k1 binary, k2 binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for a window: the longest period that leaves anchors of a third of it."""
    best = (1, (0,), window)
    for period, cover in COVERS.items():
        if window - period + 1 >= max(1, window // 3):
            best = (period, cover, window - period + 1)
    return best


def _key(ident: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text."""
    return F.xxhash64(F.lit(3), ident, text), F.xxhash64(ident, text)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = _key(named(id_col), named(text_col))
    return df.select(named(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), named(text_col).alias("text"))


class _Blobs:
    """Collects (hash, row, place) and gives them out by part of the hash space."""

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.n = parts, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, row: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((a, b, row, place, k1, k2))
        self.n += len(a)
        if self.n >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            self.held = []
            return
        base = np.cumsum([0] + [len(x[4]) for x in self.held])
        a, b, place, k1, k2 = (np.concatenate([x[i] for x in self.held]) for i in (0, 1, 3, 4, 5))
        row = np.concatenate([x[2] + base[i] for i, x in enumerate(self.held)])
        self.held, self.n = [], 0
        # repeats inside this batch are settled here: their places travel by row, and one of them by hash for other batches
        twice, first = _repeats(a, b)
        by_hash = np.flatnonzero(~twice | first)
        yield self._packed(a, b, place, row, k1, k2, by_hash, (a[by_hash] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32), False)
        by_row = np.flatnonzero(twice)
        if len(by_row):
            of_row = at.mix(k2.view(np.uint64))[row[by_row]]
            yield self._packed(a, b, place, row, k1, k2, by_row, (of_row >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32), True)

    def _packed(self, a, b, place, row, k1, k2, take, part, known: bool) -> pa.RecordBatch:
        part = part.astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        out: list[list] = [[] for _ in range(8)]
        for p in range(self.parts):
            at_ = take[order[cuts[p] : cuts[p + 1]]]
            if not len(at_):
                continue
            first = np.flatnonzero(np.r_[True, np.diff(row[at_]) != 0])
            rows = row[at_][first]
            per = np.diff(np.r_[first, len(at_)]).astype(np.uint32)
            hashes = (b"", b"") if known else (a[at_].tobytes(), b[at_].tobytes() if len(b) else b"")
            for col, x in zip(out, (p, known, *hashes, place[at_].astype(np.uint32).tobytes(), per.tobytes(), k1[rows].tobytes(), k2[rows].tobytes()), strict=True):
                col.append(x)
        names = ["part", "known", "a", "b", "place", "per", "k1", "k2"]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), *(pa.array(x, pa.binary()) for x in out[2:])], names=names)


def _repeats(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: whether an equal one exists, and whether it is the first of several."""
    order = np.lexsort((b, a)) if len(b) else np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if len(b):
        same &= b[order][1:] == b[order][:-1]
    twice, first = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first[order[:-1][same & ~np.r_[False, same[:-1]]]] = True
    return twice, first


def _column(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in table.column(name).to_pylist()] or [np.zeros(0, dtype)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, a partition: rows and places of hashes that occur more than once, and those known to from their batch."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _of_part(pa.Table.from_batches(held)).to_batches()


def _of_part(table: pa.Table) -> pa.Table:
    known = table.filter(table.column("known"))
    table = table.filter(pc.invert(table.column("known")))
    twice, _ = _repeats(_column(table, "a", np.uint64), _column(table, "b", np.uint32))
    found = [_places(known, None), _places(table, twice)]
    return pa.concat_tables(found)


def _places(table: pa.Table, take: np.ndarray | None) -> pa.Table:
    place, per = _column(table, "place", np.uint32), _column(table, "per", np.uint32)
    row = np.repeat(np.arange(len(per)), per)
    if take is not None:
        row, place = row[take], place[take]
    first = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)
    rows = row[first]
    ends = np.r_[first[1:], len(row)] if len(row) else first
    return pa.table({
        "k1": pa.array(_column(table, "k1", np.int64)[rows], pa.int64()),
        "k2": pa.array(_column(table, "k2", np.int64)[rows], pa.int64()),
        "place": pa.array([place[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
    })


def _anchors(parts: int, period: int, cover: tuple[int, ...], length: int):
    on = np.zeros(period, dtype=bool)
    on[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _Blobs(parts)
        for batch, raw, offsets in at.each_text(batches):
            words = at.split(raw, offsets)
            n = len(words.starts)
            if n < length:
                continue
            row = words.row_of()
            place = np.arange(n) - words.rows[:-1][row]
            take = np.flatnonzero(on[place[: n - length + 1] % period] & at.inside(words.rows, length))
            h = at.window_hashes(words.hashes(), length)[take]
            yield from blobs.add(h, np.zeros(0, np.uint32), row[take], place[take], *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")))
        yield from blobs.flush()

    return run


def _marks(blobs: list[list[bytes]], rows: np.ndarray, before: int, after: int, most: np.ndarray) -> np.ndarray:
    """Words, over all rows, within ``[place - before, place + after)`` of a listed place; starts end at ``most`` of a row."""
    edge = np.zeros(int(rows[-1]) + 1, dtype=np.int32)
    for i, parts in enumerate(blobs):
        if parts:
            p = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
            np.add.at(edge, rows[i] + np.maximum(p - before, 0), 1)
            np.add.at(edge, rows[i] + np.minimum(p + after, most[i]), -1)
    return np.cumsum(edge[:-1]) > 0


def _extended(parts: int, window: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _Blobs(parts)
        for batch, raw, offsets in at.each_text(batches):
            words = at.split(raw, offsets)
            if len(words.starts) < window:
                continue
            starts = np.maximum(words.counts - window + 1, 0)
            near = _marks(batch.column("places").to_pylist(), words.rows, period - 1, 1, starts)
            take = np.flatnonzero(near[: len(near) - window + 1] & at.inside(words.rows, window))
            h = words.hashes()
            row = words.row_of()[take]
            place = take - words.rows[:-1][row]
            second = at.window_hashes(words.hashes(1), window, 1)[take].astype(np.uint32)
            yield from blobs.add(at.window_hashes(h, window)[take], second, row, place, *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")))
        yield from blobs.flush()

    return run


def _kept(words: at.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each row, one space after each, and the byte offsets of the rows."""
    n = len(words.raw)
    edge = np.zeros(n + 2, dtype=np.int32)
    stay = ~gone
    np.add.at(edge, words.starts[stay], 1)
    np.add.at(edge, words.ends[stay] + 1, -1)
    mask = np.cumsum(edge[: n + 1]) > 0
    raw = np.empty(n + 1, dtype=np.uint8)
    raw[:n], raw[n] = words.raw, 0x20
    raw[at.SPACE[raw]] = 0x20
    last = words.rows[1:][words.counts > 0] - 1  # a row's last word may have no byte after it in its own row
    end = words.ends[last]
    hit = end == words.offsets[1:][words.counts > 0]
    begins = np.zeros(n + 1, dtype=bool)
    begins[words.starts[stay]] = True
    mask[end[hit]] &= begins[end[hit]]
    return raw[mask], np.r_[0, np.cumsum(mask)][words.offsets]


def _digests(words: at.Words, gone: np.ndarray) -> list[str]:
    text, ends = _kept(words, gone)
    blob = text.tobytes()
    return [hashlib.sha256(blob[i:j].rstrip(b" ")).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in at.each_text(batches):
        words = at.split(raw, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(words.counts, pa.int64()), pa.array(_digests(words, np.zeros(len(words.starts), bool)), pa.string())],
            names=["doc_id", "k1", "k2", "n_words", "whole_sha256"],
        )


def _cut_text(raw: np.ndarray, i: int, j: int, words: at.Words, gone: np.ndarray, row: int) -> str:
    """Row text without the words that go; what separates the others stays."""
    a, b = words.rows[row], words.rows[row + 1]
    drop = np.zeros(j - i + 1, dtype=np.int32)
    g = np.flatnonzero(gone[a:b]) + a
    stop = np.r_[words.starts[1:], j]
    np.add.at(drop, words.starts[g] - i, 1)
    np.add.at(drop, np.minimum(stop[g], j) - i, -1)
    return raw[i:j][np.cumsum(drop[:-1]) == 0].tobytes().decode("utf-8", "replace")


def _removed(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in at.each_text(batches):
            words = at.split(raw, offsets)
            gone = _marks(batch.column("places").to_pylist(), words.rows, 0, window, words.counts)
            n = np.diff(np.r_[0, np.cumsum(gone)][words.rows])
            if with_text:
                last = pa.array([_cut_text(raw, offsets[i], offsets[i + 1], words, gone, i) for i in range(batch.num_rows)], pa.string())
            else:
                last = pa.array(_digests(words, gone), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), last], names=["k1", "k2", "n_removed", "left"])

    return run


def _changed(docs: DataFrame, id_col: str, text_col: str, window: int, with_text: bool) -> DataFrame:
    """k1, k2, n_removed and what is left (text or digest) of each row that has a repeated window."""
    period, cover, length = cover_for(window)
    parts = groups_for(docs, text_col, BYTES_A_PART, 4)
    keyed = _keyed(docs, id_col, text_col)
    hit = "k1 long, k2 long, place binary"
    anchors = keyed.mapInArrow(_anchors(parts, period, cover, length), _BLOB).repartitionById(parts, F.col("part")).mapInArrow(_shared, hit)
    anchors = anchors.groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    near = stored(keyed.join(anchors, ["k1", "k2"]))
    windows = near.mapInArrow(_extended(parts, window, period), _BLOB).repartitionById(parts, F.col("part")).mapInArrow(_shared, hit)
    windows = windows.groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    out = near.drop("places").join(windows, ["k1", "k2"]).mapInArrow(_removed(window, with_text), "k1 long, k2 long, n_removed long, left string")
    return out.dropDuplicates(["k1", "k2"])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space)."""
    clear_of(docs, id_col, text_col)
    changed = _changed(docs, id_col, text_col, window, with_text=False)
    kind = docs.schema[id_col].dataType.simpleString()
    whole = _keyed(docs, id_col, text_col).mapInArrow(_whole, f"doc_id {kind}, k1 long, k2 long, n_words long, whole_sha256 string")
    return whole.join(changed, ["k1", "k2"], "left").select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("left", "whole_sha256").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``; the text loses repeated passages, white space between other words stays."""
    clear_of(docs, id_col, text_col)
    changed = _changed(docs, id_col, text_col, window, with_text=True)
    row = lambda c: F.col("row").getField(c)
    k1, k2 = _key(row(id_col), row(text_col))
    joined = packed(docs).withColumns({"k1": k1, "k2": k2}).join(changed, ["k1", "k2"], "left")
    return joined.select(*((F.coalesce("left", row(c)) if c == text_col else row(c)).alias(c) for c in docs.columns))


#: DuckDB, for ``judge`` with the default window.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM d),
k AS (SELECT row, i, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS words FROM s),
r AS (SELECT words FROM k GROUP BY words HAVING count(*) > 1),
g AS (SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS i FROM k JOIN r USING (words)),
p AS (SELECT row, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
t AS (SELECT p.row, count(g.i) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept FROM p LEFT JOIN g ON p.row = g.row AND p.i = g.i GROUP BY p.row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (row)
"""
