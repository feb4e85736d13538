"""Near-duplicates by order MinHash, verified by banded alignment.

Texts are compared as sequences of normalised words (case and ASCII punctuation dropped).
Each word pair of a text is labelled with its occurrence number, so repeats count. One
sketch takes the ``TAKE`` labelled pairs of least hash under its own seed and keeps them in
the order of the text: texts share a sketch when they share those pairs in that order, so
the chance follows edit similarity rather than a bag of words. Any shared sketch of the
``SKETCHES`` makes two texts candidates. Two bounds on labelled single words drop candidates
that can't reach the threshold: the parity of the words in ``PARITY`` cells, which is exact,
and the agreement of ``LANES`` one-byte minima, less four standard errors. The rest are
aligned in a band as wide as the threshold allows and linked if their word edit similarity,
1 - distance / longer length, reaches ``THRESHOLD``.

Equal texts are collapsed first: one row stands for them, so copies are never paired with
each other. Groups of near copies aren't paired out either. Edit distance is a metric: each
text is aligned with one pivot, a central text of its runs, and texts of one pivot whose
distances to it sum to no more than the least length of the group allows are linked without
an alignment; their links are counted from a histogram of distances. Only the pairs that
these bounds leave open, and candidates with different pivots, are aligned. So ``n_links``
counts the links to all different texts that are candidates or that the bound proves. A run
of more than ``HOT`` texts, such as the pages of one template, is replaced by runs of equal
rare words, of which linked texts share one for certain; where even those are as large, they
are dealt to cells so that each pair meets in just one. Classes are the connected components
of the links.

Defined results: rows of equal text share a class, whatever their ids; texts without a word
(after normalising) link to nothing but equal texts; each null text is a class of its own,
under its row; the class id is the least id in the class, null if it has none but null ids;
ids may be of any type that sorts, may be null and may repeat; a text of any length is read
whole; of equally central texts the first is the pivot, which changes no result but how it
is found; an empty table gives an empty table. Other columns, whatever their names, are
ignored by ``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import clear_of, cut, named, packed, row_hash, stored, unpacked

THRESHOLD = 0.8
SKETCHES, TAKE, PAIR = 24, 2, 2
LANES, PARITY = 128, 512
SIGNATURE = LANES + PARITY // 8  # bytes
HOT, BLOCK = 20_000, 10_000
BAND = 64
STARS, SEEN = 8, 16  # leaders a cell; texts that each is compared with to find a central one

_DROP = at.SPACE.copy()
for _c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _DROP[ord(_c)] = True
_CASE = np.arange(256, dtype=np.uint8)
_CASE[0x41:0x5B] += 32
_SEEDS = np.random.RandomState(61).randint(0, 2**63, SKETCHES).astype(np.uint64)
_LANE_SEED = np.uint64(0x5851F42D4C957F2D)


def normal_words(raw: np.ndarray, offsets: np.ndarray) -> at.Words:
    """Words between white space and ASCII punctuation, ASCII letters in lower case."""
    return at.split(_CASE[raw], offsets, _DROP)


def _occurrence(key: np.ndarray) -> np.ndarray:
    """How many equal keys come before each."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), dtype=np.uint64)
    out[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return out


def _labelled(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of each item with the number of equal items before it in its row."""
    salted = key ^ at.mix((row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at.mix(key + _occurrence(salted) * np.uint64(0xD6E8FEB86659FD93))


def sketches(words: at.Words) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash keys (row, sketch) and signatures (row, byte): minima of the lanes, then parities; rows without a word have zeros."""
    n = len(words.rows) - 1
    keys, signs = np.zeros((n, SKETCHES), np.uint64), np.zeros((n, SIGNATURE), np.uint8)
    if not len(words.starts):
        return keys, signs
    h = words.hashes()
    row = words.row_of()
    # the last word of a text pairs with a mark, so each word starts a pair
    after = np.r_[h[1:], np.uint64(0)]
    after[words.rows[1:][words.counts > 0] - 1] = np.uint64(1)
    item = _labelled(at.mix(h * np.uint64(3) + after), row)
    full = np.flatnonzero(words.counts > 0)
    first = words.rows[:-1][full]
    size = words.counts[full]
    lane_of = np.repeat(np.arange(len(full)), size)
    most = np.uint64(2**64 - 1)
    place = np.arange(len(item))
    for s in range(SKETCHES):
        x = (item ^ _SEEDS[s]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        least = np.minimum.reduceat(x, first)
        hit = np.flatnonzero(x == least[lane_of])
        got, at_ = np.unique(lane_of[hit], return_index=True)
        one = place[hit[at_]]
        x[one] = most
        low = np.minimum.reduceat(x, first)
        hit = np.flatnonzero((x == low[lane_of]) & (low[lane_of] != most))
        got, at_ = np.unique(lane_of[hit], return_index=True)
        two = one.copy()
        two[got] = place[hit[at_]]
        a, b = item[np.minimum(one, two)], item[np.maximum(one, two)]
        keys[full, s] = at.mix(a * np.uint64(5) + at.mix(b) + np.uint64(s))
    # one permutation of single words: each falls into one lane, and a lane keeps the low byte of its least value
    z = at.mix(_labelled(h, row) ^ _LANE_SEED)
    table = np.full(len(full) * LANES, most)
    np.minimum.at(table, lane_of * LANES + (z % np.uint64(LANES)).astype(np.int64), z >> np.uint64(8))
    table = table.reshape(-1, LANES)
    signs[full, :LANES] = np.where(table == most, 0, 1 + (table % np.uint64(255))).astype(np.uint8)
    odd = np.bincount(lane_of * PARITY + (z >> np.uint64(55)).astype(np.int64) % PARITY, minlength=len(full) * PARITY) & 1
    signs[full, LANES:] = np.packbits(odd.astype(np.uint8).reshape(-1, PARITY), axis=1)
    return keys, signs


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in at.each_text(batches):
        words = normal_words(raw, offsets)
        keys, signs = sketches(words)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(words.counts, pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([k.tobytes() for k in signs], pa.binary())],
            names=["id", "t1", "t2", "n", "keys", "signs"],
        )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sketch of a text."""
    for batch in batches:
        keys = np.frombuffer(at.utf8(batch.column("keys"))[0], np.int64)
        n = batch.num_rows
        rep = pa.array(np.repeat(np.arange(n), SKETCHES))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(rep) for c in ("rep", "n"))], names=["key", "rep", "n"])


def _most(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The greatest distance of texts of so many words that are linked."""
    return ((1 - threshold) * np.maximum(x, y) + 1e-9).astype(np.int64)


def alike(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether signatures x and y (pair, byte) of texts of so many words leave room for a link.

    Linked texts share at least ``threshold`` of the longer one's labelled words, so the words that are in just one of
    them are few, and each changes one parity. Their resemblance is at least threshold / (2 - threshold), of which the
    lanes that either uses are a sample.
    """
    apart = np.bitwise_count(x[:, LANES:] ^ y[:, LANES:]).sum(axis=1, dtype=np.int64)
    near = apart <= 2 * _most(n_x, n_y, threshold) - np.abs(n_x - n_y)
    i = np.flatnonzero(near)
    a, b = x[i, :LANES], y[i, :LANES]
    used = np.maximum(1, ((a | b) > 0).sum(axis=1))
    j = threshold / (2 - threshold)
    near[i] = ((a == b) & (a > 0)).sum(axis=1) >= used * (j - 4 * np.sqrt(j * (1 - j) / used))
    return near


@dataclass
class Cell:
    """Rows of cells, sorted by key, n and rep. Only pairs of different ``side`` count where ``side`` isn't -1."""

    key: np.ndarray
    n: np.ndarray
    rep: np.ndarray
    side: np.ndarray
    signs: np.ndarray
    ball: np.ndarray | None = None  # pivot of each text, or itself
    away: np.ndarray | None = None  # its distance
    near: np.ndarray | None = None  # the sum of distances up to which texts of one ball are linked

    def take(self, i) -> Cell:
        return Cell(*(None if (x := getattr(self, f.name)) is None else x[i] for f in fields(self)))


def cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Cell]:
    """Whole cells, from rows sorted by key. Memory is a batch and the cell at its end, whose size ``_dealt`` bounds."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [np.frombuffer(at.utf8(batch.column(c))[0], np.uint8).reshape(-1, SIGNATURE) if c == "signs" else batch.column(c).to_numpy() for c in names]
        if held is not None:
            got = [np.concatenate([h, g]) for h, g in zip(held, got, strict=True)]
        key = got[0]
        end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        held = [g[end:] for g in got]
        if end:
            yield Cell(*(g[:end] for g in got))
    if held is not None:
        yield Cell(*held)


def _unlike(c: Cell, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    return ~alike(c.signs[i], c.signs[j], c.n[i], c.n[j], threshold)


def stars(c: Cell, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader, text) pairs of each cell: a central text leads those that may be alike, the rest look for another, ``STARS`` times at most."""
    new = np.r_[True, c.key[1:] != c.key[:-1]]
    bounds = np.r_[np.flatnonzero(new), len(c.key)]
    small = np.flatnonzero(np.diff(bounds) == 2)
    lead, text = [bounds[small]], [bounds[small] + 1]
    for k in np.flatnonzero(np.diff(bounds) > 2).tolist():
        rest = np.arange(bounds[k], bounds[k + 1])
        for _ in range(STARS):
            if len(rest) < 2:
                break
            seen = rest[:: max(1, len(rest) // SEEN)][:SEEN]
            agree = sum((c.signs[rest, :LANES] == c.signs[s, :LANES]).sum(axis=1) for s in seen)
            one = rest[int(np.argmax(agree))]
            rest = rest[rest != one]
            far = _unlike(c, np.full(len(rest), one), rest, threshold)
            mine = rest[~far]
            lead.append(np.full(len(mine), one))
            text.append(mine)
            rest = rest[far]
    i, j = np.concatenate(lead), np.concatenate(text)
    ok = ~_unlike(c, i, j, threshold)
    return i[ok], j[ok]


def cross_pairs(c: Cell, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell whose balls differ and whose lengths can be alike, each once."""
    size = len(c.key)
    new = np.r_[True, c.key[1:] != c.key[:-1]]
    run = np.cumsum(new) - 1
    # the most frequent ball of each run; only texts of another look around
    order = np.lexsort((c.ball, run))
    change = np.flatnonzero(np.r_[True, (run[order][1:] != run[order][:-1]) | (c.ball[order][1:] != c.ball[order][:-1])])
    count = np.diff(np.r_[change, size])
    top = np.full(run[-1] + 1, -1)
    by = np.argsort(count, kind="stable")
    top[run[order][change[by]]] = c.ball[order][change[by]]
    minor = c.ball != top[run]
    for way in (1, -1):
        open_, d = np.flatnonzero(minor), 1
        while len(open_):
            to = open_ + way * d
            inside = (to >= 0) & (to < size)
            open_, to = open_[inside], to[inside]
            near = (c.key[open_] == c.key[to]) & (np.minimum(c.n[open_], c.n[to]) >= threshold * np.maximum(c.n[open_], c.n[to]))
            open_, to = open_[near], to[near]
            take = c.ball[open_] != c.ball[to]
            if way < 0:
                take &= ~minor[to]
            if take.any():
                yield open_[take], to[take]
            d += 1


def open_pairs(c: Cell) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell in one ball that the distances to its pivot don't prove to be links, each once."""
    order = np.lexsort((c.away, c.ball, c.key))
    key, ball, away = c.key[order], c.ball[order], c.away[order].astype(np.int64)
    new = np.r_[True, (key[1:] != key[:-1]) | (ball[1:] != ball[:-1])]
    group = np.cumsum(new) - 1
    wide = int(away.max()) + 2
    rank = group * wide + away
    # of the texts before each, those far enough from the pivot
    low = np.searchsorted(rank, group * wide + np.clip(c.near[order] - away, -1, wide - 1), side="right")
    many = np.maximum(0, np.arange(len(order)) - low)
    some = np.flatnonzero(many)
    at_, step = 0, 1 << 20
    ends = np.cumsum(many[some])
    while at_ < len(some):
        to = max(at_ + 1, int(np.searchsorted(ends, (ends[at_ - 1] if at_ else 0) + step)))
        mine = some[at_:to]
        i = np.repeat(mine, many[mine])
        j = low[i] + np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(many[mine])[:-1]], many[mine])
        yield order[i], order[j]
        at_ = to


def _pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _stars(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cells(batches, ["key", "n", "rep", "side", "signs"]):
            i, j = stars(c, threshold)
            yield _pairs_of([np.stack([c.rep[i], c.rep[j]], axis=1)])

    return run


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cells(batches, ["key", "n", "rep", "side", "signs", "ball", "away", "near"]):
            found: list[np.ndarray] = []
            held = 0
            for i, j in chain(cross_pairs(c, threshold), open_pairs(c)):
                for k in range(0, len(i), 50_000):
                    x, y = i[k : k + 50_000], j[k : k + 50_000]
                    meet = (c.side[x] < 0) | (c.side[x] != c.side[y])
                    x, y = x[meet], y[meet]
                    ok = ~_unlike(c, x, y, threshold)
                    a, b = c.rep[x[ok]], c.rep[y[ok]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                    held += len(a)
                if held > 500_000:
                    yield _pairs_of(found)
                    found, held = [], 0
            yield _pairs_of(found)

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled word of a text: rep, n (words), word."""
    for batch, raw, offsets in at.each_text(batches):
        words = normal_words(raw, offsets)
        row = words.row_of()
        word = _labelled(words.hashes(), row).view(np.int64) if len(row) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(words.counts[row], pa.int32()), pa.array(word)], names=["rep", "n", "word"])


def _parted(runs: DataFrame, texts: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """Runs (key, rep, n, size) in which those of more than ``HOT`` texts are replaced by runs of equal rare words.

    Linked texts share ``threshold`` of the longer one's labelled words. So, in whatever order all words are put, a
    text's first n - ceil(threshold * n) + 1 of them hold one that is among the first of any text linked to it. With the
    rarest words first, texts that share but a template, which is common, have nothing in common there: work on them
    grows with their number, not its square. No link is lost, and runs that are still hot are dealt to cells.
    """
    hot = cut(runs.where(F.col("size") > HOT).select("rep").distinct())
    if not hot.take(1):
        return runs
    words = stored(_texts_of(hot, texts, keyed).select("rep", "text").mapInArrow(_labels, "rep long, n int, word long"))
    many = words.groupBy("word").agg(F.count("*").alias("many"))
    nth = F.row_number().over(W.partitionBy("rep").orderBy("many", "word"))
    first = words.join(many, "word").withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(threshold * F.col("n") - F.lit(1e-9)) + 1)
    rows = first.select(F.xxhash64("word", F.lit(19)).alias("key"), "rep", "n")
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    return runs.where(F.col("size") <= HOT).unionByName(rows.join(sizes, "key").select(runs.columns))


def _dealt(runs: DataFrame) -> DataFrame:
    """Runs (key, rep, n, size) as cells (key, rep, n, side) so that every pair of a run counts in just one cell.

    A run of more than ``HOT`` rows is dealt to blocks of about ``BLOCK`` by hash; a cell is a block with itself, of
    side -1, or two blocks, which are its sides.
    """
    n = F.when(F.col("size") > HOT, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int")
    of = F.pmod(F.xxhash64("rep"), n).cast("int")
    spread = runs.select("key", "rep", "n", n.alias("blocks"), of.alias("of"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("of", "other"), F.greatest("of", "other"))
    side = F.when(F.col("of") == F.col("other"), F.lit(-1)).otherwise(F.col("of"))
    return spread.select(F.when(F.col("blocks") > 1, cell).otherwise(F.col("key")).alias("key"), "rep", "n", side.alias("side"))


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Bit-parallel over a diagonal band of ``2 * most + 1`` cells: one big integer holds the band's vertical differences.
    """
    if len(a) > len(b):
        a, b = b, a
    i, m, n = 0, len(a), len(b)
    while i < m and a[i] == b[i]:
        i += 1
    while m > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[i:m], b[i:n]
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    if m == 0:
        return n
    most = min(most, n)
    spots: dict = {}
    for k, x in enumerate(a):
        spots[x] = spots.get(x, 0) | (1 << k)
    # the column of each item of b looks at rows j - most .. j + most of a: bit k of the band is row j - most + k
    width = 2 * most + 1
    mask = (1 << width) - 1
    centre = 1 << most
    plus, minus = mask ^ (centre - 1), 0  # rows from 0 on rise by one, above them nothing
    plus = (mask >> most << most) & mask
    score = 0  # along the main diagonal
    for j in range(n):
        at_ = spots.get(b[j], 0)
        shift = j - most
        eq = (at_ >> shift if shift >= 0 else at_ << -shift) & mask
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        d0 &= mask
        hp = (minus | ~(d0 | plus)) & mask
        hn = d0 & plus
        if j < m:
            score += not d0 & centre
        else:
            # past a's end: follow its last row, which moves up one bit a column
            bit = 1 << (most - (j - m) - 1)
            score += bool(hp & bit) - bool(hn & bit)
        x = d0 >> 1
        plus = (hn | ~(x | hp)) & mask
        minus = x & hp
        if score - max(0, n - j - 1) > most:
            return most + 1
    return score if score <= most else most + 1


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> int:
    """Edit distance of two word sequences if it is within the threshold, else -1."""
    most = int((1 - threshold) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return -1
    if len(x) == len(y):
        straight = int((x != y).sum())
        if straight <= 2:  # no shift is cheaper
            return straight if straight <= most else -1
        most = min(most, straight)
    a, b = x.tolist(), y.tolist()
    band = BAND
    while band < most:  # a narrow band is enough for close texts, however long
        got = banded_distance(a, b, band)
        if got <= band:
            return got
        band *= 4
    got = banded_distance(a, b, most)
    return got if got <= most else -1


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sides = []
                for side in ("text_a", "text_b"):
                    raw, offsets = at.utf8(part.column(side))
                    words = normal_words(raw, offsets)
                    sides.append((words.hashes(), words.rows))
                (ha, ra), (hb, rb) = sides
                d = np.array([linked(ha[ra[i] : ra[i + 1]], hb[rb[i] : rb[i + 1]], threshold) for i in range(part.num_rows)])
                take = pa.array(np.flatnonzero(d >= 0))
                yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("b").take(take), pa.array(d[d >= 0], pa.int32())], names=["a", "b", "distance"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of the links (a, b): the least node of its component.

    Each node hooks to the least node around it, hooks are followed to their ends by doubling, and the links between
    the ends are the next round's. Every end takes in all nodes around it, so a round halves the nodes that still have
    links, at least, and rounds go on until no link is left; a component's least node stays an end throughout.
    """
    edges = cut(links.select("a", "b").distinct())
    state = cut(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while edges.where("a <> b").take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:
            over = up.select(F.col("node").alias("r"), F.col("root").alias("above"))
            jumped = cut(up.join(over, F.col("root") == F.col("r")).select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            up = jumped.select("node", "root")
            if not jumped.where("moved").take(1):
                break
        ends = up.select(F.col("node").alias("r"), F.col("root").alias("end"))
        state = cut(state.join(ends, F.col("root") == F.col("r"), "left").select("node", F.coalesce("end", "root").alias("root")))
        half = edges.join(ends, F.col("a") == F.col("r")).select(F.col("end").alias("a"), "b")
        edges = cut(half.join(ends, F.col("b") == F.col("r")).select("a", F.col("end").alias("b")).where("a <> b").distinct())
    return state


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hashes of the text, text; rows with a text only."""
    text = named(text_col)
    return docs.where(text.isNotNull()).select(named(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))


def _texts_of(wanted: DataFrame, texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """(rep, text), one row per distinct text that is wanted (rep); of its copies, one with the id that stands for them."""
    mine = texts.select("rep", "t1", "t2", "least").join(wanted, "rep")
    return keyed.join(mine, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("least"))).select("rep", "text").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, texts: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, distance) among pairs (a, b)."""
    pairs = cut(pairs)
    words = stored(_texts_of(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).distinct(), texts, keyed))
    both = pairs.join(words.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(words.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_aligned(threshold), "a long, b long, distance int"))


def _pivots(runs: DataFrame, texts: DataFrame, keyed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Balls (rep, ball, away, near) of texts that are linked to a pivot, and the links that were found on the way."""
    signs = texts.select("rep", "signs")
    led = _dealt(runs).where("side < 0").join(signs, "rep").select("key", "n", "rep", "side", "signs")
    pairs = cut(led.repartition("key").sortWithinPartitions("key", "n", "rep").mapInArrow(_stars(threshold), "a long, b long").distinct())
    # the leader of most texts is the pivot of those it leads; a text that leads more than its leaders is its own
    fans = cut(pairs.groupBy("a").agg(F.count("*").alias("fans")))
    ranked = pairs.join(fans, "a").groupBy("b").agg(F.max(F.struct("fans", "a")).alias("pick"))
    own = F.struct(F.coalesce("fans", F.lit(0).cast("long")).alias("fans"), F.col("b").alias("a"))
    first = ranked.join(fans.withColumnRenamed("a", "b"), "b", "left").where(F.col("pick") > own).select(F.col("pick.a").alias("a"), "b")
    found = _verified(first, texts, keyed, threshold)
    # a pivot that has one itself: its texts try that one, so that balls of one group become one
    up = found.select(F.col("b").alias("a"), F.col("a").alias("top"))
    second = found.select("a", "b").join(up, "a").select(F.col("top").alias("a"), "b").where("a <> b")
    again = _verified(second, texts, keyed, threshold)
    best = found.select("b", "a", "distance", F.lit(0).alias("turn")).unionByName(again.select("b", "a", "distance", F.lit(1).alias("turn"))).groupBy("b").agg(F.max(F.struct("turn", "a", "distance")).alias("x"))
    member = best.select(F.col("b").alias("rep"), F.col("x.a").alias("ball"), F.col("x.distance").alias("away"))
    # a pivot without another is in its own ball
    heads = member.select(F.col("ball").alias("rep")).distinct().join(member.select("rep"), "rep", "left_anti")
    member = member.unionByName(heads.select("rep", F.col("rep").alias("ball"), F.lit(0).alias("away")))
    least = member.join(texts.select("rep", "n"), "rep").groupBy("ball").agg(F.min("n").alias("n"))
    near = least.select("ball", F.floor((1 - threshold) * F.col("n") + F.lit(1e-9)).cast("int").alias("near"))
    return cut(member.join(near, "ball").select("rep", "ball", "away", "near")), cut(found.unionByName(again))


def _numbered(texts: DataFrame) -> DataFrame:
    """Adds ``rep``, a number for each distinct text that depends on nothing but the text: its hash, unless another text shares that."""
    shared = cut(texts.groupBy("t1").agg(F.count("*").alias("many")).where("many > 1").select("t1", F.lit(True).alias("shared")))
    if not shared.take(1):
        return texts.withColumn("rep", F.col("t1"))
    return texts.join(shared, "t1", "left").withColumn("rep", F.when(F.col("shared"), F.xxhash64("t2", "t1")).otherwise(F.col("t1"))).drop("shared")


def _proven(balls: DataFrame) -> DataFrame:
    """(rep, n_near): the links to texts of the same ball that the distances to its pivot prove."""
    count = balls.groupBy("ball", "away", "near").agg(F.count("*").alias("many"))
    table = count.groupBy("ball").agg(F.collect_list(F.struct("away", "many")).alias("all"))  # an entry a distance, whatever the number of texts
    reach = F.aggregate(F.filter("all", lambda x: x["away"] <= F.col("near") - F.col("away")), F.lit(0).cast("long"), lambda t, x: t + x["many"])
    itself = F.when(2 * F.col("away") <= F.col("near"), 1).otherwise(0)
    told = count.join(table, "ball").select("ball", "away", (reach - itself).alias("n_near"))
    return balls.join(told, ["ball", "away"]).select("rep", "n_near")


def graph(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (t1, t2, rep, least: id, copies, n_links, root of the class), and links (a, b: reps, distance) that connect every class.

    The links are those found by alignment; ``n_links`` also counts those that the pivots prove.
    """
    clear_of(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col)
    signed = keyed.mapInArrow(_signatures, f"id {kind}, t1 long, t2 long, n int, keys binary, signs binary")
    texts = signed.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("signs").alias("signs"))
    texts = _numbered(stored(texts))
    spread = texts.where("n > 0").select("rep", "n", "keys").mapInArrow(_spread, "key long, rep long, n int")
    sizes = cut(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    runs = spread.join(sizes, "key")
    balls, stars_ = _pivots(runs, texts, keyed, threshold)
    placed = texts.select("rep", "signs").join(balls, "rep", "left").select("rep", "signs", F.coalesce("ball", "rep").alias("ball"), F.coalesce("away", F.lit(0)).alias("away"), F.coalesce("near", F.lit(0)).alias("near"))
    rows = _dealt(_parted(runs, texts, keyed, threshold)).join(placed, "rep").select("key", "n", "rep", "side", "signs", "ball", "away", "near")
    pairs = rows.repartition("key").sortWithinPartitions("key", "n", "rep").mapInArrow(_candidates(threshold), "a long, b long").distinct()
    known = stars_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").dropDuplicates(["a", "b"])
    found = _verified(pairs.join(known, ["a", "b"], "left_anti"), texts, keyed, threshold)
    links = cut(found.unionByName(known))
    # links that the pivots prove are counted there
    ends = [balls.select(F.col("rep").alias(k), F.col("ball").alias("ball_" + k), F.col("away").alias("away_" + k), "near") for k in "ab"]
    apart = links.join(ends[0], "a", "left").join(ends[1].drop("near"), "b", "left")
    proved = (F.col("ball_a") == F.col("ball_b")) & (F.col("away_a") + F.col("away_b") <= F.col("near"))
    other = apart.where(~F.coalesce(proved, F.lit(False)))
    one = other.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("n")).unionAll(other.select("b", F.lit(1).cast("long"))).unionAll(_proven(balls))
    count = one.groupBy("rep").agg(F.sum("n").alias("n_links"))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    told = texts.select("t1", "t2", "rep", "least", "copies").join(count, "rep", "left").join(roots, "rep", "left")
    return cut(told.select("t1", "t2", "rep", "least", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "rep").alias("root"))), links


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, class_id (least id of the class), text_id (least id of equal texts), n_copies, n_links (of its text, to different texts)."""
    texts, _ = graph(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    told = texts.join(texts.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    rows = _keyed(docs, id_col, text_col).drop("text").join(told, ["t1", "t2"])
    ident = named(id_col)
    none = docs.where(named(text_col).isNull()).select(ident.alias(id_col), ident.alias("class_id"), ident.alias("text_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return rows.select(F.col("id").alias(id_col), "class_id", F.col("least").alias("text_id"), F.col("copies").alias("n_copies"), "n_links").unionByName(none)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Exactly one row of each class, with all columns: one of least id, null ids last; rows with a null text all stay."""
    texts, _ = graph(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "t1", "t2")).alias("x")).select("x.t1", "x.t2", "x.least")
    text = named(text_col)
    whole = packed(docs)
    rows = whole.where(F.col("row").getField(text_col).isNotNull()).select("row", F.col("row").getField(id_col).alias("id"), F.xxhash64(F.col("row").getField(text_col)).alias("t1"), F.xxhash64(F.lit(7), F.col("row").getField(text_col)).alias("t2"))
    mine = rows.join(first, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("least")))
    # several rows of that id and text: the first by the hash of its columns, of equal rows any
    nth = F.row_number().over(W.partitionBy("t1", "t2").orderBy(row_hash(docs)))
    return unpacked(mine.withColumn("nth", nth).where("nth = 1"), docs).unionByName(docs.where(text.isNull()))
