"""Quality rules: lines are labelled content or boilerplate by a linear-chain CRF, and content share decides.

Each ``\\n``-split line that has a word is a node with features of its characters, words
and repetitions. A chain over the lines of a document has weights for the features and
for each pair of neighbouring labels; Viterbi decoding gives the best labelling, and a
document stays if at least ``CONTENT_SHARE`` of its word characters lie in content lines
and no base rule rejects it.

The weights are the maximum a posteriori ones for labelled documents: each line takes its
document's label, the prior is a Gaussian around the hand-set ``PRIOR``. Labels within a
document never change, so a chain trained on documents as they are would learn that they
can't; half of the sample is therefore joined with documents of the other label, in either
order, those of the rarer label being used more than once.
The sample is a bounded number of labelled rows: at most ``TRAIN_DOCS`` documents of each
label, in hash order; one of more than ``TRAIN_LINES`` lines is left out of it as a whole.
Scoring covers every line of every document. Decoding and training run over all chains at
once, line by line.

Defined results: a null or empty text has no words, fails the base rules and goes; lines
without a word are no nodes; of labellings of equal score, the one that ends in boilerplate;
a content share equal to the threshold keeps; with labels of one kind only, or none, the
weights are the prior's; a document labelled several times takes its least label; repeated
rows get equal results; a text of any length is read whole; an empty table gives an empty
table; other columns, whatever their names, are ignored by ``judge`` and kept by ``passing``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import clear_of, named, packed, unpacked

CONTENT_SHARE = 0.5
TRAIN_DOCS, TRAIN_LINES, TRAIN_STEPS = 1000, 512, 160
CHUNK_BYTES = 1 << 20  # of text at once: some hundred bytes of working memory each
MIN_WORDS, MOST_REPEATED = 10, 20  # of 100 words

FEATURES = ("bias", "symbols", "some_symbols", "bars", "upper", "exclaimed", "digits", "repeated", "equal_line", "short", "sentence", "few_kinds")
#: Log odds of content: feature weights, then the 2 x 2 label pairs (boilerplate, content).
PRIOR = np.array([1.0, -8.0, -1.0, -3.0, -3.0, -2.0, -2.0, -3.0, -0.5, -0.2, 0.5, -2.0, 0.5, -0.5, -0.5, 0.5])
PRIOR_STRENGTH = 2.0
_N = len(FEATURES)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


@dataclass
class Lines:
    """Base counts of each row, and the lines with a word of all rows."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    rows: np.ndarray  # lines, by row
    features: np.ndarray
    chars: np.ndarray  # word characters of each line


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(mask)]


def _seen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: whether an equal one exists, and whether an equal one comes before it."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def _salt(row: np.ndarray) -> np.ndarray:
    return at.mix((row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    words = at.split(raw, offsets)
    lines = at.split(raw, offsets, _NEWLINE)
    n = len(offsets) - 1
    first = np.searchsorted(words.starts, lines.starts)
    last = np.searchsorted(words.starts, lines.ends)
    full = last > first
    ls, le, first, last = lines.starts[full], lines.ends[full], first[full], last[full]
    row = lines.row_of()[full]
    rows = np.searchsorted(row, np.arange(n + 1))
    gap = at.SPACE[raw] if len(raw) else np.zeros(0, bool)
    lead = (raw & 0xC0) != 0x80
    in_word = _sums(lead & ~gap)
    symbols, upper, lower, digit = (_sums(m[raw]) for m in (_SYMBOL, _UPPER, _LOWER, _DIGIT))
    bars, bangs = _sums(raw == 0x7C), _sums(raw == 0x21)

    h = words.hashes()
    word_row = words.row_of()
    repeat = np.zeros(len(h) + 1, dtype=np.int32)
    if len(h) >= 5:
        w = np.flatnonzero(at.inside(words.rows, 5))
        again, _ = _seen(at.window_hashes(h, 5)[w] ^ _salt(word_row[w]))
        np.add.at(repeat, w[again], 1)
        np.add.at(repeat, w[again] + 5, -1)
    repeated = _sums(np.cumsum(repeat[:-1]) > 0)
    known, _ = _seen(h ^ _salt(word_row))
    alike = _sums(known)
    line_words = at.Words(raw, offsets, ls, le, rows)
    equal, later = _seen(line_words.hashes() ^ _salt(row)) if len(ls) else (np.zeros(0, bool), np.zeros(0, bool))

    count = (last - first).astype(float)
    chars = in_word[le] - in_word[ls]
    letters = np.maximum(1, upper[le] - upper[ls] + lower[le] - lower[ls])
    per_char = (symbols[le] - symbols[ls]) / np.maximum(1, chars)
    tail = raw[words.ends[last - 1] - 1] if len(ls) else np.zeros(0, np.uint8)
    features = np.stack(
        [
            np.ones(len(ls)),
            np.minimum(per_char * 5, 1.0),
            per_char > 0.01,
            np.minimum(2 * (bars[le] - bars[ls]) / count, 1.0),
            (upper[le] - upper[ls]) / letters > 0.5,
            np.minimum((bangs[le] - bangs[ls]) / count, 1.0),
            np.minimum((digit[le] - digit[ls]) / np.maximum(1, chars), 1.0),
            (repeated[last] - repeated[first]) / count,
            equal,
            count < 4,
            np.isin(tail, [0x2E, 0x3F]),
            (alike[last] - alike[first]) / count > 0.9,
        ],
        axis=1,
    ).astype(np.float32) if len(ls) else np.zeros((0, _N), np.float32)
    return Lines(
        words.counts,
        np.diff(in_word[offsets]),
        np.diff(symbols[offsets]),
        np.bincount(row[later], minlength=n).astype(np.int64) if n else np.zeros(0, np.int64),
        np.diff(repeated[words.rows]),
        rows,
        features,
        chars,
    )


def _lanes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains from the longest to the shortest, and how many are as long as each step."""
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    longest = int(size.max()) if len(size) else 0
    live = len(order) - np.searchsorted(size[order][::-1], np.arange(longest), side="right")
    return order, rows[:-1][order], live


def viterbi(emission: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best labels (True: content). ``emission`` is the log odds of content per line, ``pairs[a, b]`` the score of b after a."""
    out = np.zeros(len(emission), dtype=bool)
    order, first, live = _lanes(rows)
    if not len(order):
        return out
    best = np.zeros((len(order), 2))
    best[:, 1] = emission[first]
    back = np.zeros((len(emission), 2), dtype=bool)
    for t in range(1, len(live)):
        m = live[t]
        here = first[:m] + t
        b = best[:m]
        to0, to1 = b + pairs[:, 0], b + pairs[:, 1]
        back[here, 0], back[here, 1] = to0[:, 1] > to0[:, 0], to1[:, 1] > to1[:, 0]
        best[:m, 0], best[:m, 1] = to0.max(axis=1), to1.max(axis=1) + emission[here]
    label = best[:, 1] > best[:, 0]
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        here = first[:m] + t
        out[here] = label[:m]
        if t:
            label[:m] = np.where(label[:m], back[here, 1], back[here, 0])
    return out


def _gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the mean log likelihood of labels ``y``, by forward-backward over all chains at once."""
    emission, pairs = x @ theta[:_N], theta[_N:].reshape(2, 2)
    order, first, live = _lanes(rows)
    n = len(emission)
    score = np.stack([np.zeros(n), emission], axis=1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[first] = score[first]
    for t in range(1, len(live)):
        here = first[: live[t]] + t
        a = alpha[here - 1][:, :, None] + pairs
        alpha[here] = np.logaddexp(a[:, 0], a[:, 1]) + score[here]
    for t in range(len(live) - 1, 0, -1):
        here = first[: live[t]] + t
        b = (beta[here] + score[here])[:, None, :] + pairs
        beta[here - 1] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    p1 = np.exp(both[:, 1] - total)
    grad = np.zeros(_N + 4)
    grad[:_N] = x.T @ (y - p1)
    later = np.ones(n, dtype=bool)
    later[rows[:-1][np.diff(rows) > 0]] = False
    at_ = np.flatnonzero(later)
    joint = np.exp(alpha[at_ - 1][:, :, None] + pairs + (beta[at_] + score[at_])[:, None, :] - total[at_][:, None, None]).sum(axis=0)
    seen = np.bincount(y[at_ - 1].astype(int) * 2 + y[at_].astype(int), minlength=4)
    grad[_N:] = seen - joint.ravel()
    return grad


def fit(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = TRAIN_STEPS) -> np.ndarray:
    """Weights for lines ``x`` with labels ``y`` in chains ``rows``; the prior's where there is nothing to learn from."""
    theta, m, v = PRIOR.copy(), np.zeros(_N + 4), np.zeros(_N + 4)
    if not len(x) or y.min() == y.max():
        return theta
    for i in range(1, steps + 1):
        g = (_gradient(theta, x.astype(float), y.astype(float), rows) - PRIOR_STRENGTH * (theta - PRIOR)) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return theta


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in at.each_text(batches):
        got = lines_of(raw, offsets)
        take = np.flatnonzero((np.diff(got.rows) > 0) & (np.diff(got.rows) <= TRAIN_LINES))
        blobs = [got.features[got.rows[i] : got.rows[i + 1]].astype(np.float16).tobytes() for i in take]
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(take)), batch.column("quality").take(pa.array(take)), pa.array(blobs, pa.binary())], names=["doc", "quality", "lines"])


def chains(good: list[np.ndarray], bad: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training lines, labels and chains.

    Every other document of the label that has more of them is joined with one of the other label, before or after it,
    which are taken in turn, again and again; all other documents are chains of their own.
    """
    (rich, y), (scarce, z) = sorted(((good, 1), (bad, 0)), key=lambda x: -len(x[0]))
    joined = rich[1::2] if scarce else []
    parts = [[(x, y)] for x in (rich[::2] if scarce else rich)] + [[(x, z)] for x in scarce]
    parts += [[(r, y), (s, z)] if k % 2 else [(s, z), (r, y)] for k, (r, s) in enumerate(zip(joined, cycle(scarce), strict=False))]
    if not parts:
        return np.zeros((0, _N)), np.zeros(0), np.zeros(1, np.int64)
    lines = np.concatenate([x for p in parts for x, _ in p])
    labels = np.concatenate([np.full(len(x), label) for p in parts for x, label in p])
    return lines, labels, np.r_[0, np.cumsum([sum(len(x) for x, _ in p) for p in parts])]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """CRF weights from at most ``train_docs`` labelled documents of each label."""
    clear_of(labels, id_col, label_col)
    ident, label = named(id_col), named(label_col)
    known = labels.where(ident.isNotNull() & label.isNotNull()).groupBy(ident.alias("doc")).agg((F.min(label) > 0).cast("int").alias("quality"))
    order = [F.xxhash64("doc"), F.col("doc")]
    sample = known.where("quality = 1").sort(*order).limit(train_docs).unionByName(known.where("quality = 0").sort(*order).limit(train_docs))
    # an id that repeats takes one of its texts, so that the sample stays bounded
    texts = docs.select(ident.alias("doc"), named(text_col).alias("text")).join(F.broadcast(sample), "doc")
    rows = texts.mapInArrow(_train_rows, f"doc {docs.schema[id_col].dataType.simpleString()}, quality int, lines binary").groupBy("doc", "quality").agg(F.min("lines").alias("lines"))
    got = sorted(rows.collect(), key=lambda r: (zlib.crc32(r.lines), r.lines))
    blocks = [[np.frombuffer(r.lines, np.float16).astype(np.float32).reshape(-1, _N) for r in got if r.quality == y] for y in (1, 0)]
    return fit(*chains(*blocks))


def _verdicts(theta: np.ndarray, share: float):
    pairs = theta[_N:].reshape(2, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in at.each_text(batches, limit=CHUNK_BYTES):
            got = lines_of(raw, offsets)
            content = viterbi(got.features @ theta[:_N], got.rows, pairs)
            inside = np.diff(np.r_[0, np.cumsum(np.where(content, got.chars, 0))][got.rows])
            part = inside / np.maximum(1, got.word_chars)
            failed = (got.n_words < MIN_WORDS) | (100 * got.n_repeat_words > MOST_REPEATED * got.n_words)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array(x, pa.int64()) for x in (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words)]
            cols += [pa.array(failed), pa.array(~failed & (part >= share)), pa.array(np.diff(got.rows), pa.int64()), pa.array(part, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_share"])

    return run


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = CONTENT_SHARE, theta: np.ndarray | None = None) -> DataFrame:
    """Per row: id, base counts, base_failed, kept, n_lines and content_share."""
    clear_of(docs, id_col, text_col)
    theta = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col) if theta is None else theta
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"
    return docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).mapInArrow(_verdicts(theta, share), schema).withColumnRenamed("doc", id_col)


def _passing(theta: np.ndarray, share: float, text_col: str):
    pairs = theta[_N:].reshape(2, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in at.each_text(batches, text_col, CHUNK_BYTES, of="row"):
            got = lines_of(raw, offsets)
            content = viterbi(got.features @ theta[:_N], got.rows, pairs)
            inside = np.diff(np.r_[0, np.cumsum(np.where(content, got.chars, 0))][got.rows])
            stay = (got.n_words >= MIN_WORDS) & (100 * got.n_repeat_words <= MOST_REPEATED * got.n_words) & (inside / np.maximum(1, got.word_chars) >= share)
            yield batch.filter(pa.array(stay))

    return run


def passing(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    clear_of(docs, id_col, text_col)
    theta = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = packed(docs)
    kept = rows.mapInArrow(_passing(theta, share, text_col), rows.schema)
    return unpacked(kept, docs)
