"""Language identification of documents that may mix languages.

A language is a distribution over hashed byte trigrams, counted over all training
documents. A word's likelihood under a language is the product over its trigrams, and a
document is a mixture: each word comes from one language, drawn with the document's
proportions. Expectation-maximisation estimates the proportions; the set of languages is
grown from the best single one while the penalised log likelihood rises, where each
further language costs ``PENALTY`` and half the log of the number of words. The prediction
is the language with the largest proportion, the score is that proportion. The model is
``BUCKETS`` numbers a language, broadcast once.

Training sees text and language of documents whose crc32(id) modulo ``FOLDS`` isn't
``HELD_OUT``; language, source and id take no part in a prediction.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every
text if no document can be learned from; ties go to the language that sorts first; repeated
rows get equal results; a text of any length is read whole; an empty table gives an empty
table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import clear_of, named

FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 16
PENALTY = 6.0
EM_STEPS = 30
SMOOTH = 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def trigrams(raw: np.ndarray, words: at.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words with a space at both ends, and where each word's begin."""
    size = words.ends - words.starts  # a word of n bytes has n trigrams, centred on its bytes
    ptr = np.r_[0, np.cumsum(size)]
    if not len(size):
        return np.zeros(0, np.uint32), ptr
    low = np.zeros(len(raw) + 2, dtype=np.uint32)
    low[1:-1] = _FOLD[raw]
    low[1:-1][at.SPACE[raw]] = 0x20
    low[0] = low[-1] = 0x20
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    # a word at the edge of a row borders on the next row: its outer byte counts as a space
    inner = ~at.SPACE[raw]
    code_of = code[inner]
    first, last = ptr[:-1], ptr[1:] - 1
    code_of[first] = (code_of[first] & 0x00FFFF) | (0x20 << 16)
    code_of[last] = (code_of[last] & 0xFFFF00) | 0x20
    return ((code_of * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint32), ptr


def has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script; only rows without an ASCII letter take the slower look."""
    seen = np.diff(np.r_[0, np.cumsum(_LETTER[raw])][offsets]) > 0
    rest = np.flatnonzero(~seen & (np.diff(offsets) > 0))
    if len(rest):
        seen[rest] = pc.fill_null(pc.match_substring_regex(column.take(pa.array(rest)), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    return seen


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch, raw, offsets in at.each_text(batches):
        words = at.split(raw, offsets)
        codes, ptr = trigrams(raw, words)
        langs = batch.column("lang").dictionary_encode()
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        names = langs.dictionary.to_pylist()
        lang = np.repeat(of_row[words.row_of()], np.diff(ptr)) if len(words.starts) else np.zeros(0, np.int64)
        for k, name in enumerate(names):
            total[name] = total.get(name, 0) + np.bincount(codes[lang == k], minlength=BUCKETS)
    for name, c in total.items():
        at_ = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at_), pa.string()), pa.array(at_, pa.int32()), pa.array(c[at_], pa.int64())], names=["lang", "bucket", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (bucket, language). What comes to the driver is at most ``BUCKETS`` counts a language."""
    clear_of(docs, id_col, text_col, lang_col)
    learn = docs.where(named(lang_col).isNotNull() & named(text_col).isNotNull() & ~F.coalesce(held_out(named(id_col)), F.lit(False)))
    rows = learn.select(named(lang_col).cast("string").alias("lang"), named(text_col).alias("text")).mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    table = np.full((len(langs), BUCKETS), SMOOTH)
    index = {x: i for i, x in enumerate(langs)}
    table[[index[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def _sum_rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])[rows], axis=0)


def mixture(like: np.ndarray, rows: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (row, language) and log likelihood of each row, for word log likelihoods ``like``."""
    n, k = len(rows) - 1, like.shape[1]
    row = np.repeat(np.arange(n), np.diff(rows))
    top = like.max(axis=1, keepdims=True)
    odds = np.exp(like - top)
    theta = np.full((n, k), 1 / k)
    count = np.maximum(1, np.diff(rows))[:, None]
    for _ in range(steps):
        share = odds * theta[row]
        theta = _sum_rows(share / share.sum(axis=1, keepdims=True), rows) / count
    fit = np.log(np.maximum((odds * theta[row]).sum(axis=1, keepdims=True), 1e-300)) + top
    return theta, _sum_rows(fit, rows)[:, 0]


def identify(like: np.ndarray, rows: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its proportion, and the number of languages of each row.

    The log likelihood is concave in the proportions, so a further language gains at most its slope at proportion zero,
    the sum over words of p(word | language) / p(word | mixture) - 1. Expectation-maximisation runs only for rows and
    languages whose slope exceeds the cost.
    """
    n, k = len(rows) - 1, like.shape[1]
    single = _sum_rows(like, rows)
    chosen = np.zeros((n, k), dtype=bool)
    best = single.argmax(axis=1)
    chosen[np.arange(n), best] = True
    value, share = single[np.arange(n), best], np.ones(n)
    cost = penalty + 0.5 * np.log(np.maximum(1, np.diff(rows)))
    mixed = np.take_along_axis(like, np.repeat(best, np.diff(rows))[:, None], axis=1)[:, 0] if len(like) else np.zeros(0)
    open_ = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(open_):
        take = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in open_]) if len(open_) < n else slice(None)
        ptr = np.r_[0, np.cumsum(np.diff(rows)[open_])]
        part, base = like[take], mixed[take]
        slope = _sum_rows(np.exp(np.minimum(part - base[:, None], 500.0)) - 1.0, ptr)
        may_gain = (slope > cost[open_, None]) & ~chosen[open_]
        gain, add = np.zeros(len(open_)), np.full(len(open_), -1)
        theta_of = np.zeros((len(open_), k))
        for extra in range(k):
            who = np.flatnonzero(may_gain[:, extra])
            if not len(who):
                continue
            mine = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in who])
            sub = np.r_[0, np.cumsum(np.diff(ptr)[who])]
            allowed = chosen[open_[who]].copy()
            allowed[:, extra] = True
            theta, fit = mixture(np.where(np.repeat(allowed, np.diff(sub), axis=0), part[mine], -1e9), sub)
            up = fit - value[open_[who]] - cost[open_[who]]
            better = up > gain[who]
            gain[who[better]], add[who[better]], theta_of[who[better]] = up[better], extra, theta[better]
        win = np.flatnonzero(add >= 0)
        who = open_[win]
        chosen[who, add[win]] = True
        value[who] += gain[win] + cost[who]
        best[who], share[who] = theta_of[win].argmax(axis=1), theta_of[win].max(axis=1)
        for i, row in zip(win, who, strict=True):
            x = part[ptr[i] : ptr[i + 1]]
            top = x.max(axis=1)
            mixed[rows[row] : rows[row + 1]] = np.log(np.maximum(np.exp(x - top[:, None]) @ theta_of[i], 1e-300)) + top
        open_ = who[chosen[who].sum(axis=1) < k]
    return best, share, chosen.sum(axis=1)


def _predictions(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        names = np.array([*langs, "und"], dtype=object)
        for batch, raw, offsets in at.each_text(batches):
            words = at.split(raw, offsets)
            codes, ptr = trigrams(raw, words)
            known = has_letter(batch.column("text"), raw, offsets) & bool(langs)
            like = np.zeros((len(words.starts), max(1, len(langs))))
            if len(codes) and langs:
                for j in range(len(langs)):
                    like[:, j] = np.add.reduceat(table[:, j][codes].astype(np.float64), ptr[:-1])
            best, share, kinds = identify(like, words.rows, penalty)
            best = np.where(known, best, len(langs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.where(known, np.clip(share, 0, 1), 0.0)), pa.array(np.where(known, kinds, 0), pa.int32())],
                names=["doc", "held_out", "lang_pred", "score", "n_langs"],
            )

    return run


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY) -> DataFrame:
    """Per row: id, held_out, lang_pred, score and the number of languages found."""
    langs, table = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(table)))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(named(id_col).alias("doc"), F.coalesce(held_out(named(id_col)), F.lit(False)).alias("held_out"), named(text_col).alias("text"))
    return asked.mapInArrow(_predictions(model, penalty), f"doc {kind}, held_out boolean, lang_pred string, score double, n_langs int").withColumnRenamed("doc", id_col)
