"""Subword encoding and decoding with a SentencePiece vocabulary.

An Aho-Corasick automaton over the pieces reads a text once. At each position it gives,
along its output links, every piece that ends there, and each of these relaxes the best
score of that position: a Viterbi search for the segmentation of greatest total score.
A character that no piece covers costs ten below the lowest score and becomes its UTF-8
byte pieces. No piece has a space after another character, so a text falls into
independent parts at each space that follows one, and recent parts are remembered, up to a
fixed number per worker.

Encoding is lossless: pieces mark a space as U+2581, the text keeps its own characters, so
a literal U+2581 goes to bytes and decoding gives back the exact text.

Defined results: a null text has null ids and no pieces; an empty text has no pieces;
parts of any length are read in one pass with memory in proportion to the part; of
segmentations of equal score, the one whose last piece is longer; repeated rows get equal
results; an empty table gives an empty table; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from .workspace import clear_of, named

REMEMBERED = 120_000  # parts, twice, per worker
LONGEST_REMEMBERED = 48
UNKNOWN_COST = 10
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_PART = re.compile(r" *[^ ]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def load(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a model file."""
    out = []
    for field, value in _fields(open(path, "rb").read()):
        if field == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode("utf-8"), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0]), piece.get(3, _NORMAL)))
    return out


class Codec:
    """Encoder and decoder for a list of (piece, score, kind)."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        scores = [s for _, s, k in pieces if k == _NORMAL]
        self.unknown = (min(scores) if scores else 0.0) - UNKNOWN_COST
        top = max(scores, default=0.0)
        for i, (piece, score, kind) in enumerate(pieces):
            text = piece.replace("▁", " ")
            if kind == _BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
                continue
            self.out.append(text.encode("utf-8") if kind in (_NORMAL, _USER, _UNUSED) else b"")
            if kind in (_NORMAL, _USER):
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} has a space inside, parts of a text wouldn't be independent")
                self.automaton.add_word(text, (len(text), len(text) * top - 0.1 if kind == _USER else score, i))
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        """Ids, as 32-bit integers, of one part."""
        n = len(text)
        worst = -1e300
        if n < 4096:
            best, size, piece = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        else:
            best, size, piece = array("d", [worst]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        done, unknown = 0, self.unknown
        for last, (k, score, i) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:  # positions before this one have all their pieces: close gaps with single characters
                done += 1
                if size[done] != 1 and best[done - 1] + unknown > best[done]:
                    best[done], size[done], piece[done] = best[done - 1] + unknown, 1, -1
            got = best[end - k] + score
            if got > best[end]:
                best[end], size[end], piece[end] = got, k, i
            if k == 1:
                done = end  # a single piece covers it: no unknown character here
        while done < n:
            done += 1
            if best[done - 1] + unknown > best[done]:
                best[done], size[done], piece[done] = best[done - 1] + unknown, 1, -1
        ids, end = [], n
        while end > 0:
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[end - 1].encode("utf-8", "surrogatepass")))
            end -= size[end]
        ids.reverse()
        return array("i", ids).tobytes()

    def _miss(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = self.part(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers."""
        if not text:
            return b""
        parts = _PART.findall(" " + text)
        got = list(map(self.young.get, parts))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.young.get(parts[i]) or self._miss(parts[i])
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text whose ids, as 32-bit integers, are given."""
        whole = b"".join(map(self.out.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return whole[1:] if whole[:1] == b" " else whole


_SHARED: dict[int, Codec] = {}


def _codec(pieces: list[tuple[str, float, int]]) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Codec(pieces)
    return _SHARED[key]


def _encoded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch, _, _ in at.each_text(batches):
            codec = codec or _codec(vocabulary.value)
            texts = batch.column("text").to_pylist()
            got = [b"" if t is None else codec.encode(t) for t in texts]
            none = np.array([t is None for t in texts], dtype=bool)
            same = [None if t is None else codec.decode(g) == t.encode("utf-8") for t, g in zip(texts, got, strict=True)]
            size = np.array([len(g) // 4 for g in got], dtype=np.int64)
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            if none.any():
                ids = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[none, False]), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(size), ids, pa.array(same, pa.bool_())], names=["doc", "n_pieces", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pieces, ids, and whether decoding them gives the text back."""
    clear_of(docs, id_col, text_col)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).mapInArrow(_encoded(vocabulary), f"doc {kind}, n_pieces long, ids array<int>, round_trip boolean").withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, *, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text; null ids give a null text."""
    clear_of(encoded, id_col, ids_col)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or _codec(vocabulary.value)
            texts = [None if x is None else codec.decode(array("i", x).tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "text"])

    return encoded.select(named(id_col).alias("doc"), named(ids_col).alias("ids")).mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", id_col)
