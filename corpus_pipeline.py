"""Corpus pipeline over ``documents``: quality rules, near-dedup, substring dedup, mixing, encoding.

Each stage works on all that its predecessor kept, written as Parquet and read again, and all
but the last return the columns of ``documents``:

1. quality rules drop documents that the base rules or the line CRF reject;
2. near-dedup keeps one document of each class of equal or near-equal texts;
3. substring dedup takes repeated passages of 35 words or more out of the texts;
4. mixing repeats or drops documents so that sources meet their target weights;
5. encoding gives doc_id, n_pieces, ids and round_trip.

Defined results: rows keep their null columns throughout; a null or empty text is rejected by
the first stage, as are texts of fewer than 10 words; ids may be null, shared or of any type
that sorts, and rows repeated as a whole are equal copies, of which the second stage keeps
one; ties go as each operator's module says; a text of any length is read whole; empty tables
give an empty table. Extra columns, whatever their names, are carried along by the first four
stages. Without an ``n_chars`` column none is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import mixing, order_minhash, quality_crf, sentencepiece_codec, substring_dedup
from kinespark.llm.queries import MODEL
from kinespark.llm.workspace import made, named, release, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts lose repeated passages; ``n_chars`` follows the text."""
    left = substring_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return left
    kind = docs.schema["n_chars"].dataType
    return left.select(*(F.char_length("text").cast(kind).alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document occurs as many times as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, model=MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: No SQL can express training, alignment or Viterbi; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for _, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        behind = made()
        docs = stored(kept)
        release(before, behind)  # the stage's own tables and its input
        before = made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
