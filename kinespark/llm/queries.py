"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi_mjpeg, language_id, license_scan, mixing, order_minhash, quality_crf, sentencepiece_codec, sharding, substring_dedup, url_filter


#: Vocabulary of ``op2_sentencepiece``, an argument of it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model=model)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).select("doc_id", "license", "containment")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.balance(_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_mjpeg.digest(_table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the canonical URLs of every page whose id is divisible by 20."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, pages.where("page_id % 20 = 0"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.judge(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1_quality_crf,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_avi_mjpeg": op5_avi_mjpeg,
    "op6_order_minhash": op6_order_minhash,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}
