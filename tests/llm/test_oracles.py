"""The registered queries of the training-data operators against their DuckDB equivalents, and all of them against the contract's columns."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinespark.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    got = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in got.fetchall())


CONTRACT = {
    "op1_quality_crf": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_avi_mjpeg": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_every_query_runs_over_its_whole_table_with_the_columns_asked_for(spark, name):
    df = entry.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for part in CONTRACT.get(name, "doc_id bigint").split(", "):
        column, kind = part.split()
        assert kinds[column] == kind, (name, column)
    whole = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op7') else 'documents'}.parquet").count()
    assert df.count() == whole or name == "op3_license_scan"


def test_media_and_shards_are_recomputed_row_by_row(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op5_avi_mjpeg(spark, SF).collect():
        b = docs[r.doc_id].encode()
        payload = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for r in Q.op8_sharding(spark, SF).collect():
        b = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(b) + 8, zlib.crc32(b))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert all(r["size"] == len(word.findall(docs[r.doc_id])) for r in Q.op4_mixing(spark, SF).collect())
