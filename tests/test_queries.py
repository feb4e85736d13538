"""Every registered core query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from kinespark.plans import catalog_queries as C

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = C.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    got = duck.execute(C.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in got.fetchall())
    assert mine == theirs


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert set(C.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["segment_frames", "sampled_frames"])
def test_frames_on_a_clock_take_one_scan_and_one_shuffle(spark, name):
    plan = C.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
