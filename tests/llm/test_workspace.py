"""Where intermediate tables go, and when they are deleted."""

import os
from types import SimpleNamespace

import pytest

from kinespark.llm import workspace


def session(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: named if k == "spark.checkpoint.dir" else d))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace.shared_dir(session(master))
        assert workspace.shared_dir(session(master, "hdfs://shared")) == "hdfs://shared"
    assert os.path.isdir(workspace.shared_dir(session("local[4]"))) and workspace.shared_dir(session("local", "/named")) == "/named"


def test_what_was_written_is_released(spark):
    since = workspace.made()
    one, two = workspace.stored(spark.range(5)), workspace.cut(spark.range(7).selectExpr("id * 2 AS x"))
    between = workspace.made()
    three = workspace.stored(spark.range(3))
    paths = [p.removeprefix("file:") for p in workspace._MADE[since:]]
    assert len(paths) == 3 and all(map(os.path.exists, paths)) and one.count() == 5 and two.count() == 7
    workspace.release(since, between)
    assert [os.path.exists(p) for p in paths] == [False, False, True] and three.count() == 3 and workspace.made() == since + 1
    workspace.release(since)
    assert not os.path.exists(paths[2])


def test_rows_are_packed_whole(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 'x' AS row, map('k', 1) AS m, array(1, 2) AS __h")
    back = workspace.unpacked(workspace.packed(df), df)
    assert back.schema == df.schema and back.collect() == df.collect()
    assert workspace.packed(df).select(workspace.row_hash(df)).first()[0] is not None
    with pytest.raises(ValueError, match="missing"):
        workspace.clear_of(df, "nothing")
