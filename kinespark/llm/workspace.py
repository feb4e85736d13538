"""Where intermediate results go, the folder that all executors share; and rows carried whole past other columns' names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder on a local master and an error on a cluster."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        place = tempfile.mkdtemp(prefix="kinespark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: its lineage ends there, so a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _keep(file.get())
    return kept


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, in columnar files: for wide rows.

    Spark deletes the shuffle files of what was computed only once the driver's garbage is collected, so that is asked
    for; what refers to them goes in the first round, they in a later one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _keep(path)
    df.write.parquet(path)
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.1)
    return spark.read.schema(df.schema).parquet(path)


def _keep(path: str) -> None:
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.append(path)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone, with its files out of reach
        release()


def made() -> int:
    """A mark for ``release``: what was written up to now."""
    return len(_MADE)


def release(since: int = 0, until: int | None = None) -> None:
    """Delete what ``cut`` and ``stored`` wrote between two marks; all of it when the process ends.

    Results that read those files can't be computed after this.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _MADE[since:until]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    del _MADE[since:until]


def named(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """One struct column ``row`` that holds the whole row, so that no name of it meets a helper's."""
    return df.select(F.struct(*map(named, df.columns)).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``packed``, with the columns of ``like``."""
    return df.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def row_hash(like: DataFrame) -> Column:
    """A hash of the columns of ``row`` that can be hashed."""
    kinds = {f.name: f.dataType.simpleString() for f in like.schema}
    return F.xxhash64(*(F.col("row").getField(c) for c, k in kinds.items() if "map<" not in k and "variant" not in k))


def clear_of(df: DataFrame, *names: str) -> None:
    """Refuse columns that are missing, with a message that names them."""
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def groups_for(df: DataFrame, text_col: str, bytes_each: int, least: int = 8) -> int:
    """A number of hash groups that follows the bytes of the texts, so that a group's size doesn't."""
    total = df.agg(F.sum(F.octet_length(named(text_col)))).first()[0] or 0
    return max(least, -(-total // bytes_each))
