"""The row-wise operators over streams: same expressions, no state, so any output mode that appends works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sampling import sample_indexes
from ..operators.matching import match_hands
from ..operators.segments import doubtful


def episodes_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of episodes as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def with_samples(episodes: DataFrame, *, length: str = "length", max_frames: int = 8) -> DataFrame:
    return episodes.withColumn("sample_indexes", sample_indexes(length, max_frames))


def flagged(episodes: DataFrame, *, rewards: str = "rewards", threshold: float = 0.5) -> DataFrame:
    return doubtful(episodes, rewards, threshold)


def matched(frames: DataFrame, *, hands: str = "hands", state: str = "state", extrinsics: str = "extrinsics") -> DataFrame:
    return frames.withColumn("match", match_hands(hands, state, extrinsics))


def detection_rate(frames: DataFrame, *, time: str, window: str = "1 minute", late: str = "5 minutes", match: str = "match") -> DataFrame:
    """Detection rate by event-time window of an already matched stream; rows later than ``late`` are dropped by the watermark."""
    score = F.col(match)
    total = frames.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(F.sum(score.getField("n_gt")).alias("n_gt"), F.sum(score.getField("n_matched")).alias("n_matched"))
    return total.select("window", "n_gt", "n_matched", F.when(F.col("n_gt") > 0, 100.0 * F.col("n_matched") / F.col("n_gt")).otherwise(0.0).alias("detect"))
