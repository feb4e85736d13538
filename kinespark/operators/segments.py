"""Relational forms of segment-clocked frame selection, reward curves and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import as_column, last, named
from ..functions.sampling import sample_indexes

SLACK = 1e-6


def six_places(t: Column) -> Column:
    """Python's ``round(t, 6)`` of a double: to the nearest by its exact binary value, ties to even.

    Spark's own rounding goes by the shortest decimal form, which can lie on a tie that the binary value doesn't. Here
    the value is split into two halves of 26 bits, whose products with a million are exact, so the side of the tie is.
    """
    t = t.cast("double")
    wide = t * F.lit(134217729.0)
    high = wide - (wide - t)
    low = F.floor(t * F.lit(1e6)).cast("double")
    side = (high * F.lit(1e6) - (low + F.lit(0.5))) + (t - high) * F.lit(1e6)
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return F.when(F.abs(t) < 4e9, (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(1e6)).otherwise(t)


def on_clock(frames: DataFrame, *, key: str, time: str, from_ts: Column | str, to_ts: Column | str) -> DataFrame:
    """Frames in the bounds that each row carries, with ``index`` from 0 on the clock of its episode and ``timestamp_s``.

    A frame counts from ``from_ts`` on and before ``to_ts``, both less a microsecond; frames without a time are skipped.
    ``timestamp_s`` is rounded to six places as Python's ``round`` does, so that it equals what the decoding kernel
    reports. The one shuffle is by episode, and none if the frames already lie by it.
    """
    t = named(time)
    inside = frames.where(t.isNotNull() & (t >= as_column(from_ts) - SLACK) & (t < as_column(to_ts) - SLACK))
    place = F.row_number().over(W.partitionBy(named(key)).orderBy(t))
    return inside.withColumn("index", (place - 1).cast("long")).withColumn("timestamp_s", six_places(t))


def segment_frames(frames: DataFrame, episodes: DataFrame, *, key: str, time: str, from_ts: str, to_ts: str) -> DataFrame:
    """``on_clock`` with bounds from ``episodes``, a row per key; ``frames`` has a row per frame with its time in seconds."""
    bounds = episodes.select(named(key), named(from_ts).alias("__from"), named(to_ts).alias("__to"))
    return on_clock(frames.join(bounds, key), key=key, time=time, from_ts="__from", to_ts="__to").drop("__from", "__to")


def sampled(frames: DataFrame, *, length: Column | str, max_frames: int = 8) -> DataFrame:
    """Of frames with an ``index``, those among ``sample_indexes(length)``."""
    return frames.where(F.array_contains(sample_indexes(length, max_frames), F.col("index")))


def sampled_frames(frames: DataFrame, episodes: DataFrame, *, key: str, time: str, from_ts: str, to_ts: str, length: str, max_frames: int = 8) -> DataFrame:
    """The segment's frames whose index is among ``sample_indexes(length)``; one join brings bounds and length."""
    bounds = episodes.select(named(key), named(from_ts).alias("__from"), named(to_ts).alias("__to"), named(length).alias("__length"))
    placed = on_clock(frames.join(bounds, key), key=key, time=time, from_ts="__from", to_ts="__to")
    return sampled(placed, length="__length", max_frames=max_frames).drop("__from", "__to", "__length")


def reward_curve(episodes: DataFrame, rewards: Column | str = "rewards", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sampled frame: the kept columns, index, timestamp_s and reward_score; surplus scores or frames are cut."""
    r = as_column(rewards)
    pairs = F.slice(F.arrays_zip(r.getField("reward_frames").alias("frame"), r.getField("reward_score").alias("score")), 1, F.least(F.size(r.getField("reward_frames")), F.size(r.getField("reward_score"))))
    rows = episodes.select(*map(named, keep), F.explode(F.when(r.isNotNull(), pairs)).alias("__x"))
    x = rows["__x"]
    return rows.select(*map(named, keep), x.getField("frame").getField("index").alias("index"), x.getField("frame").getField("timestamp_s").alias("timestamp_s"), x.getField("score").alias("reward_score"))


def doubtful(episodes: DataFrame, rewards: Column | str = "rewards", threshold: float = 0.5) -> DataFrame:
    """Episodes whose final-frame success is below the threshold; those without scores are not among them.

    Where ``rewards`` comes from ``score_rewards``, persist it first or rely on that operator's single evaluation.
    """
    return episodes.where(last(as_column(rewards).getField("robometer_success")) < threshold)
