"""Robot datasets kept as Parquet: frame tables under ``data/``, episode tables under ``meta/episodes/``, videos beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import named
from . import schemas as S
from .readers import AvDecoder, clocked

VIDEO_PATH = "videos/{key}/chunk-{chunk:03d}/file-{file:03d}.mp4"


def read_episodes(spark: SparkSession, root: str, *, include_video_metadata: bool = False, video_path: str = VIDEO_PATH) -> DataFrame:
    """One row per episode. With video metadata, each camera also gets ``videos/<key>/video``, the file that holds its frames."""
    episodes = spark.read.option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/meta/episodes")
    keys = [c.split("/")[1] for c in episodes.columns if c.startswith("videos/") and c.endswith("/from_timestamp")]
    if not include_video_metadata:
        return episodes.select(*(named(c) for c in episodes.columns if not c.startswith("videos/")))
    pattern = video_path.replace("{chunk:03d}", "%03d").replace("{file:03d}", "%03d")
    for key in keys:
        place = F.format_string(f"{root.rstrip('/')}/" + pattern.replace("{key}", key), named(f"videos/{key}/chunk_index"), named(f"videos/{key}/file_index"))
        episodes = episodes.withColumn(f"videos/{key}/video", place)
    return episodes


def read(spark: SparkSession, root: str, *, load_video_frames: str | None = None, decoder=None, video_path: str = VIDEO_PATH) -> DataFrame:
    """One row per frame; with ``load_video_frames`` the camera's frame is decoded into a column of that name.

    The frames of an episode go to one task in order of their number, and its segment of the video is decoded once, up
    to the last frame that is asked for; one image is held at a time. A null video or number gives a null image, a
    number beyond the segment is an error. Limit or filter before decoding, with ``decoded``, where few are wanted.
    """
    frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/data")
    if load_video_frames is None:
        return frames
    episodes = read_episodes(spark, root, include_video_metadata=True, video_path=video_path)
    return decoded(frames, episodes, load_video_frames, decoder=decoder)


def decoded(frames: DataFrame, episodes: DataFrame, key: str, *, decoder=None) -> DataFrame:
    """``frames`` (episode_index, frame_index, ...) with the image of camera ``key``, by the episodes' video metadata."""
    decoder = decoder or AvDecoder()
    where = episodes.select(named("episode_index").alias("episode"), *(named(f"videos/{key}/{x}").alias(x) for x in ("video", "from_timestamp", "to_timestamp")))
    whole = F.struct(*map(named, frames.columns)).alias("row")
    rows = frames.select(whole, named("episode_index").alias("episode"), named("frame_index").alias("number")).join(where, "episode")
    # one clock an episode: its rows side by side, in order
    dealt = rows.repartition("episode").sortWithinPartitions("episode", "number")
    out = T.StructType([*frames.schema.fields, T.StructField(key, S.IMAGE)])
    image = to_arrow_type(S.IMAGE)
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at, clock, last = None, None, iter(()), None
        for batch in batches:
            asked = zip(*(batch.column(c).to_pylist() for c in ("episode", "video", "from_timestamp", "to_timestamp", "number")), strict=True)
            for k, (episode, video, start, end, number) in enumerate(asked):
                if video is None or number is None:
                    pixels = None
                else:
                    if (episode, video) != open_ or number < at:
                        open_, at, clock, last = (episode, video), -1, clocked(decoder, video, start, end), None
                    while at < number:
                        at, _, last = next(clock, (None, None, None))
                        if at is None:
                            raise ValueError(f"frame {number} isn't in [{start}, {end}) of {video}")
                    pixels = last
                mine = None if pixels is None else {"height": pixels.shape[0], "width": pixels.shape[1], "nChannels": 3, "mode": "RGB", "data": np.ascontiguousarray(pixels, np.uint8).tobytes()}
                kept = batch.slice(k, 1).column("row")
                yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array([mine], image)], names=[*names, key])

    return dealt.mapInArrow(run, out)
