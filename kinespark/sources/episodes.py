"""Lazy episode catalog of an extracted release, its trajectories and camera frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.attributes import plain
from ..functions.columns import file_uri, named, parent_dir, stem, with_suffix
from . import schemas as S
from .readers import AvDecoder, Hdf5Reader, resized

_HEAD = ["task", "episode_id", "metadata"]
Names = str | Sequence[str] | None
Numbers = int | Sequence[int] | None
Limit = float | None
Side = int | None


def _listed(x, kind: type) -> list | None:
    return x if x is None else [x] if isinstance(x, kind) else list(x)


def raw(spark: SparkSession, path: str, *, reader=None, episode_ids: Numbers = None, tasks: Names = None, suffix: str = ".hdf5", video_suffix: str = ".mp4", options: dict[str, str] | None = None) -> DataFrame:
    """One row per episode file under ``path``: task, episode_id, metadata, trajectory, video.

    ``path`` is the release, a split or one task directory. The files are listed once,
    without reading them; a video is the sibling of the same name, null if absent, found
    by a join on the name rather than a look at the store per row. ``tasks`` and
    ``episode_ids`` filter before any file is opened; None doesn't filter and an empty list
    keeps nothing. A file whose stem isn't a number fails the cast, as it should not be
    there. Names that start with ``_`` or ``.`` are skipped, as by any Spark listing.
    ``options`` go to the listing; what opens the files in workers is the reader's ``Store``.
    """
    tasks, episode_ids = _listed(tasks, str), _listed(episode_ids, int)
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*{{{suffix},{video_suffix}}}", **(options or {})).load(path.rstrip("/")).select(file_uri("path").alias("path"))
    videos = found.where(F.col("path").endswith(video_suffix)).select(F.col("path").alias("video"))
    episodes = found.where(F.col("path").endswith(suffix)).select(F.col("path").alias("trajectory"), parent_dir("path").alias("task"))
    if tasks is not None:
        episodes = episodes.where(F.col("task").isin(tasks))
    episodes = episodes.withColumn("episode_id", stem("trajectory").cast("long"))
    if episode_ids is not None:
        episodes = episodes.where(F.col("episode_id").isin(episode_ids))
    joined = episodes.join(videos, with_suffix("trajectory", suffix, video_suffix) == F.col("video"), "left")
    return joined.withColumn("metadata", _metadata(reader)("trajectory")).select(*_HEAD, "trajectory", "video")


def _metadata(reader):
    kind = to_arrow_type(S.METADATA)

    @F.arrow_udf(S.METADATA)
    def read(uris: Iterator[pa.Array]) -> Iterator[pa.Array]:
        files = reader or Hdf5Reader()
        for batch in uris:
            rows = []
            for uri in batch.to_pylist():
                given = files.attributes(uri)
                row = {f.name: plain(given.get(f.name)) for f in S.METADATA.fields}
                rows.append({k: v if v is not None or k not in S.LIST_ATTRIBUTES else [] for k, v in row.items()})
            yield pa.array(rows, kind)

    return read


def trajectory(episodes: DataFrame, fields: Sequence[str] = S.DEFAULT_TRAJECTORY_FIELDS, *, reader=None) -> DataFrame:
    """The chosen arrays of each episode as nested columns: task, episode_id, metadata, one column per field, video.

    Filter and limit before: files are opened once per row that is left. Rows without a trajectory are dropped.
    """
    reader = reader or Hdf5Reader()
    if "trajectory" not in episodes.columns:
        raise ValueError(f"trajectory is not among the columns {episodes.columns}")
    fields = (*fields,)
    if len(fields) == 0:
        raise ValueError("at least one field is needed")
    if unknown := [f for f in fields if f not in S.TRAJECTORY_FIELDS]:
        raise ValueError(f"Unknown trajectory fields: {unknown}")
    struct = T.StructType([T.StructField(f, S.trajectory_type(f)) for f in fields])
    kind = to_arrow_type(struct)

    @F.arrow_udf(struct)
    def read(uris: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in uris:
            yield pa.array([{k: v.astype("float32").tolist() for k, v in reader.arrays(u, fields).items()} for u in batch.to_pylist()], kind)

    return episodes.where(F.col("trajectory").isNotNull()).withColumn("__read", read("trajectory")).select(*_HEAD, *(named("__read").getField(f).alias(f) for f in fields), "video")


def _chosen(decoder, uri: str, start_time: float, end_time: Limit, interval: Limit, is_key_frame: bool | None, width: Side, height: Side) -> Iterator[tuple[float, dict]]:
    """(seconds, image) of the frames that are asked for, one at a time."""
    due = start_time
    for t, image, key in decoder.frames(uri, start_time):
        if t is None or t < start_time - 1e-6:
            continue
        if end_time is not None and t >= end_time - 1e-6:
            break
        if is_key_frame is not None and key != is_key_frame:
            continue
        if interval is not None:
            if t < due - 1e-6:
                continue
            due += interval * (1 + int((t - due + 1e-6) // interval))
        pixels = resized(image, width, height)
        yield t, {"height": pixels.shape[0], "width": pixels.shape[1], "nChannels": 3, "mode": "RGB", "data": pixels.astype("uint8").tobytes()}


def camera_frames(episodes: DataFrame, *, decoder=None, height: Side = None, width: Side = None, sample_interval_seconds: Limit = None, is_key_frame: bool | None = None, end_time: Limit = None, start_time: float = 0) -> DataFrame:
    """Adds ``video_frames``: the frames of each row's video in a time range, resized; empty without a video.

    ``is_key_frame`` keeps only key frames (True) or only others (False); with an interval, the first frame of each
    interval from ``start_time`` on is kept. All frames of a row lie in one cell, which can hold no more than 2 GB: for
    whole videos take ``frame_rows``.
    """
    decoder = decoder or AvDecoder()
    if "video" not in episodes.columns:
        raise ValueError(f"video is not among the columns {episodes.columns}")
    frames = T.ArrayType(S.IMAGE)
    kind = to_arrow_type(frames)

    def decode(uri: str | None) -> list[dict]:
        return [] if uri is None else [image for _, image in _chosen(decoder, uri, start_time, end_time, sample_interval_seconds, is_key_frame, width, height)]

    @F.arrow_udf(frames)
    def read(uris: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in uris:
            yield pa.concat_arrays([pa.array([decode(u)], kind) for u in batch.to_pylist()] or [pa.array([], kind)])

    return episodes.withColumn("video_frames", read("video"))


def frame_rows(episodes: DataFrame, *, decoder=None, height: Side = None, width: Side = None, sample_interval_seconds: Limit = None, is_key_frame: bool | None = None, end_time: Limit = None, start_time: float = 0) -> DataFrame:
    """One row per frame of ``camera_frames``: the columns of its episode, frame (from 0), timestamp_s and image.

    A worker holds one image at a time, whatever the length of a video; a row without a video has no frames.
    """
    decoder = decoder or AvDecoder()
    if "video" not in episodes.columns:
        raise ValueError(f"video is not among the columns {episodes.columns}")
    image = to_arrow_type(S.IMAGE)
    schema = T.StructType([*episodes.schema.fields, T.StructField("frame", T.LongType()), T.StructField("timestamp_s", T.DoubleType()), T.StructField("image", S.IMAGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri in enumerate(batch.column("video").to_pylist()):
                one = batch.slice(k, 1).column("row").flatten()
                for n, (t, pixels) in enumerate(_chosen(decoder, uri, start_time, end_time, sample_interval_seconds, is_key_frame, width, height) if uri is not None else ()):
                    yield pa.RecordBatch.from_arrays([*one, pa.array([n], pa.int64()), pa.array([t], pa.float64()), pa.array([pixels], image)], names=schema.names)

    return episodes.select(F.struct(*map(named, episodes.columns)).alias("row"), "video").mapInArrow(run, schema)
