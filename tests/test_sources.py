import io
import os
import sys
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle

from kinespark.functions.attributes import plain
from kinespark.sources import episodes as E
from kinespark.sources import frame_datasets as D
from kinespark.sources import schemas as S
from kinespark.sources.readers import Hdf5Reader, NpzDecoder, NpzReader, Store, resized, segment_frames

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't know this file

N = 4
HEAD = ["task", "episode_id", "metadata"]
READ = {"reader": NpzReader(), "suffix": ".npz"}


def episode(root, task, number, video=False, confidences=False):
    folder = root / task
    folder.mkdir(parents=True, exist_ok=True)
    data = {"camera/intrinsic": 736 * np.eye(3, dtype=np.float32), "@llm_description": np.array("Fold the towel."), "@llm_verbs": np.array(["fold"]), "@annotated": np.array(True)}
    data |= {f"transforms/{j}": np.stack([np.identity(4, "f4")] * N) for j in S.TRANSFORM_JOINTS}
    if confidences:
        data |= {f"confidences/{j}": np.linspace(0, 1, N, dtype=np.float32) for j in S.JOINTS}
    np.savez(folder / f"{number}.npz", **data)
    if video:
        clip(folder / f"{number}.mp4")


def clip(path, n=3, fps=30, size=(24, 32), step=64):
    frames = np.stack([np.full((*size, 3), step * i, np.uint8) for i in range(n)])
    with open(path, "wb") as f:
        np.savez(f, frames=frames, seconds=np.arange(n) / fps)


def test_catalog_rows_types_and_missing_video(spark, tmp_path):
    episode(tmp_path, "fold_towel", 0, video=True)
    episode(tmp_path, "stack_cups", 3)
    df = E.raw(spark, f"{tmp_path}/", **READ)
    assert df.columns == [*HEAD, "trajectory", "video"]
    assert df.schema["episode_id"].dataType.simpleString() == "bigint" and df.schema["metadata"].dataType == S.METADATA
    fold, cups = df.sort("task").collect()
    assert (fold.task, fold.episode_id) == ("fold_towel", 0)
    assert fold.trajectory == f"file://{tmp_path}/fold_towel/0.npz" and fold.video == f"file://{tmp_path}/fold_towel/0.mp4"
    assert cups.video is None and cups.episode_id == 3
    assert fold.metadata.llm_verbs == ["fold"] and fold.metadata.llm_objects == [] and fold.metadata.annotated is True and fold.metadata.type is None


def test_catalog_filters_before_files_open(spark, tmp_path):
    for task, number in (("fold_towel", 0), ("fold_towel", 1), ("stack_cups", 0)):
        episode(tmp_path, task, number)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "7.npz").write_bytes(b"not an archive")
    rows = E.raw(spark, str(tmp_path), episode_ids=[1], tasks="fold_towel", **READ).collect()
    assert [(r.task, r.episode_id) for r in rows] == [("fold_towel", 1)]
    assert E.raw(spark, str(tmp_path), tasks=[], **READ).count() == 0
    assert E.raw(spark, str(tmp_path), episode_ids=0, **READ).select("task").count() == 2


def test_trajectory_fields_and_shapes(spark, tmp_path):
    episode(tmp_path, "t", 0)
    catalog = E.raw(spark, str(tmp_path), **READ)
    got = E.trajectory(catalog, reader=NpzReader())
    assert got.columns == [*HEAD, *S.DEFAULT_TRAJECTORY_FIELDS, "video"]
    row = got.first()
    assert np.array(row["camera/intrinsic"]).shape == (3, 3) and np.array(row["transforms/leftHand"]).shape == (N, 4, 4)
    one = E.trajectory(catalog, ["transforms/hip"], reader=NpzReader())
    assert one.columns == [*HEAD, "transforms/hip", "video"]
    with pytest.raises(Exception, match="confidences"):
        E.trajectory(catalog, ["confidences/hip"], reader=NpzReader()).collect()


def test_trajectory_checks_its_arguments(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "trajectory string")
    for names, told in (([], "at least one"), (["transforms/tail"], "Unknown trajectory")):
        with pytest.raises(ValueError, match=told):
            E.trajectory(df, names, reader=NpzReader())
    with pytest.raises(ValueError, match="trajectory"):
        E.trajectory(df.drop("trajectory").selectExpr("1 AS x"), reader=NpzReader())


def test_camera_frames_resize_range_interval_and_null(spark, tmp_path):
    clip(tmp_path / "v.mp4")
    df = spark.createDataFrame([(0, f"file://{tmp_path}/v.mp4"), (1, None)], "id int, video string")
    rows = E.camera_frames(df, width=16, height=12, decoder=NpzDecoder()).sort("id").collect()
    assert [(f.height, f.width, f.data[0]) for f in rows[0].video_frames] == [(12, 16, 0), (12, 16, 64), (12, 16, 128)]
    assert rows[1].video_frames == []
    count = lambda **k: len(E.camera_frames(df, decoder=NpzDecoder(), **k).sort("id").first().video_frames)
    assert count(is_key_frame=True) == 1 and count(is_key_frame=False) == 2
    assert count(start_time=1 / 30) == 2 and count(end_time=1 / 30) == 1 and count(sample_interval_seconds=2 / 30) == 2
    with pytest.raises(ValueError, match="video"):
        E.camera_frames(df.select("id"), decoder=NpzDecoder())


def test_field_catalog():
    assert len(S.JOINTS) == 68 and len(S.TRAJECTORY_FIELDS) == 138 and list(S.JOINTS) == sorted(S.JOINTS)
    assert len(S.METADATA) == 16 and {f.name for f in S.METADATA if f.dataType.simpleString() == "array<string>"} == S.LIST_ATTRIBUTES


@pytest.mark.parametrize("given, want", [(None, None), (b"a\xff", "a�"), (np.array(b"x"), "x"), (np.array([[1, 2]]), [[1, 2]]), (np.float32(0.5), 0.5), ("s", "s"), (np.array([b"p", b"q"]), ["p", "q"])])
def test_attribute_values(given, want):
    assert plain(given) == want


def test_missing_packages_are_named():
    for name, make in (("h5py", Hdf5Reader),):
        try:
            __import__(name)
        except ImportError:
            with pytest.raises(ImportError, match=name):
                make()


def test_segment_clock(tmp_path):
    with open(tmp_path / "v", "wb") as f:
        np.savez(f, frames=np.arange(10, dtype=np.uint8)[:, None, None, None] * np.ones((1, 2, 2, 3), np.uint8), seconds=np.r_[np.nan, np.arange(9) / 10])
    frames, refs = segment_frames(NpzDecoder(), str(tmp_path / "v"), 0.2, 0.6, [0, 3])
    assert frames[:, 0, 0, 0].tolist() == [3, 6] and refs == [{"index": 0, "timestamp_s": 0.2}, {"index": 3, "timestamp_s": 0.5}]
    for want in ([4], []):
        with pytest.raises(ValueError, match="sampled frames"):
            segment_frames(NpzDecoder(), str(tmp_path / "v"), 0.2, 0.6, want)
    assert resized(np.zeros((4, 6, 3)), None, 2).shape == (2, 6, 3)


def test_frame_dataset(spark, tmp_path):
    (tmp_path / "videos/cam.top/chunk-000").mkdir(parents=True)
    clip(tmp_path / "videos/cam.top/chunk-000/file-000.mp4", n=5, fps=10, step=40)
    spark.createDataFrame([(0, i) for i in range(2)] + [(1, i) for i in range(3)], "episode_index long, frame_index long").write.parquet(f"{tmp_path}/data")
    spark.createDataFrame([(0, ["go"], 2, 0, 0, 0.0, 0.2), (1, ["a", "b"], 3, 0, 0, 0.2, 0.5)], "episode_index long, tasks array<string>, length long, `videos/cam.top/chunk_index` long, `videos/cam.top/file_index` long, `videos/cam.top/from_timestamp` double, `videos/cam.top/to_timestamp` double").write.parquet(f"{tmp_path}/meta/episodes")
    assert D.read_episodes(spark, str(tmp_path)).columns == ["episode_index", "tasks", "length"]
    video = D.read_episodes(spark, str(tmp_path), include_video_metadata=True).first()["videos/cam.top/video"]
    assert video == f"{tmp_path}/videos/cam.top/chunk-000/file-000.mp4"
    rows = D.read(spark, str(tmp_path), load_video_frames="cam.top", decoder=NpzDecoder()).sort("episode_index", "frame_index").collect()
    assert [r["cam.top"].data[0] for r in rows] == [0, 40, 80, 120, 160]
    assert D.read(spark, str(tmp_path)).columns == ["episode_index", "frame_index"]


@dataclass(frozen=True)
class Counting(NpzDecoder):
    """Notes each frame that it decodes in a file beside the video."""

    def frames(self, uri, start=0.0):
        for x in super().frames(uri, start):
            with open(f"{uri}.log", "a") as f:
                f.write("x")
            yield x


def test_each_segment_is_decoded_once(spark, tmp_path):
    (tmp_path / "videos/cam/chunk-000").mkdir(parents=True)
    video = tmp_path / "videos/cam/chunk-000/file-000.mp4"
    clip(video, n=60, fps=10, step=4)
    rows = [(0, i) for i in range(30)] + [(1, i) for i in (0, 7, 7, 29)] + [(2, 0), (0, None)]
    spark.createDataFrame(rows, "episode_index long, frame_index long").selectExpr("*", "'x' AS `a.b`").repartition(3).write.parquet(f"{tmp_path}/data")
    spark.createDataFrame([(0, 0, 0, 0.0, 3.0), (1, 0, 0, 3.0, 6.0), (2, None, 0, 0.0, 1.0)], "episode_index long, `videos/cam/chunk_index` long, `videos/cam/file_index` long, `videos/cam/from_timestamp` double, `videos/cam/to_timestamp` double").write.parquet(f"{tmp_path}/meta/episodes")
    frames = spark.read.parquet(f"{tmp_path}/data")
    meta = D.read_episodes(spark, str(tmp_path), include_video_metadata=True).selectExpr("*", f"CASE WHEN episode_index < 2 THEN '{video}' END AS v").drop("videos/cam/video").withColumnRenamed("v", "videos/cam/video")
    got = D.decoded(frames, meta, "cam", decoder=Counting())
    assert got.columns == ["episode_index", "frame_index", "a.b", "cam"]
    out = sorted(((r.episode_index, -1 if r.frame_index is None else r.frame_index), None if r.cam is None else r.cam.data[0]) for r in got.collect())
    want = sorted(((e, -1 if i is None else i), None if e == 2 or i is None else 4 * (30 * e + i)) for e, i in rows)
    assert out == want
    # each segment from its start to its last asked frame, once; the decoder starts a second before it
    assert os.path.getsize(f"{video}.log") <= 30 + 40
    with pytest.raises(Exception, match="isn't in"):
        D.decoded(spark.createDataFrame([(0, 30)], "episode_index long, frame_index long"), meta, "cam", decoder=NpzDecoder()).collect()


def test_frame_rows_are_the_frames_of_the_cells(spark, tmp_path):
    clip(tmp_path / "v.mp4", n=9, fps=10, step=20)
    df = spark.createDataFrame([(0, f"{tmp_path}/v.mp4", 1), (1, None, 2)], "id int, video string, `a.b` int")
    for asked in ({}, {"start_time": 0.2, "end_time": 0.7, "width": 8}, {"sample_interval_seconds": 0.3, "is_key_frame": False}):
        rows = E.frame_rows(df, decoder=NpzDecoder(), **asked).sort("frame").collect()
        cell = E.camera_frames(df, decoder=NpzDecoder(), **asked).where("id = 0").first().video_frames
        assert [r.image for r in rows] == cell and [r.frame for r in rows] == list(range(len(cell))) and {(r.id, r["a.b"]) for r in rows} == {(0, 1)}
    assert E.frame_rows(df.where("id = 1"), decoder=NpzDecoder()).count() == 0
    with pytest.raises(ValueError, match="video"):
        E.frame_rows(df.select("id"), decoder=NpzDecoder())


class Blob:
    """A file handle as an object store gives it."""

    def __init__(self, data):
        self.data = data

    def open(self):
        return io.BytesIO(self.data)


@dataclass(frozen=True)
class Remote(Store):
    """Names of one scheme, kept under a folder; needs its key."""

    def open(self, file):
        if str(file).startswith("mem://"):
            assert self.options["key"] == "secret"
            return super().open(self.options["root"] + str(file)[5:])
        return super().open(file)


def test_stores_open_paths_uris_handles_and_streams(spark, tmp_path):
    (tmp_path / "a b.npz").write_bytes(b"data")
    for given in (f"{tmp_path}/a b.npz", f"file://{tmp_path}/a%20b.npz", Blob(b"data"), io.BytesIO(b"data")):
        with Store().open(given) as f:
            assert f.read() == b"data"
    store = Store({"access_key": "secret"})
    assert "secret" not in repr(store) and "secret" not in repr(NpzReader(store))
    for uri in ("s3://bucket/x", "s3a://bucket/x"):  # the options are those of the filesystem
        with pytest.raises(TypeError, match="nonsense"):
            Store({"nonsense": 1}).open(uri)
    clip(tmp_path / "v", n=4)
    with open(tmp_path / "v", "rb") as f:
        frames, _ = segment_frames(NpzDecoder(), Blob(f.read()), 0.0, 1.0, [2])
    assert frames[0, 0, 0, 0] == 128
    episode(tmp_path, "t", 0)
    remote = Remote({"key": "secret", "root": str(tmp_path)})
    df = spark.createDataFrame([("t", 0, "mem:/t/0.npz".replace(":/", "://"), "mem://v")], "task string, episode_id long, trajectory string, video string").selectExpr("*", "null AS metadata")
    assert np.array(E.trajectory(df, ["transforms/hip"], reader=NpzReader(remote)).first()["transforms/hip"]).shape == (N, 4, 4)
    assert E.frame_rows(df, decoder=NpzDecoder(remote)).count() == 4
