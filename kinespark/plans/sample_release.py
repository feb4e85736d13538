"""A small release on disk and a stand-in for the scoring server, for queries that need files and a service.

Files and answers follow from the tables, so that SQL over the same tables gives the expected rows: a nation is an
episode of the task that its region names; every third nation has no video.
"""

from __future__ import annotations

import io
import json
import tempfile
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
from pyspark.sql import SparkSession

FPS = 10
PLACE = "transforms/leftHand"


def frames_of(nation: int) -> int:
    return 3 + nation % 11


def grey_of(nation: int, frame: int) -> int:
    return (nation * 7 + frame * 5) % 256


def episode_file(nation: int, name: str) -> bytes:
    """Metadata and one array of a nation's episode: a matrix per frame, filled with nation + frame."""
    n = frames_of(nation)
    data = {PLACE: np.stack([np.full((4, 4), nation + k, np.float32) for k in range(n)]), "@llm_description": np.array(name.lower()), "@annotated": np.array(nation % 2 == 0)}
    out = io.BytesIO()
    np.savez(out, **data)
    return out.getvalue()


def video_file(nation: int) -> bytes:
    n = frames_of(nation)
    out = io.BytesIO()
    np.savez(out, frames=np.stack([np.full((2, 3, 3), grey_of(nation, k), np.uint8) for k in range(n)]), seconds=np.arange(n) / FPS)
    return out.getvalue()


def release_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='kinespark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, sf_dir: str) -> str:
    """Write the release, 25 episodes whatever the scale, into the folder that all executors share, and name its place."""
    from pyarrow import fs

    root = release_folder(spark, "release")
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name").collect()
    for r in rows:
        folder = f"{base}/{r.r_name.lower().replace(' ', '_')}"
        system.create_dir(folder, recursive=True)
        files = {".npz": episode_file(r.n_nationkey, r.n_name)} | ({".mp4": video_file(r.n_nationkey)} if r.n_nationkey % 3 else {})
        for suffix, data in files.items():
            with system.open_output_stream(f"{folder}/{r.n_nationkey}{suffix}") as f:
                f.write(data)
    return root


def frame_dataset(spark: SparkSession, sf_dir: str) -> str:
    """The same episodes as a robot dataset: frame and episode tables, and a video file a region that holds its episodes one after another.

    Nations of a region follow each other by number; a frame of one is as grey as in its own video.
    """
    from pyarrow import fs

    root = release_folder(spark, "dataset")
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name").sort("n_nationkey").collect()
    ends: dict[int, int] = {}
    shots: dict[int, list[np.ndarray]] = {}
    episodes, frames = [], []
    for r in nations:
        n, begin = frames_of(r.n_nationkey), ends.get(r.n_regionkey, 0)
        ends[r.n_regionkey] = begin + n
        shots.setdefault(r.n_regionkey, []).extend(np.full((2, 3, 3), grey_of(r.n_nationkey, k), np.uint8) for k in range(n))
        episodes.append((r.n_nationkey, [r.n_name.lower(), "go on"], n, 0, r.n_regionkey, begin / FPS, (begin + n) / FPS))
        frames += [(r.n_nationkey, k, k / FPS) for k in range(n)]
    system.create_dir(f"{base}/videos/cam.top/chunk-000", recursive=True)
    for region, images in shots.items():
        out = io.BytesIO()
        np.savez(out, frames=np.stack(images), seconds=np.arange(len(images)) / FPS)
        with system.open_output_stream(f"{base}/videos/cam.top/chunk-000/file-{region:03d}.mp4") as f:
            f.write(out.getvalue())
    kinds = "chunk_index long", "file_index long", "from_timestamp double", "to_timestamp double"
    spark.createDataFrame(episodes, "episode_index long, tasks array<string>, length long, " + ", ".join(f"`videos/cam.top/{k.split()[0]}` {k.split()[1]}" for k in kinds)).write.parquet(f"{root}/meta/episodes")
    spark.createDataFrame(frames, "episode_index long, frame_index long, timestamp double").write.parquet(f"{root}/data")
    return root


class _Answers(BaseHTTPRequestHandler):
    """Progress is the share of frames up to each, success the grey of a frame over 255."""

    def do_POST(self) -> None:
        body = self.rfile.read(int(self.headers["Content-Length"]))
        at = body.index(b"\x93NUMPY")
        frames = np.load(io.BytesIO(body[at:]), allow_pickle=False)
        n = len(frames)
        told = {"outputs_progress": {"progress_pred": [[(k + 1) / n for k in range(n)]]}, "outputs_success": {"success_probs": [[float(f.mean()) / 255 for f in frames]]}}
        data = json.dumps(told).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args: object) -> None:
        pass


_SERVER: list[ThreadingHTTPServer] = []


def fake_server(spark: SparkSession) -> str:
    """Address of a server in the driver that answers as a scoring server would; it ends with the process."""
    if not _SERVER:
        _SERVER.append(ThreadingHTTPServer(("0.0.0.0", 0), _Answers))
        threading.Thread(target=_SERVER[0].serve_forever, daemon=True).start()
    host = "127.0.0.1" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.driver.host")
    return f"http://{host}:{_SERVER[0].server_address[1]}"
