"""Reward scoring of episodes by an evaluation server over HTTP."""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import as_column
from ..functions.sampling import sample_indexes
from ..sources.readers import AvDecoder, segment_frames
from ..sources.schemas import REWARD

ENDPOINT = "/evaluate_batch_npy"
TIMEOUT_S = 600.0
FIRST_WAIT_S = 1.0
Headers = Mapping[str, str] | None
_FRAMES = "sample_0_trajectory_frames"


def build_request(frames, task) -> tuple[bytes, str]:
    """The frames as an ``.npy`` file and the JSON that describes them."""
    file = io.BytesIO()
    np.save(file, frames)
    clip = dict.fromkeys(("lang_vector", "text_embedding", "video_embeddings"))
    clip |= {"task": task, "frames": {"__numpy_file__": _FRAMES}, "frames_shape": [*frames.shape], "metadata": {"subsequence_length": len(frames)}}
    return file.getvalue(), json.dumps({"trajectory": clip, "resample_attempts": 1, "data_gen_strategy": None, "sample_type": "progress"})


def parse_response(answer: dict) -> tuple:
    """Progress and success probability per frame."""
    of = lambda part, what: answer[part][what][0]
    return of("outputs_progress", "progress_pred"), of("outputs_success", "success_probs")


def _form(parts: list[tuple[str, str | None, bytes]]) -> tuple[str, bytes]:
    mark = uuid.uuid4().hex
    body = b""
    for name, file, data in parts:
        extra = f'; filename="{file}"\r\nContent-Type: application/octet-stream' if file else ""
        body += f'--{mark}\r\nContent-Disposition: form-data; name="{name}"{extra}\r\n\r\n'.encode() + data + b"\r\n"
    return f"multipart/form-data; boundary={mark}", body + f"--{mark}--\r\n".encode()


def post(url: str, npy: bytes, sample: str, *, timeout_s: float = TIMEOUT_S, headers: Headers = None, retries: int = 0) -> dict:
    """The server's JSON answer; any status but 2xx raises.

    Where there is no connection, or the server fails (5xx), it is asked again up to ``retries`` times, after 1, 2, 4 ...
    seconds; a request that the server refuses (4xx) is not.
    """
    for again in range(retries + 1):
        try:
            return _posted(url, npy, sample, timeout_s, headers)
        except urllib.error.URLError as err:
            if again == retries or getattr(err, "code", 500) < 500:
                raise
            time.sleep(FIRST_WAIT_S * 2**again)
    raise ValueError(f"retries is 0 or more, not {retries}")


def _posted(url: str, npy: bytes, sample: str, timeout_s: float, headers: Headers) -> dict:
    kind, body = _form([(_FRAMES, _FRAMES + ".npy", npy), ("sample_0", None, sample.encode()), ("use_frame_steps", None, b"false")])
    asked = urllib.request.Request(url.rstrip("/") + ENDPOINT, data=body, headers={**(headers or {}), "Content-Type": kind}, method="POST")
    with urllib.request.urlopen(asked, timeout=timeout_s) as answer:
        return json.load(answer)


def score_rewards(task: Column | str, length: Column | str, from_ts: Column | str, to_ts: Column | str, video: Column | str, *, url: str, decoder=None, timeout_s: float = TIMEOUT_S, headers: Headers = None, max_frames: int = 8, concurrency: int = 4, on_error: str = "raise", retries: int = 0) -> Column:
    """struct reward_score, robometer_success, reward_frames of each episode.

    Frames are sampled uniformly by a Column expression, decoded from the episode's segment
    of the video and posted in one request; up to ``concurrency`` rows of a task are in
    flight at once. ``headers`` stay inside the function, out of plans and logs. The column
    is marked nondeterministic, so a filter on it and its projection share one evaluation and
    each episode is posted once per attempt of its task, and again only for ``retries``. A
    failed row fails the task, or is null with ``on_error="null"``. Sort and limit before scoring.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is 'raise' or 'null', not {on_error!r}")
    decoder = decoder or AvDecoder()
    kind = to_arrow_type(REWARD)
    secret = dict(headers or {})

    def one(row: tuple) -> dict | None:
        text, start, end, file, want = row
        try:
            frames, refs = segment_frames(decoder, file, float(start), float(end), want)
            progress, success = parse_response(post(url, *build_request(frames, text), headers=secret, timeout_s=timeout_s, retries=retries))
        except Exception:
            if on_error == "raise":
                raise
            return None
        return {"reward_frames": refs, "robometer_success": success, "reward_score": progress}

    @F.arrow_udf(REWARD)
    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pa.array(list(pool.map(one, zip(*(c.to_pylist() for c in batch), strict=True))), kind)

    places = sample_indexes(length, max_frames)
    return scored.asNondeterministic()(as_column(task), as_column(from_ts), as_column(to_ts), as_column(video), places)
