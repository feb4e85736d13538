"""Hand tracking: one operator over an image column, with exchangeable methods.

A method is a small picklable factory; calling it in a worker gives an object with
``track(frames) -> list of lists of hands``, where frames are H x W x 3 RGB arrays (None for
a null image). It is built on the first batch of a task, once per worker process, never
when the plan is made.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import sys
import threading
import types
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as G
from ..functions.columns import as_column, named
from ..sources.schemas import HANDS

CACHE_VARIABLE = "KINESPARK_CACHE"
ASSETS_VARIABLE = "KINESPARK_WILOR_ROOT"
_MODELS = "https://storage.googleapis.com/mediapipe-models"
LANDMARK_MODEL = f"{_MODELS}/hand_landmarker/hand_landmarker/float16/1/hand_landmarker.task"
CLOSE_S = 5.0
File = str | None


def hand(handedness: str, confidence: float, kp2d, kp3d=None) -> dict:
    as_lists = lambda a: None if a is None else np.asarray(a, dtype=float).tolist()
    return {"handedness": handedness, "confidence": float(confidence), "kp2d": as_lists(kp2d), "kp3d": as_lists(kp3d)}


def cached_model(path: str | None, url: str = LANDMARK_MODEL) -> str:
    """``path``, or the model in the cache folder, fetched once if it isn't there."""
    if path:
        return path
    return fetched(url, Path(os.environ.get(CACHE_VARIABLE) or Path.home() / ".cache" / "kinespark") / Path(url).name)


def fetched(url: str, kept: Path) -> str:
    """The file ``kept``, fetched once if it isn't there; workers that fetch at the same time don't meet half a file."""
    if not kept.exists():
        kept.parent.mkdir(parents=True, exist_ok=True)
        part = kept.with_name(f"{kept.name}.{os.getpid()}")
        urllib.request.urlretrieve(url, part)
        part.replace(kept)
    return str(kept)


def closed_in_time(close: Callable[[], object], *, alive: Callable[[], bool] = lambda: True, seconds: float = CLOSE_S) -> str:
    """Close a native model without ever hanging or raising: ``closed``, ``skipped`` or ``abandoned``.

    A model whose own threads are gone would wait for them for ever, so it is left; any other gets some seconds in a
    thread of its own. What is left over goes with the process.
    """
    if not alive():
        return "skipped"

    def quietly() -> None:
        with contextlib.suppress(Exception):
            close()

    helper = threading.Thread(target=quietly, daemon=True, name="close-model")
    try:
        helper.start()
    except RuntimeError:  # the interpreter is on its way out
        return "skipped"
    helper.join(seconds)
    return "abandoned" if helper.is_alive() else "closed"


def landmarks_to_hands(landmarks: list, handedness: list, width: int, height: int) -> list[dict]:
    """Hands from normalised landmarks; the label and its score are ``unknown`` and 0 where a hand has none."""
    out = []
    for i, points in enumerate(landmarks or []):
        kinds = (handedness or [])[i : i + 1]
        best = kinds[0][0] if kinds and kinds[0] else None
        out.append(hand(best.category_name.lower() if best else "unknown", best.score if best else 0.0, [(p.x * width, p.y * height) for p in points]))
    return out


@dataclass(frozen=True)
class MediaPipe:
    """2D landmarks on the CPU."""

    model_path: File = None
    num_hands: int = 2
    min_confidence: float = 0.3
    batch: int = 16

    def __call__(self) -> MediaPipe._Tracker:
        return MediaPipe._Tracker(self)

    class _Tracker:
        def __init__(self, given: MediaPipe) -> None:
            try:
                import mediapipe as mp
            except ImportError as err:
                raise ImportError("method 'mediapipe' needs the mediapipe package on the workers") from err
            vision = mp.tasks.vision
            options = vision.HandLandmarkerOptions(
                base_options=mp.tasks.BaseOptions(model_asset_path=cached_model(given.model_path)), num_hands=given.num_hands, min_hand_detection_confidence=given.min_confidence
            )
            self.mp, self.detector = mp, vision.HandLandmarker.create_from_options(options)
            # the package closes a detector when it is collected, which can be after its threads have ended
            self._close = self.detector.close
            self.detector.close = self.close

        def _alive(self) -> bool:
            pool = getattr(getattr(self.detector, "_lib", None), "_executor", None)
            threads = getattr(pool, "_threads", None)
            return not threads or any(t.is_alive() for t in threads)

        def close(self) -> str:
            done, self._close = self._close, lambda: None
            return closed_in_time(done, alive=self._alive)

        def track(self, frames: list[np.ndarray | None]) -> list[list[dict]]:
            out = []
            for image in frames:
                if image is None:
                    out.append([])
                    continue
                image = np.ascontiguousarray(image, dtype=np.uint8)
                picture = self.mp.Image(data=image, image_format=self.mp.ImageFormat.SRGB)
                got = self.detector.detect(picture)
                out.append(landmarks_to_hands(got.hand_landmarks, got.handedness, image.shape[1], image.shape[0]))
            return out


def model_output_to_hands(boxes_right: np.ndarray, confidences: np.ndarray, cameras: np.ndarray, points: np.ndarray, box_centres: np.ndarray, box_sizes: np.ndarray, image_size: np.ndarray, focal: float) -> list[dict]:
    """Hands from a mesh model's crops: un-mirrored left hands, cameras in the full image, projected points."""
    cameras = np.array(cameras, dtype=float)
    cameras[:, 1] *= np.where(boxes_right == 1, 1.0, -1.0)
    shift = G.full_image_camera(cameras, box_centres, box_sizes, np.broadcast_to(image_size, box_centres.shape), focal)
    space = G.mirrored(points, boxes_right)
    return [hand("right" if r == 1 else "left", c, G.project_centred(p, t, focal, image_size), p) for r, c, p, t in zip(boxes_right, confidences, space, shift, strict=True)]


@dataclass(frozen=True)
class Wilor:
    """3D mesh keypoints on a GPU; the detector's own threshold applies."""

    mano_path: str
    wilor_root: File = None
    device: str = "cuda"
    batch: int = 8
    weights_url: str | None = None

    def __call__(self) -> Wilor._Tracker:
        return Wilor._Tracker(self)

    class _Tracker:
        DETECTOR_THRESHOLD = 0.3

        def __init__(self, given: Wilor) -> None:
            try:
                import torch
                import ultralytics
            except ImportError as err:
                raise ImportError("method 'wilor' needs torch, ultralytics and the model's own code on the workers") from err
            root = place_assets(given.wilor_root, given.mano_path, given.weights_url)
            sys.path.insert(0, root)  # of this worker process only
            without_renderer()
            from wilor.models import load_wilor
            from wilor.utils import recursive_to
            from wilor.datasets.vitdet_dataset import ViTDetDataset

            self.torch, self.crops, self.to = torch, ViTDetDataset, recursive_to
            self.device = torch.device(given.device)
            model, self.config = load_wilor(checkpoint_path=f"{root}/pretrained_models/wilor_final.ckpt", cfg_path=f"{root}/pretrained_models/model_config.yaml")
            self.model = model.eval().to(self.device)
            self.detector = ultralytics.YOLO(f"{root}/pretrained_models/detector.pt")

        def track(self, frames: list[np.ndarray | None]) -> list[list[dict]]:
            return [[] if image is None else self._one(np.asarray(image)[:, :, ::-1].copy()) for image in frames]

        def _one(self, bgr: np.ndarray) -> list[dict]:
            boxes = self.detector(bgr, conf=self.DETECTOR_THRESHOLD, verbose=False)[0].boxes
            if not len(boxes):
                return []
            corners, right, sure = (x.float().cpu().numpy() for x in (boxes.xyxy[:, :4], boxes.cls, boxes.conf))
            data = self.crops(self.config, bgr, corners, right, rescale_factor=2.0)
            batch = self.to(next(iter(self.torch.utils.data.DataLoader(data, batch_size=len(right), shuffle=False))), self.device)
            with self.torch.no_grad():
                got = self.model(batch)
            host = lambda x: x.detach().float().cpu().numpy()
            size = host(batch["img_size"])[0]
            focal = G.scaled_focal(self.config.EXTRA.FOCAL_LENGTH, self.config.MODEL.IMAGE_SIZE, size)
            return model_output_to_hands(right, sure, host(got["pred_cam"]), host(got["pred_keypoints_3d"]), host(batch["box_center"]), host(batch["box_size"]), size, focal)


ASSETS = ("pretrained_models/detector.pt", "pretrained_models/wilor_final.ckpt", "pretrained_models/model_config.yaml", "pretrained_models/dataset_config.yaml")


def place_assets(root: str | None, mano_path: str | None, weights_url: str | None = None) -> str:
    """The model's folder, with the hand model copied to the two places it is read from; what is there already stays.

    Lacking ``ASSETS`` are fetched from under ``weights_url`` if that is given, else the error names them. The model's
    own code isn't fetched.
    """
    home = Path(root or os.environ.get(ASSETS_VARIABLE) or "/WiLoR")
    for a in ASSETS if weights_url else ():
        fetched(f"{weights_url.rstrip('/')}/{a}", home / a)
    if lacking := [a for a in ASSETS if not (home / a).exists()]:
        raise FileNotFoundError(f"{home} lacks {lacking}")
    for place in ("mano_data/MANO_RIGHT.pkl", "pretrained_models/MANO_RIGHT.pkl"):
        target = home / place
        if not target.exists():
            if not mano_path or not Path(mano_path).exists():
                raise FileNotFoundError(f"no hand model at {mano_path!r}")
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(mano_path, target)
    return str(home)


class _Nothing(MagicMock):
    """Takes any arguments and answers to any name."""

    def __init__(self, *args: object, **kwargs: object) -> None:
        super().__init__()

    def _get_child_mock(self, **kwargs: object) -> MagicMock:
        return MagicMock(**kwargs)


class _Placeholder(types.ModuleType):
    """A module any name of which can be imported, called and subclassed, and does nothing."""

    def __getattr__(self, name: str) -> object:
        if name.startswith("__"):
            raise AttributeError(name)
        return _Nothing


def without_renderer(name: str = "pyrender") -> None:
    """Let the model's code import its mesh renderer, which isn't used and would need a GL library; a real one already loaded stays."""
    sys.modules.setdefault(name, _Placeholder(name))


METHODS: dict[str, Callable[..., object]] = {}


def register_method(name: str, factory: Callable[..., object]) -> None:
    """Make ``track_hands(method=name)`` build its tracker with ``factory(**options)``."""
    METHODS[name] = factory


_LIVE: dict[object, object] = {}


def _tracker(factory):
    """One tracker per worker process and configuration."""
    if factory not in _LIVE:
        _LIVE[factory] = made = factory()
        if hasattr(made, "close"):
            atexit.register(made.close)
    return _LIVE[factory]


def _pixels(image: dict | None) -> np.ndarray | None:
    return None if image is None else np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def track_with(images: Column | str, factory, *, batch: int = 16) -> Column:
    """Hands of each image by a tracker factory; images go to it ``batch`` at a time, whatever Arrow's batches are."""
    kind = to_arrow_type(HANDS)

    @F.arrow_udf(HANDS)
    def tracked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tracker = None
        for column in batches:
            parts = []
            for i in range(0, len(column), batch):
                tracker = tracker or _tracker(factory)
                parts.append(pa.array(tracker.track([_pixels(x) for x in column.slice(i, batch).to_pylist()]), kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return tracked(as_column(images))


def gpu_profile(share: float = 0.25, *, cpus: int = 1):
    """A resource profile that gives each task a share of a GPU, so that 1 / share tasks run on one at a time."""
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    if not 0 < share <= 1:
        raise ValueError(f"share is above 0 and at most 1, not {share}")
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus).resource("gpu", share)).build


def track_table(frames: DataFrame, images: str, factory, *, to: str = "hands", batch: int = 16, profile=None, most_tasks: int | None = None) -> DataFrame:
    """``frames`` with a column of hands, as ``track_with``, as a step of its own that can be held to resources.

    ``profile`` (see ``gpu_profile``) sets what a task needs, on clusters that can schedule it; ``most_tasks`` bounds
    the trackers at work at once by the number of partitions, without a shuffle.
    """
    kind, schema = to_arrow_type(HANDS), T.StructType([*frames.schema.fields, T.StructField(to, HANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                hands = _tracker(factory).track([_pixels(x) for x in part.column("image").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.column("row").flatten(), pa.array(hands, kind)], names=schema.names)

    rows = frames if most_tasks is None else frames.coalesce(most_tasks)
    return rows.select(F.struct(*map(named, frames.columns)).alias("row"), named(images).alias("image")).mapInArrow(run, schema, profile=profile)


def track_hands(images: Column | str, *, method: str, num_hands: int = 2, min_confidence: float = 0.3, model_path: File = None, device: str = "cuda", mano_path: File = None, wilor_root: File = None) -> Column:
    """Hands in each image: array of struct handedness, confidence, kp2d, kp3d. A null image has none.

    ``mediapipe`` uses ``model_path``, ``num_hands`` and ``min_confidence``; ``wilor`` uses ``mano_path``, ``wilor_root``
    and ``device``. Models load in the workers; run GPU methods under a resource profile that gives each task its share.
    """
    if method == "mediapipe":
        return track_with(images, MediaPipe(model_path, num_hands, min_confidence), batch=16)
    if method == "wilor" and not mano_path:
        raise ValueError("method 'wilor' needs mano_path, the MANO_RIGHT.pkl file")
    if method == "wilor":
        return track_with(images, Wilor(mano_path, wilor_root, device), batch=8)
    if method in METHODS:
        return track_with(images, METHODS[method]())
    raise ValueError(f"unknown method {method!r}: there are 'mediapipe' and 'wilor'" + "".join(f", {m!r}" for m in METHODS))
