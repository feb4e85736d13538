"""What opens files in workers: attribute and array readers, and frame decoders.

A reader has ``attributes(uri) -> dict`` and ``arrays(uri, names) -> dict``; a decoder has
``frames(uri)``, which yields (seconds, H x W x 3 uint8, is key frame) in order. Both open
their files through a ``Store``, which knows local files and object stores and carries the
credentials. The HDF5 and video ones need h5py and av in the workers; the ones over ``.npz``
files need numpy only and serve tests and converted data. All are small and picklable; a
failed read raises and the task is tried again, on another executor if need be.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np

_FILESYSTEMS = {"s3": "S3FileSystem", "s3a": "S3FileSystem", "gs": "GcsFileSystem", "hdfs": "HadoopFileSystem", "abfs": "AzureFileSystem", "abfss": "AzureFileSystem"}


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI; anything else as it is."""
    return "/" + unquote(uri[5:]).lstrip("/") if uri.startswith("file:") else uri


@dataclass(frozen=True)
class Store:
    """Opens URIs for random reading. ``options`` are the arguments of pyarrow's filesystem of that scheme, such as keys and endpoints.

    They travel inside functions, so they are in no plan; ``repr`` leaves them out too.
    """

    options: Mapping[str, object] = field(default_factory=dict, repr=False)

    def open(self, file: object) -> BinaryIO:
        """A stream of a path, a URI, an object with ``open()``, or a stream as it is."""
        if hasattr(file, "read"):
            return file
        if hasattr(file, "open"):
            return file.open()
        scheme = urlsplit(str(file)).scheme
        if len(scheme) < 2 or scheme == "file":  # a single letter is a drive
            return open(local_path(str(file)), "rb")
        from pyarrow import fs

        if self.options and scheme in _FILESYSTEMS:
            place = urlsplit(str(file))
            return getattr(fs, _FILESYSTEMS[scheme])(**self.options).open_input_file(place.netloc + unquote(place.path))
        system, path = fs.FileSystem.from_uri(str(file).replace("s3a://", "s3://", 1))
        return system.open_input_file(path)


@dataclass(frozen=True)
class NpzReader:
    """Arrays of an ``.npz`` file; attributes are the arrays whose names start with ``@``."""

    store: Store = Store()

    def attributes(self, uri: str) -> dict[str, object]:
        with self.store.open(uri) as f, np.load(f, allow_pickle=False) as z:
            return {k[1:]: z[k] for k in z.files if k.startswith("@")}

    def arrays(self, uri: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
        with self.store.open(uri) as f, np.load(f, allow_pickle=False) as z:
            return {n: z[n] for n in names}


@dataclass(frozen=True)
class Hdf5Reader:
    """HDF5 files; only the datasets asked for are read."""

    store: Store = Store()

    def __post_init__(self) -> None:
        try:
            import h5py  # noqa: F401
        except ImportError as err:
            raise ImportError("reading HDF5 episodes needs h5py on the driver and the workers") from err

    def attributes(self, uri: str) -> dict[str, object]:
        import h5py

        with self.store.open(uri) as f, h5py.File(f, "r") as h5:
            return dict(h5.attrs)

    def arrays(self, uri: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
        import h5py

        with self.store.open(uri) as f, h5py.File(f, "r") as h5:
            return {n: h5[n][()] for n in names}


@dataclass(frozen=True)
class NpzDecoder:
    """A video kept as arrays ``frames`` (N, H, W, 3) and ``seconds`` (N,)."""

    store: Store = Store()

    def frames(self, uri: str, start: float = 0.0) -> Iterator[tuple[float | None, np.ndarray, bool]]:
        with self.store.open(uri) as f, np.load(f, allow_pickle=False) as z:
            images, seconds = z["frames"], z["seconds"]
        for i, (s, image) in enumerate(zip(seconds, images, strict=True)):
            if s >= start - 1.0:
                yield (None if np.isnan(s) else float(s)), image, i == 0


@dataclass(frozen=True)
class AvDecoder:
    """Video files through av."""

    store: Store = Store()

    def __post_init__(self) -> None:
        try:
            import av  # noqa: F401
        except ImportError as err:
            raise ImportError("decoding video needs av on the driver and the workers") from err

    def frames(self, uri: str, start: float = 0.0) -> Iterator[tuple[float | None, np.ndarray, bool]]:
        import av

        with self.store.open(uri) as f, av.open(f) as box:
            stream = box.streams.video[0]
            if stream.time_base is None:
                raise ValueError(f"no time base in {uri}")
            box.seek(max(0, int((start - 1.0) / stream.time_base)), stream=stream)
            for f in box.decode(stream):
                yield (None if f.pts is None else float(f.pts * stream.time_base)), f.to_ndarray(format="rgb24"), bool(f.key_frame)


SLACK = 1e-6


def clocked(decoder, uri: str, from_ts: float, to_ts: float) -> Iterator[tuple[int, float, np.ndarray]]:
    """(number, seconds, image) of the frames of a segment, on its own clock.

    The clock starts with the first frame that has a time of at least ``from_ts``; it ends before ``to_ts``.
    """
    place = -1
    for t, image, _ in decoder.frames(uri, from_ts):
        if t is None or t + SLACK < from_ts:
            continue
        if t + SLACK >= to_ts:
            return
        place += 1
        yield place, t, image


def segment_frames(decoder, uri: str, from_ts: float, to_ts: float, want: Iterable[int]) -> tuple[np.ndarray, list]:
    """Frames of a segment by their number in it, and {index, timestamp_s} of each."""
    missing, images, refs = set(want), [], []
    for place, t, image in clocked(decoder, uri, from_ts, to_ts) if missing else ():
        if place in missing:
            missing.discard(place)
            images.append(image)
            refs.append({"index": place, "timestamp_s": round(t, 6)})
            if not missing:
                break
    if missing or not images:
        raise ValueError(f"{len(images)} of {len(set(want))} sampled frames lie in [{from_ts}, {to_ts}) of the video")
    return np.stack(images), refs


def resized(image: np.ndarray, width: int | None, height: int | None) -> np.ndarray:
    """Nearest-neighbour resize; a missing side keeps its size."""
    h, w = image.shape[:2]
    rows = np.arange(height or h) * h // (height or h)
    cols = np.arange(width or w) * w // (width or w)
    return image if (len(rows), len(cols)) == (h, w) else image[rows][:, cols]
