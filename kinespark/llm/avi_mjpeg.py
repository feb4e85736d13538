"""Media columns: bytes stored as AVI motion-JPEG, read back through the RIFF index, and cut into clips.

A payload becomes grey frames of 32 x 32 blocks, one block a byte (see ``jpeg``), in an
AVI file whose ``strd`` chunk holds the payload's length. Reading walks the RIFF tree,
takes the frames that the index ``idx1`` lists, decodes each by itself and compares the
histograms of neighbouring frames. A shot begins where that difference is at least
``LEAST_JUMP``, no less than at both neighbours, and above the median of the other
differences within ``AROUND`` frames by at least ``JUMP`` times their deviation, 3/2 of the median
distance from that median, ``LEAST_JUMP / JUMP`` at least; near the ends of a file zeros
fill these up to three. The frames between two such places are a clip. What a short last
frame lacks counts as the frame before it. All of this is integer arithmetic, so equal payloads give equal rows.

Defined results: a null or empty payload is 64 zero bytes, one frame, one clip; payloads
of any length are coded 512 frames at a time; equal jumps beside each other both count;
repeated rows get equal results; ``clips`` also reads other AVI files with baseline frames,
gives a null medium no row, and a file that it can't read (empty, cut off, no AVI, no index,
no baseline JPEG) one row without a clip that names the ``error``; an empty table gives an
empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from . import jpeg
from .workspace import clear_of, named

UNIT = 64
FPS = 25
BLOCK_FRAMES = 512
BINS, LEVELS = 16, 4096
LEAST_JUMP, JUMP, AROUND = 400, 2, 3  # of 2 * LEVELS; deviations; frames
_WIDTH = 8 * jpeg.SIDE
_VIDEO = [int.from_bytes(x, "little") for x in (b"dc", b"db")]  # the kinds of chunk that are frames


class AviError(ValueError):
    """The bytes aren't an AVI file with an index and motion-JPEG frames."""


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def build(frames: list[bytes], payload: int) -> bytes:
    """An AVI file of JPEG frames."""
    size = max(map(len, frames), default=0)
    head = struct.pack("<14I", 1_000_000 // FPS, size * FPS, 0, 0x10, len(frames), 0, 1, size, _WIDTH, _WIDTH, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), size, 10_000, 0, 0, 0, _WIDTH, _WIDTH)
    shape = struct.pack("<IiiHH4sIiiII", 40, _WIDTH, _WIDTH, 1, 24, b"MJPG", _WIDTH * _WIDTH * 3, 0, 0, 0, 0)
    strl = _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", shape) + _chunk(b"strd", struct.pack("<Q", payload)))
    movi, index, at_ = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at_, len(f)))
        movi.append(_chunk(b"00dc", f))
        at_ += len(movi[-1])
    body = _list(b"hdrl", _chunk(b"avih", head) + strl) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def parse(data: memoryview | bytes) -> tuple[np.ndarray, np.ndarray, float, int | None]:
    """Start and end of each indexed video frame, frames a second, and the payload's length if it is one of ours."""
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise AviError("no RIFF AVI header")
    movi, index, fps, payload = None, None, 0.0, None

    def walk(i: int, end: int) -> None:
        nonlocal movi, index, fps, payload
        while i + 8 <= end:
            name, size = bytes(data[i : i + 4]), struct.unpack_from("<I", data, i + 4)[0]
            if name == b"LIST":
                kind = bytes(data[i + 8 : i + 12])
                if kind == b"movi":
                    movi = i + 8
                else:
                    walk(i + 12, i + 8 + size)
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, i + 8)[0])
            elif name == b"strd":
                payload = struct.unpack_from("<Q", data, i + 8)[0]
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, i + 8).reshape(-1, 4)
            i += 8 + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    if movi is None or index is None:
        raise AviError("no frames or no index")
    index = index[np.isin(index[:, 0] >> 16, _VIDEO)]
    starts = index[:, 2].astype(np.int64) + 8
    # offsets count from the movi list's name; some writers count from the start of the file
    if len(starts) and bytes(data[starts[0] - 8 + movi : starts[0] - 4 + movi]) == index[0, 0].tobytes():
        starts += movi
    return starts, starts + index[:, 3], fps, payload


def store(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The AVI file of each payload ``raw[offsets[i]:offsets[i + 1]]``, padded to a positive multiple of ``UNIT``."""
    size = np.maximum(UNIT, -(-np.diff(offsets) // UNIT) * UNIT)
    count = -(-size // jpeg.FRAME_BYTES)
    first = np.r_[0, np.cumsum(count)]
    files: list[list[bytes]] = [[] for _ in size]
    for k in range(0, int(first[-1]), BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, int(first[-1]) - k)
        flat = np.zeros(n * jpeg.FRAME_BYTES, dtype=np.uint8)
        lo, hi = int(np.searchsorted(first, k, side="right")) - 1, int(np.searchsorted(first, k + n, side="left"))
        for i in range(lo, hi):
            skip = max(0, k - int(first[i])) * jpeg.FRAME_BYTES
            to = max(0, int(first[i]) - k) * jpeg.FRAME_BYTES
            piece = raw[offsets[i] + skip : offsets[i + 1]][: len(flat) - to]
            flat[to : to + len(piece)] = piece
        data, at_ = jpeg.encode(flat.reshape(n, -1))
        blob = data.tobytes()
        owner = np.searchsorted(first, np.arange(k, k + n), side="right") - 1
        for j in range(n):
            files[owner[j]].append(blob[at_[j] : at_[j + 1]])
    return [build(f, int(s)) for f, s in zip(files, size, strict=True)]


def read(files: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Payload of each file, frames by file, a histogram (``LEVELS`` in all) of each frame, and frames a second."""
    base = np.r_[0, np.cumsum([len(f) for f in files])]
    whole = np.frombuffer(b"".join(files), np.uint8)
    parsed = [parse(f) for f in files]
    starts = np.concatenate([p[0] + b for p, b in zip(parsed, base, strict=False)] or [np.zeros(0, np.int64)])
    ends = np.concatenate([p[1] + b for p, b in zip(parsed, base, strict=False)] or [np.zeros(0, np.int64)])
    rows = np.r_[0, np.cumsum([len(p[0]) for p in parsed])]
    if any(p[3] is None for p in parsed):
        raise jpeg.JpegError("a file without a payload")
    length = np.array([p[3] for p in parsed], dtype=np.int64)
    samples = np.concatenate([jpeg.decode(whole, starts[k : k + BLOCK_FRAMES], ends[k : k + BLOCK_FRAMES]) for k in range(0, len(starts), BLOCK_FRAMES)] or [np.zeros((0, jpeg.FRAME_BYTES), np.uint8)])
    per = samples.shape[1]
    owner = np.repeat(np.arange(len(files)), np.diff(rows))
    real = np.minimum(per, length[owner] - (np.arange(len(starts)) - rows[owner]) * per)  # samples that are payload
    hist = np.zeros((len(starts), BINS), dtype=np.int64)
    for k in range(0, len(starts), BLOCK_FRAMES):
        s = samples[k : k + BLOCK_FRAMES]
        cell = np.arange(len(s))[:, None] * BINS + (s >> 4)
        hist[k : k + len(s)] = np.bincount(cell[np.arange(per) < real[k : k + len(s), None]], minlength=len(s) * BINS).reshape(-1, BINS)
    count, hist = hist, hist * LEVELS // np.maximum(1, real)[:, None]
    tail = np.flatnonzero((real < per) & (np.arange(len(starts)) > rows[owner]))
    hist[tail] = (count[tail] * LEVELS + (per - real[tail])[:, None] * hist[tail - 1]) // per
    flat = samples.reshape(-1)
    payloads = [flat[rows[i] * per : rows[i] * per + length[i]] for i in range(len(files))]
    return payloads, rows, hist, parsed[0][2] if parsed else float(FPS)


def read_any(file: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Frames by file, histograms and frames a second of an AVI whose frames are any baseline JPEG; an empty chunk repeats the frame before it."""
    starts, ends, fps, _ = parse(file)
    hist = np.zeros((len(starts), BINS), dtype=np.int64)
    for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if i == j:
            hist[k] = hist[k - 1] if k else 0
            continue
        plane = jpeg.luma(file[i:j])
        hist[k] = np.bincount(plane.ravel() >> 4, minlength=BINS) * LEVELS // max(1, plane.size)
    return np.array([0, len(starts)]), hist, fps


def shots(hist: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each frame begins a clip."""
    n = len(hist)
    begins = np.zeros(n, dtype=bool)
    if not n:
        return begins
    jump = np.zeros(n, dtype=np.int64)
    jump[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1)
    jump[rows[:-1]] = 0  # the first frame of a file has no frame before it
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    i = np.arange(n)
    first, end = rows[owner] + 1, rows[owner + 1]
    # the other jumps around each, the missing ones last
    step = np.r_[-AROUND:0, 1 : AROUND + 1]
    at_ = i[:, None] + step
    inside = (at_ >= first[:, None]) & (at_ < end[:, None])
    most = np.iinfo(np.int64).max
    others = np.where(inside, jump[np.clip(at_, 0, n - 1)], most)
    count = np.maximum(3, inside.sum(axis=1))
    others.sort(axis=1)
    blank = np.arange(2 * AROUND) < count[:, None]
    others = np.sort(np.where(blank & (others == most), 0, others), axis=1)
    mid = others[i, (count - 1) // 2]
    apart = np.sort(np.where(blank, np.abs(others - mid[:, None]), most), axis=1)
    twice = np.maximum(3 * apart[i, (count - 1) // 2], 2 * LEAST_JUMP // JUMP)  # two deviations
    left, right = np.r_[0, jump[:-1]], np.r_[jump[1:], 0]
    right[rows[1:] - 1] = 0
    begins = (jump >= LEAST_JUMP) & (jump >= left) & (jump >= right) & (2 * (jump - mid) >= JUMP * twice)
    begins[rows[:-1]] = True
    return begins


def _feature(marks: np.ndarray) -> str:
    first = np.flatnonzero(marks)
    last = np.r_[first[1:], len(marks)] - 1
    return f"{len(marks)} frames: " + ",".join(f"{a}-{b}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in at.each_text(batches, limit=1 << 20):
        files = store(raw, offsets)
        payloads, rows, hist, _ = read(files)
        marks = shots(hist, rows)
        blobs = [p.tobytes() for p in payloads]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([len(b) for b in blobs], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in blobs]),
                pa.array([zlib.crc32(b[-UNIT:]) for b in blobs], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array([_feature(marks[i:j]) for i, j in zip(rows[:-1], rows[1:], strict=True)]),
            ],
            names=["doc", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in at.each_text(batches, limit=1 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(store(raw, offsets), pa.binary())], names=["doc", "media"])


def _clips_of(media: bytes) -> tuple[np.ndarray, int, float]:
    """First frame of each clip, number of frames, frames a second; ``AviError`` for what isn't such a file."""
    try:
        try:
            _, rows, hist, fps = read([media])
        except jpeg.JpegError:
            rows, hist, fps = read_any(media)
    except (ValueError, IndexError, KeyError, struct.error, OverflowError, RecursionError, MemoryError) as err:
        raise AviError(f"{type(err).__name__}: {err}") from err
    if not len(hist) or not fps:
        raise AviError("no frames or no rate")
    return np.flatnonzero(shots(hist, rows)), len(hist), fps


def _clipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"]
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            media = one.column("media")[0].as_py()
            if media is None:
                continue
            try:
                first, n, fps = _clips_of(media)
            except AviError as err:
                yield pa.RecordBatch.from_arrays([one.column("doc"), *(pa.nulls(1, pa.int32()) for _ in range(3)), *(pa.nulls(1, pa.float64()) for _ in range(2)), pa.array([str(err)])], names=names)
                continue
            last = np.r_[first[1:], n]
            yield pa.RecordBatch.from_arrays(
                [one.column("doc").take(pa.array(np.zeros(len(first), np.int64))), *(pa.array(x, pa.int32()) for x in (np.arange(len(first)), first, last - first)), pa.array(first / fps), pa.array(last / fps), pa.nulls(len(first), pa.string())],
                names=names,
            )


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and its text as the bytes of an AVI file."""
    clear_of(docs, id_col, text_col)
    return docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).mapInArrow(_stored, f"doc {_kind(docs, id_col)}, media binary").withColumnRenamed("doc", id_col)


def clips(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per clip of an AVI column: id, clip, first_frame, n_frames, start_s, end_s, error; a bad file has one row with its error, null media none."""
    clear_of(stored, id_col, media_col)
    schema = f"doc {_kind(stored, id_col)}, clip int, first_frame int, n_frames int, start_s double, end_s double, error string"
    return stored.select(named(id_col).alias("doc"), named(media_col).alias("media")).mapInArrow(_clipped, schema).withColumnRenamed("doc", id_col)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, from its stored form as read back: sizes, digests, and the clips as a feature."""
    clear_of(docs, id_col, text_col)
    schema = f"doc {_kind(docs, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).mapInArrow(_digests, schema).withColumnRenamed("doc", id_col)
