"""Pictures of results, with numpy alone: hands over frames, frames side by side, reward curves."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Mapping, Sequence

import numpy as np

#: Points of a hand that are joined: the wrist to each finger's base, and along each finger.
BONES = tuple((0 if j % 4 == 1 else j - 1, j) for j in range(1, 21))
COLOURS = {"left": (66, 135, 245), "right": (245, 130, 48), "truth": (60, 200, 90), "unknown": (200, 200, 60)}
LINES = ("#4287f5", "#f58230", "#3cc85a", "#b04fd8", "#808080")


def pixels(image: Mapping) -> np.ndarray:
    """An image struct as an H x W x 3 array of its own."""
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]).copy()


def _line(canvas: np.ndarray, a: Sequence[float], b: Sequence[float], colour: tuple[int, int, int]) -> None:
    if not np.isfinite([*a, *b]).all():
        return
    n = int(min(4096, max(abs(b[0] - a[0]), abs(b[1] - a[1])))) + 1
    x, y = (np.rint(np.linspace(a[k], b[k], n)).astype(int) for k in (0, 1))
    inside = (x >= 0) & (x < canvas.shape[1]) & (y >= 0) & (y < canvas.shape[0])
    canvas[y[inside], x[inside]] = colour


def _dot(canvas: np.ndarray, p: Sequence[float], size: int, colour: tuple[int, int, int]) -> None:
    if np.isfinite(p).all():
        x, y = (int(np.clip(round(v), -size - 1, limit + size)) for v, limit in zip(p, (canvas.shape[1], canvas.shape[0]), strict=True))
        canvas[max(0, y - size) : max(0, y + size + 1), max(0, x - size) : max(0, x + size + 1)] = colour


def with_hands(canvas: np.ndarray, hands: Iterable[Mapping] | None) -> np.ndarray:
    """The picture with the bones and points of predicted hands, coloured by side; what lies outside is cut off."""
    out = canvas.copy()
    for hand in hands or ():
        colour, points = COLOURS.get(hand["handedness"], COLOURS["unknown"]), hand["kp2d"]
        for a, b in BONES:
            if b < len(points):
                _line(out, points[a], points[b], colour)
        for p in points:
            _dot(out, p, 1, colour)
    return out


def with_truth(canvas: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The picture with true wrists and tips (hand, 6, 2), each tip joined to its wrist; NaN points are left out."""
    out = canvas.copy()
    for hand in points:
        for p in hand[1:]:
            _line(out, hand[0], p, COLOURS["truth"])
        for p in hand:
            _dot(out, p, 2, COLOURS["truth"])
    return out


def montage(images: Sequence[np.ndarray], columns: int = 4, gap: int = 2) -> np.ndarray:
    """Pictures side by side in rows, on white; cells are as large as the largest picture."""
    if not len(images):
        return np.full((1, 1, 3), 255, np.uint8)
    columns = max(1, min(columns, len(images)))
    height, width = (max(i.shape[k] for i in images) for k in (0, 1))
    rows = -(-len(images) // columns)
    out = np.full((rows * (height + gap) - gap, columns * (width + gap) - gap, 3), 255, np.uint8)
    for k, image in enumerate(images):
        y, x = k // columns * (height + gap), k % columns * (width + gap)
        out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def png(canvas: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = canvas.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(canvas, np.uint8).reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def curves_svg(curves: Mapping[str, Sequence[tuple[float, float]]], width: int = 480, height: int = 240) -> str:
    """Curves of (seconds, score from 0 to 1) by name as an SVG picture, with a line at one half."""
    last = max((t for c in curves.values() for t, _ in c), default=1.0) or 1.0
    edge = 30
    place = lambda t, s: f"{edge + t / last * (width - 2 * edge):.1f},{height - edge - min(1.0, max(0.0, s)) * (height - 2 * edge):.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">', f'<rect width="{width}" height="{height}" fill="white"/>']
    for score in (0.0, 0.5, 1.0):
        (x1, y1), (x2, y2) = place(0, score).split(","), place(last, score).split(",")
        out.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#cccccc"/><text x="4" y="{y1}">{score:g}</text>')
    for k, (name, points) in enumerate(curves.items()):
        colour = LINES[k % len(LINES)]
        label = name.replace("&", "&amp;").replace("<", "&lt;")
        out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(place(t, s) for t, s in points)}"/><text x="{edge + 6}" y="{edge + 12 * k}" fill="{colour}">{label}</text>')
    return "\n".join([*out, "</svg>"])
