"""Camera and hand geometry: numpy kernels for workers, and Column forms where arithmetic is enough."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FOCAL = (736.6339, 736.6339)
CENTRE = (960.0, 540.0)
HAND_DIMS = 24
WRIST_AND_TIPS = (0, 4, 8, 12, 16, 20)
_ORDERS = np.array(list(permutations(range(5))))
_BLOCK = 1024


def hand_points(state: np.ndarray, side: int) -> np.ndarray:
    """Wrist and five fingertips (..., 6, 3) of side 0 (left) or 1 (right) of state vectors."""
    s = state[..., HAND_DIMS * side : HAND_DIMS * (side + 1)]
    points = s.reshape(*s.shape[:-1], 8, 3)
    return np.concatenate([points[..., :1, :], points[..., 3:, :]], axis=-2)


def inverted(matrices: np.ndarray) -> np.ndarray:
    """Inverses of matrices (..., n, n); NaN where there is none, so that one bad row doesn't fail the others."""
    with np.errstate(all="ignore"):
        usable = np.isfinite(matrices).all(axis=(-2, -1))
        safe = np.where(usable[..., None, None], matrices, np.eye(matrices.shape[-1]))
        usable &= np.linalg.matrix_rank(safe) == matrices.shape[-1]
    safe = np.where(usable[..., None, None], safe, np.eye(matrices.shape[-1]))
    return np.where(usable[..., None, None], np.linalg.inv(safe), np.nan)


def project_world(points: np.ndarray, extrinsics: np.ndarray, focal: tuple[float, float] = FOCAL, centre: tuple[float, float] = CENTRE) -> np.ndarray:
    """Pixels (..., k, 2) of world points (..., k, 3) for camera-to-world matrices (..., 4, 4).

    NaN at or behind the camera, and for a matrix without an inverse.
    """
    inverse = inverted(extrinsics)
    cam = points @ np.swapaxes(inverse[..., :3, :3], -1, -2) + inverse[..., None, :3, 3]
    z = cam[..., 2:]
    with np.errstate(all="ignore"):
        return np.where(z > 0, cam[..., :2] / z * np.array(focal) + np.array(centre), np.nan)


def normalised(points: np.ndarray) -> np.ndarray:
    """Points (..., k, d) from the first one on, in units of the others' mean distance to it."""
    from_first = points - points[..., :1, :]
    reach = np.linalg.norm(from_first[..., 1:, :], axis=-1).mean(axis=-1)
    return from_first / (reach + 1e-9)[..., None, None]


def tip_errors(truth: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Errors (n, 6) of hands (n, 6, d): 0 for the wrist, then each true tip's distance to the guessed tip it is assigned.

    The assignment is the one of least sum among all orders of five tips; of equal sums the first order counts. The sums
    of ``_BLOCK`` hands are made at a time, as those of one take 5 kB.
    """
    g, m = normalised(truth), normalised(guess)
    apart = np.linalg.norm(g[:, 1:, None, :] - m[:, None, 1:, :], axis=-1)
    best = np.zeros((len(apart), 5), dtype=int)
    for i in range(0, len(apart), _BLOCK):
        sums = apart[i : i + _BLOCK, np.arange(5)[None, :], _ORDERS].sum(axis=-1)
        best[i : i + _BLOCK] = _ORDERS[sums.argmin(axis=1)]
    return np.concatenate([np.zeros((len(g), 1)), np.take_along_axis(apart, best[:, :, None], axis=2)[..., 0]], axis=1)


def mirrored(points: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Points (n, k, d) with x negated where ``right`` is 0."""
    out = np.array(points, dtype=float)
    out[..., 0] *= np.where(np.asarray(right) == 1, 1.0, -1.0)[:, None]
    return out


def scaled_focal(focal: float, model_size: float, image_size: np.ndarray) -> float:
    return focal / model_size * float(np.max(image_size))


def full_image_camera(crop_camera: np.ndarray, box_centre: np.ndarray, box_size: np.ndarray, image_size: np.ndarray, focal: float) -> np.ndarray:
    """Translation (n, 3) in the full image for crop cameras (n, 3) = scale, x, y."""
    scale = box_size * crop_camera[:, 0] + 1e-9
    shift = 2 * (box_centre - image_size / 2) / scale[:, None] + crop_camera[:, 1:]
    return np.column_stack([shift, 2 * focal / scale])


def project_centred(points: np.ndarray, translation: np.ndarray, focal: float, image_size: np.ndarray) -> np.ndarray:
    """Pixels of model points moved by ``translation``; the principal point is the image centre."""
    p = points + translation
    return focal * p[..., :2] / p[..., 2:] + np.asarray(image_size, float) / 2


def full_image_camera_columns(scale: Column, x: Column, y: Column, box_x: Column, box_y: Column, box_size: Column, width: Column, height: Column, focal: Column) -> dict[str, Column]:
    """``full_image_camera`` for scalar columns: tx, ty, tz."""
    s = box_size * scale + F.lit(1e-9)
    return {"tx": (box_x - width / 2) * 2 / s + x, "ty": (box_y - height / 2) * 2 / s + y, "tz": focal * 2 / s}


def pinhole_columns(x: Column, y: Column, z: Column, focal: tuple[float, float] = FOCAL, centre: tuple[float, float] = CENTRE) -> dict[str, Column]:
    """Pixel u, v of a camera-space point; null at or behind the camera."""
    return {"u": F.when(z > 0, x / z * focal[0] + centre[0]), "v": F.when(z > 0, y / z * focal[1] + centre[1])}


def normalise_column(points: Column) -> Column:
    """``normalised`` for an array of arrays of doubles."""
    first = F.element_at(points, 1)
    moved = F.transform(points, lambda p: F.zip_with(p, first, lambda a, b: a - b))
    norm = lambda p: F.sqrt(F.aggregate(p, F.lit(0.0), lambda t, x: t + x * x))
    tips = F.slice(moved, 2, F.size(moved) - 1)
    reach = F.aggregate(F.transform(tips, norm), F.lit(0.0), lambda t, x: t + x) / F.size(tips)
    return F.transform(moved, lambda p: F.transform(p, lambda x: x / (reach + F.lit(1e-9))))
