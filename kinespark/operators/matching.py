"""Predicted hands against ground truth, as one Arrow UDF with a numpy kernel."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as G
from ..functions.columns import as_column
from ..sources.schemas import MATCH

ROWS = 512


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost for at most two rows; of equal costs, the first in order."""
    rows, cols = cost.shape
    if rows <= cols:
        options = [list(zip(range(rows), p, strict=True)) for p in permutations(range(cols), rows)]
    else:
        options = [sorted(zip(p, range(cols), strict=True)) for p in permutations(range(rows), cols)]
    return min(options, key=lambda o: sum(cost[i, j] for i, j in o))


def _wrist_and_tips(hand: dict | None) -> np.ndarray | None:
    """Six points of a predicted hand; None if it lacks one of its 21 points or one of these is no number."""
    points = None if hand is None else hand["kp2d"]
    if points is None or len(points) < 21 or any(p is None or len(p) < 2 for p in points):
        return None
    six = np.array([points[k][:2] for k in G.WRIST_AND_TIPS], dtype=float)
    return six if np.isfinite(six).all() else None


def match_batch(hands: list, states: list, extrinsics: list) -> list[dict]:
    """``match_hands`` of lists of rows. All hand pairs of the batch go through one vectorised error computation."""
    n = len(hands)
    ok = [s is not None and len(s) >= 2 * G.HAND_DIMS and e is not None and len(e) == 16 for s, e in zip(states, extrinsics, strict=True)]
    seen: list[list[np.ndarray]] = [[] for _ in range(n)]
    if rows := [i for i in range(n) if ok[i]]:
        state = np.array([[np.nan if x is None else x for x in states[i][: 2 * G.HAND_DIMS]] for i in rows], dtype=float)
        camera = np.array([[np.nan if x is None else x for x in extrinsics[i]] for i in rows], dtype=float).reshape(-1, 4, 4)
        for side in (0, 1):
            pixels = G.project_world(G.hand_points(state, side), camera)
            for i, uv in zip(rows, pixels, strict=True):
                if np.isfinite(uv).all():
                    seen[i].append(uv)
    guesses = [[p for h in row or [] if (p := _wrist_and_tips(h)) is not None] for row in hands]
    pairs = [(i, a, b) for i in range(n) for a in range(len(seen[i])) for b in range(len(guesses[i]))]
    errors = G.tip_errors(np.array([seen[i][a] for i, a, _ in pairs]), np.array([guesses[i][b] for i, _, b in pairs])) if pairs else np.zeros((0, 6))
    of = {p: e for p, e in zip(pairs, errors, strict=True)}
    out = []
    for i in range(n):
        truths, found = len(seen[i]), len(guesses[i])
        chosen = []
        if truths and found:
            cost = np.array([[of[i, a, b].mean() for b in range(found)] for a in range(truths)])
            chosen = [of[i, a, b].tolist() for a, b in assignment(cost)]
        out.append({"n_gt": truths, "n_matched": len(chosen), "errs": chosen})
    return out


def match_hands(hands: Column | str, state: Column | str, extrinsics: Column | str) -> Column:
    """struct n_gt, n_matched, errs for predicted hands, a state vector and a 4 x 4 camera-to-world matrix as 16 numbers.

    A true hand counts if its wrist and fingertips all project in front of the camera. Hands are paired so that the sum
    of their mean errors is least; errors are in units of hand size, six per pair, in the order of the true tips, the
    wrist's being 0. Null hands are none, nor are those with fewer than 21 points or with wrist or tips that are no
    numbers; a null or short state or camera, or a camera matrix without an inverse, has no true hand. Rows are taken
    apart ``ROWS`` at a time, whatever Arrow's batches are: as Python objects and arrays of all pairs one takes some 40 kB.
    """
    kind = to_arrow_type(MATCH)

    @F.arrow_udf(MATCH)
    def matched(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            parts = [pa.array(match_batch(*(c.slice(i, ROWS).to_pylist() for c in columns)), kind) for i in range(0, len(columns[0]), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return matched(as_column(hands), as_column(state), as_column(extrinsics))
