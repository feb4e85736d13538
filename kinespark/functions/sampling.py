"""Uniform frame sampling, as a Column and as plain Python for workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def sample_indexes(length: Column | str, max_frames: int = 8) -> Column:
    """At most ``max_frames`` frame numbers spread over ``length`` frames, first and last among them.

    Short episodes keep all frames, ``max_frames=1`` keeps the last, and ties round half to
    even. A null, zero or negative length gives an empty array, as does ``max_frames < 1``.
    """
    n = F.coalesce(as_column(length).cast("long"), F.lit(0).cast("long"))
    none = F.array().cast("array<bigint>")
    whole = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))
    if max_frames < 1:
        spread = none
    elif max_frames == 1:
        spread = F.array(n - 1)
    else:
        steps = F.sequence(F.lit(0), F.lit(max_frames - 1))
        place = lambda i: F.bround(i * (n - 1).cast("double") / F.lit(float(max_frames - 1)), 0).cast("long")
        spread = F.array_sort(F.array_distinct(F.transform(steps, place)))
    return F.when(n <= 0, none).when(n <= max_frames, whole).otherwise(spread)


def sampled(length: int, max_frames=8) -> list:
    """``sample_indexes`` of one length, in a worker."""
    if length <= 0 or max_frames < 1:
        return list(range(max(0, length))) if length <= max_frames else []
    if length <= max_frames:
        return [*range(length)]
    if max_frames == 1:
        return [length - 1]
    step = float(max_frames - 1)
    return sorted({round(k * float(length - 1) / step) for k in range(max_frames)})
