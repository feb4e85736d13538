"""Accuracy of hand tracking as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column, named

THRESHOLDS = (0.1, 0.2, 0.3)


def by_method(frames: DataFrame, scores: Mapping[str, Column | str]) -> DataFrame:
    """One row per frame and label from one score column per label: label, score."""
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), as_column(c).alias("score")) for k, c in scores.items()))
    return frames.select(F.inline(pairs))


def report(scored: DataFrame, *, label: str = "label", score: str = "score", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per label: n_gt, n_matched, detect (percent), mean_err and PCK columns.

    ``detect`` is 0 without true hands. ``mean_err`` is the mean over hands of each hand's mean error, NaN without any.
    PCK is the percentage of all keypoint errors strictly below a threshold, 0 without any. Each row folds its own
    errors first, so what is shuffled is one partial sum per label and task, never the errors. A row without a score
    adds nothing; it is skipped by the sums and not by a filter, which Spark would push below the score's kernel and
    so run it twice. A label without any score isn't reported.
    """
    s = named(score)
    errors = F.flatten(s.getField("errs"))
    below = lambda t: F.when(errors.isNotNull(), F.size(F.filter(errors, lambda e: (e < t) & ~F.isnan(e))))
    mean = lambda hand: F.aggregate(hand, F.lit(0.0), lambda a, e: a + e) / F.size(hand)
    rows = scored.select(
        named(label).alias("label"),
        s.getField("n_gt").alias("gt"),
        s.getField("n_matched").alias("matched"),
        F.when(errors.isNotNull(), F.size(errors)).alias("points"),
        F.when(s.getField("errs").isNotNull(), F.size(s.getField("errs"))).alias("hands"),
        F.aggregate(F.transform(s.getField("errs"), mean), F.lit(0.0), lambda a, m: a + m).alias("means"),
        *(below(t).alias(f"below_{i}") for i, t in enumerate(thresholds)),
    )
    total = rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in rows.columns[1:])).where("gt IS NOT NULL")
    pck = [F.when(F.col("points") > 0, 100.0 * F.col(f"below_{i}") / F.col("points")).otherwise(0.0).alias(f"pck_{t:g}".replace(".", "_")) for i, t in enumerate(thresholds)]
    return total.select(
        F.col("label").alias(label),
        F.col("gt").alias("n_gt"),
        F.col("matched").alias("n_matched"),
        F.when(F.col("gt") > 0, 100.0 * F.col("matched") / F.col("gt")).otherwise(0.0).alias("detect"),
        F.when(F.col("hands") > 0, F.col("means") / F.col("hands")).otherwise(F.lit(float("nan"))).alias("mean_err"),
        *pck,
    )
