"""From window scores to one value per second, and runs of seconds above a threshold.

Windows: recording_id, start_s, prob (float), skip_code; an extra key such as ``arm`` goes in ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.operators import curves

REC = ("recording_id",)


def per_second(windows: DataFrame, durations: DataFrame, seg: int, how: str = "mean", skip_policy: str = "zero", by: Sequence[str] = REC, span_s: int = curves.SPAN_S) -> DataFrame:
    """One row per second of ``[0, ceil(duration_s))``: the mean (or max) of the windows over it, 0 where none is.

    The mean is summed in double and rounded to float, as scores are. ``durations``: recording_id, duration_s.
    ``skip_policy``: ``exclude`` leaves windows out that were never scored, ``zero`` keeps them as they are.
    Stretches of ``span_s`` seconds are swept by themselves (curves.py).
    """
    return curves.per_second(windows, durations, seg, how, skip_policy, by, span_s)


def trailing_mean(predictions: DataFrame, m: int, total: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Second i: the mean over the windows of ``m`` seconds at stride 1 that cover it, fewer at both ends."""
    return per_second(predictions, total, m, by=by)


def binarise(p: Column, threshold: float | Column) -> Column:
    return (p.cast("double") >= threshold).cast("int")


def majority_vote(a: DataFrame, b: DataFrame, c: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Per-second majority of three 0/1 series (column ``y``)."""
    return a.unionByName(b).unionByName(c).groupBy(*by, "s").agg((F.sum("y") >= 2).cast("int").alias("y"))


def runs_above(curve: DataFrame, threshold: float | Column, by: Sequence[str] = REC) -> DataFrame:
    """Maximal runs of seconds with p >= threshold, as ``[start_s, stop_s)``; only hot seconds are ranked."""
    by = list(by)
    hot = curve.where(F.col("p").cast("double") >= threshold)
    island = F.col("s") - F.row_number().over(Window.partitionBy(*by).orderBy("s"))
    runs = hot.withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return runs.select(*by, F.col("a").cast("double").alias("start_s"), (F.col("b") + 1).cast("double").alias("stop_s"))


def label_runs(series: DataFrame, threshold: float, by: Sequence[str] = REC) -> DataFrame:
    """Positive runs of a 0/1 series ``y``, each with the threshold as its confidence."""
    return runs_above(series.withColumn("p", F.col("y")), 1.0, by).withColumn("confidence", F.lit(threshold))
