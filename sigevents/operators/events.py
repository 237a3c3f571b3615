"""Events from windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigevents.config import DEFAULT, OperatingPoint
from sigevents.operators.curves import threshold_events
from sigevents.operators.intervals import clamp_interval


def threshold_table(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each row once for each threshold; a literal array, so nothing is joined."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def events_from_windows(windows: DataFrame, durations: DataFrame, thresholds: Sequence[float], op: OperatingPoint = DEFAULT, average: bool = True, shape: bool = True, skip_policy: str = "zero") -> DataFrame:
    """recording_id, threshold, start_s, stop_s, prob: the whole stage from scores to clamped events, for all thresholds from one sweep (curves.py)."""
    return threshold_events(windows, durations, thresholds, op.seg, op.min_duration, op.merge_gap, average, (shape,), skip_policy).drop("shaped")


def consecutive_window_events(windows: DataFrame, threshold: float, seg: int, durations: DataFrame) -> DataFrame:
    """Legacy: consecutive rows at or above the threshold are one event, whatever time lies between."""
    w = Window.partitionBy("recording_id").orderBy("start_s")
    hot = windows.withColumn("_n", F.row_number().over(w)).where(F.col("prob").cast("double") >= threshold)
    runs = hot.withColumn("_i", F.col("_n") - F.row_number().over(w)).groupBy("recording_id", "_i").agg(F.min("start_s").cast("double").alias("a"), (F.max("start_s") + seg).cast("double").alias("b"), F.max("prob").cast("double").alias("prob"))
    a, b = clamp_interval(F.col("a"), F.col("b"), F.col("duration_s"), 0.1)
    return runs.join(durations.select("recording_id", "duration_s"), "recording_id").select("recording_id", a.alias("start_s"), b.alias("stop_s"), "prob")


def assign_event_ids(events: DataFrame) -> DataFrame:
    """Ids in order of time: valid unique ones are kept, the others take the lowest free numbers."""
    by_rec = Window.partitionBy("recording_id")
    order = by_rec.orderBy("start_s", "stop_s")
    first = F.row_number().over(Window.partitionBy("recording_id", "event_id").orderBy("start_s", "stop_s")) == 1
    kept = events.withColumn("_keep", (F.col("event_id") > 0) & F.col("event_id").isNotNull() & first)
    kept = kept.withColumn("_used", F.collect_set(F.when(F.col("_keep"), F.col("event_id"))).over(by_rec)).withColumn("_n", F.count("*").over(by_rec).cast("int"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("_n") + F.size("_used")), F.transform("_used", lambda x: x.cast("int"))))
    nth = F.sum(F.when(F.col("_keep"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return kept.withColumn("event_id", F.when(F.col("_keep"), F.col("event_id").cast("int")).otherwise(F.get(free, nth - 1))).drop("_keep", "_used", "_n")
