"""Interval algebra: joining, dropping, clamping, intersecting. Columns start_s, stop_s; keys in ``by``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.operators.interval_join import CELL_S, meeting
from sigevents.sources.scratch import stored

REC = ("recording_id",)


def concatenate_nearby(events: DataFrame, gap: float, by: Sequence[str] = REC, touching: bool = False) -> DataFrame:
    """Join intervals whose start is less than ``gap`` after the running end (``touching``: at most).

    The running end is the greatest stop of all rows before, so nested intervals are right.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("start_s", "stop_s")
    end = F.max("stop_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("start_s") - end
    new = F.coalesce((room > gap) if touching else (room >= gap), F.lit(True)).cast("int")
    islands = events.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("start_s").alias("start_s"), F.max("stop_s").alias("stop_s")).drop("_island")


def discard_short(events: DataFrame, min_duration: float) -> DataFrame:
    return events.where(F.col("stop_s") - F.col("start_s") >= min_duration)


def shape_events(events: DataFrame, min_duration: float, gap: float, by: Sequence[str] = REC, strict_discard_first: bool = False) -> DataFrame:
    """Join, then drop short ones; or drop first."""
    if strict_discard_first:
        return concatenate_nearby(discard_short(events, min_duration), gap, by)
    return discard_short(concatenate_nearby(events, gap, by), min_duration)


def merge_overlapping(events: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Rows that overlap become one, to the greatest end."""
    return concatenate_nearby(events, 0.0, by)


def unscored_spans(windows: DataFrame, seg: int, by: Sequence[str] = REC) -> DataFrame:
    """Spans of skipped windows; touching ones join."""
    skipped = windows.where("coalesce(skip_code, 0) <> 0").select(*by, F.col("start_s").cast("double").alias("start_s"), (F.col("start_s") + seg).cast("double").alias("stop_s"))
    return concatenate_nearby(skipped, 0.0, by, touching=True)


def merge_binary_seconds(runs: DataFrame, min_gap: float, min_length: float, by: Sequence[str] = REC) -> DataFrame:
    """Legacy order: drop short runs first, then join gaps of up to ``min_gap``."""
    return concatenate_nearby(discard_short(runs, min_length), min_gap, by, touching=True)


def clamp_interval(start: Column, stop: Column, duration: Column, min_length: float) -> tuple[Column, Column]:
    """Swap if reversed, clamp to ``[0, duration]``, then give it a least length: to the right, then to the left."""
    a, b = F.least(start, stop), F.greatest(start, stop)
    a, b = F.least(F.greatest(a, F.lit(0.0)), duration), F.least(F.greatest(b, F.lit(0.0)), duration)
    wide = F.least(F.greatest(b, a + min_length), duration)
    return F.greatest(F.least(a, wide - min_length), F.lit(0.0)), wide


def intersect_hypotheses(a: DataFrame, b: DataFrame, by: Sequence[str] = REC, cell_s: float | None = CELL_S) -> DataFrame:
    """All overlapping pairs: their common part and mean confidence."""
    by = list(by)
    both = meeting(a.select(*by, "start_s", "stop_s", "confidence"), b.withColumn("_bc", F.col("confidence")), by, keep=["_bc"], cell_s=cell_s)
    return both.select(*by, F.greatest("start_s", "_r0").alias("start_s"), F.least("stop_s", "_r1").alias("stop_s"), ((F.col("confidence") + F.col("_bc")) / 2).alias("confidence"))


def pairwise_discard(events: DataFrame, gap: float = 10.0, min_duration: float = 5.0, by: Sequence[str] = REC) -> DataFrame:
    """One pass against the row before: far from it, keep if long; near it, both long, give the joined extent."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("start_s", "stop_s")
    x = events.withColumns({"_p0": F.lag("start_s").over(w), "_p1": F.lag("stop_s").over(w)})
    own, before = F.col("stop_s") - F.col("start_s") > min_duration, F.col("_p1") - F.col("_p0") > min_duration
    far = F.col("_p0").isNull() | (F.col("start_s") - F.col("_p1") > gap)
    return x.where(own & (far | before)).withColumn("start_s", F.when(far, F.col("start_s")).otherwise(F.col("_p0"))).drop("_p0", "_p1")


def discarded_runs(runs: DataFrame, kept: DataFrame, by: Sequence[str] = REC, cell_s: float | None = CELL_S) -> DataFrame:
    """Threshold runs that no kept event contains."""
    by = list(by)
    runs, key = stored(runs, "runs"), [*by, "start_s", "stop_s"]
    held = meeting(runs.select(*key), kept, by, strict=False, cell_s=cell_s).where("_r0 <= start_s and stop_s <= _r1").select(*key).distinct()
    return runs.join(held, key, "left_anti")
