"""Labels of windows and seconds from reference intervals; range joins by recording and cell of time (interval_join.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigevents.operators.interval_join import CELL_S, meeting


def label_any_overlap(windows: DataFrame, refs: DataFrame, seg: int, key: tuple[str, ...] = ("recording_id", "start_s"), cell_s: float | None = CELL_S) -> DataFrame:
    """``label`` 1 if the window overlaps any reference by more than nothing. The predicate is in the join, so unmatched rows stay null."""
    hit = meeting(windows.select(*key), refs, until=F.col("start_s") + seg, cell_s=cell_s).select(*key).distinct().withColumn("_hit", F.lit(1))
    return windows.join(hit, list(key), "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def label_fully_inside(windows: DataFrame, refs: DataFrame, seg: int, key: tuple[str, ...] = ("recording_id", "start_s"), cell_s: float | None = CELL_S) -> DataFrame:
    """1 inside one reference, 0 touching none; anything else has ``keep`` false."""
    touch = meeting(windows.select(*key), refs, until=F.col("start_s") + seg, cell_s=cell_s)
    seen = touch.groupBy(*key).agg(F.bool_or((F.col("_r0") <= F.col("start_s")) & (F.col("start_s") + seg <= F.col("_r1"))).alias("_in"))
    out = windows.join(seen, list(key), "left")
    return out.withColumns({"label": F.when(F.col("_in"), 1).otherwise(0), "keep": F.col("_in").isNull() | F.col("_in")}).drop("_in")


def non_overlapping(windows: DataFrame, seg: int, step: int) -> DataFrame:
    """Every k-th window by position, k = round(seg / step)."""
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s"))
    return windows.withColumn("_n", n - 1).where(F.col("_n") % max(1, round(seg / step)) == 0).drop("_n")


def label_seconds(curve: DataFrame, refs: DataFrame) -> DataFrame:
    """Seconds with p > 0; ``label`` 1 from floor(start) to ceil(stop) of a reference."""
    hot = refs.where("stop_s > start_s").select("recording_id", F.explode(F.sequence(F.floor("start_s").cast("int"), F.ceil("stop_s").cast("int") - 1)).alias("s")).distinct().withColumn("_hit", F.lit(1))
    return curve.where("p > 0").join(hot, ["recording_id", "s"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def peak_per_reference(windows: DataFrame, refs: DataFrame, seg: int, strict: bool = True, keep_unseen: bool = False, cell_s: float | None = CELL_S) -> DataFrame:
    """Highest score over each reference; overlap strict or inclusive; references without a window are dropped or 0."""
    w = windows.select("recording_id", "start_s", F.col("prob").cast("double").alias("_p"))
    met = meeting(w, refs, until=F.col("start_s") + seg, strict=strict, cell_s=cell_s)
    peaks = met.groupBy("recording_id", F.col("_r0").alias("start_s"), F.col("_r1").alias("stop_s")).agg(F.max("_p").alias("peak")).where("peak is not null")
    if not keep_unseen:
        return peaks
    return refs.select("recording_id", "start_s", "stop_s").distinct().join(peaks, ["recording_id", "start_s", "stop_s"], "left").fillna(0.0, ["peak"])


def background_stats(windows: DataFrame, refs: DataFrame, seg: int, cell_s: float | None = CELL_S) -> DataFrame:
    """Max and mean score per recording of the windows that touch no reference."""
    key = ["recording_id", "start_s"]
    quiet = windows.join(meeting(windows.select(*key), refs, until=F.col("start_s") + seg, cell_s=cell_s).select(*key).distinct(), key, "left_anti")
    return quiet.groupBy("recording_id").agg(F.max(F.col("prob").cast("double")).alias("bg_max"), F.avg(F.col("prob").cast("double")).alias("bg_mean"))


def recall_at(peaks: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Share of references whose peak reaches each threshold."""
    t = peaks.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return t.groupBy("threshold").agg(F.avg((F.col("peak") >= F.col("threshold")).cast("double")).alias("recall"), F.count("*").alias("n_refs"))
