"""Grids of windows, slices of signals, and tiles of labelled intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_starts(duration: Column, seg: int, step: int) -> Column:
    """0, step, ... to the last whole window; an empty array for shorter recordings."""
    last = F.floor(duration).cast("int") - seg
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def window_grid(recordings: DataFrame, seg: int, step: int) -> DataFrame:
    return recordings.select("recording_id", F.explode(grid_starts(F.col("duration_s"), seg, step)).alias("start_s"))


def slice_windows(signals: DataFrame, grid: DataFrame, seg: int, fs: int, block_len: int) -> DataFrame:
    """Samples of each window and channel; blocks of ``block_len`` samples meet windows on recording and block. Incomplete windows have skip_code 3."""
    a, b = F.col("start_s") * fs, (F.col("start_s") + seg) * fs
    need = grid.withColumn("block_idx", F.explode(F.sequence(F.floor(a / block_len).cast("int"), F.floor((b - 1) / block_len).cast("int"))))
    lo = F.greatest(a - F.col("block_idx") * block_len, F.lit(0))
    part = F.slice("samples", lo + 1, F.least(b - F.col("block_idx") * block_len, F.lit(block_len)) - lo)
    parts = need.join(signals.select("recording_id", "channel", "block_idx", "samples"), ["recording_id", "block_idx"]).select("recording_id", "start_s", "channel", "block_idx", part.alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", "_p")))
    out = parts.groupBy("recording_id", "start_s", "channel").agg(F.flatten(F.transform(ordered, lambda x: x["_p"])).alias("samples"))
    return out.withColumn("skip_code", F.when(F.size("samples") < seg * fs, 3).otherwise(0))


def tile_labelled_intervals(intervals: DataFrame, seg: int, stride_seiz: int, stride_bckg: int) -> DataFrame:
    """Starts st + i while st + i + seg < sp (strict); the label is inherited, the stride depends on it."""
    stride = F.when(F.col("label") == "seiz", stride_seiz).otherwise(stride_bckg)
    n = F.ceil((F.col("stop_s") - F.col("start_s") - seg) / stride).cast("int")
    return intervals.where(F.col("stop_s") - F.col("start_s") > seg).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).select("recording_id", (F.col("start_s") + F.col("_i") * stride).alias("start_s"), "label")


# Seconds before an onset from which extra positives start, by window length.
PRE_ONSET = {3: (1, 2), 5: (3, 4), 7: (3, 6)}


def pre_onset_windows(intervals: DataFrame, seg: int, offsets: tuple[int, int] | None = None) -> DataFrame:
    """Extra positives that start shortly before an onset and lie wholly in the recording."""
    lo, hi = offsets or PRE_ONSET[seg]
    s = intervals.where("label = 'seiz'").withColumn("_o", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return s.select("recording_id", (F.col("start_s") - F.col("_o")).alias("start_s"), "label", "duration_s").where(F.col("start_s") >= 0).where(F.col("start_s") + seg <= F.col("duration_s")).drop("duration_s")


def resolve_end(intervals: DataFrame, recordings: DataFrame) -> DataFrame:
    """A null stop is the recording's end."""
    return intervals.join(recordings.select("recording_id", "duration_s"), "recording_id").withColumn("stop_s", F.coalesce("stop_s", "duration_s"))
