"""Arms, drift, splits, review counts and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.operators.metrics import quantiles


def pair_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Windows scored in both arms, joined on recording and start."""
    ok = F.coalesce(F.col("skip_code"), F.lit(0)) == 0
    x, y = (d.where(ok).select("recording_id", "start_s", F.col("prob").alias(n)) for d, n in ((a, "prob_a"), (b, "prob_b")))
    return x.join(y, ["recording_id", "start_s"])


def arm_set_ops(a: DataFrame, b: DataFrame) -> DataFrame:
    """Window starts in both arms and in one alone, as counts."""
    x, y = (d.select("recording_id", "start_s") for d in (a, b))
    named = [(x.intersect(y), "both"), (x.exceptAll(y), "only_a"), (y.exceptAll(x), "only_b"), (x.unionByName(y).distinct(), "either")]
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for d, n in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def ambiguous_stems(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").select("stem")


def unequal_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Recordings whose window starts differ between arms: one digest a recording and arm."""
    digest = lambda d, n: d.groupBy("recording_id").agg(F.struct(F.count("*"), F.sum(F.xxhash64("start_s").cast("decimal(20)"))).alias(n))
    return digest(a, "_a").join(digest(b, "_b"), "recording_id").where("_a <> _b").select("recording_id")


def drift_report(a: DataFrame, b: DataFrame, threshold: float, refused: DataFrame | None = None) -> DataFrame:
    """Score differences of paired windows: median, upper quantiles, greatest, flips at the threshold, identical ones.

    Recordings with unequal window grids are left out, and those in ``refused`` (recording_id; see :func:`refusals`).
    """
    bad = unequal_grids(a, b)
    bad = bad.unionByName(refused.select("recording_id")).distinct() if refused is not None else bad
    pairs = pair_arms(a.join(bad, "recording_id", "left_anti"), b.join(bad, "recording_id", "left_anti"))
    pairs = pairs.select(F.col("prob_a").cast("double").alias("x"), F.col("prob_b").cast("double").alias("y")).withColumn("d", F.abs(F.col("x") - F.col("y"))).persist()
    q = quantiles(pairs, F.col("d"), [0.5, 0.95, 0.99]) or [None] * 3
    named = [F.lit(v).cast("double").alias(n) for v, n in zip(q, ("median", "p95", "p99"), strict=True)]
    got = pairs.agg(F.count("*").alias("n"), F.max("d").alias("largest"), F.count_if((F.col("x") >= threshold) != (F.col("y") >= threshold)).alias("flips"), F.count_if(F.col("d") == 0).alias("identical"))
    return got.select("n", *named, "largest", "flips", "identical")


def refusals(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording_id, reason of recordings (recording_id, stem, sha256) that cannot be compared: an ambiguous stem in an arm, or other content."""
    stem = lambda d: d.join(ambiguous_stems(d), "stem", "left_semi").select("recording_id", F.lit("ambiguous").alias("reason"))
    other = a.select("recording_id", "sha256").join(b.select("recording_id", F.col("sha256").alias("_s")), "recording_id").where("sha256 <> _s").select("recording_id", F.lit("content").alias("reason"))
    return stem(a).unionByName(stem(b)).unionByName(other).groupBy("recording_id").agg(F.min("reason").alias("reason"))


def event_totals(compared: DataFrame) -> DataFrame:
    """Sums of a comparison of event lists over all recordings, and the greatest shift."""
    return compared.agg(*[F.sum(c).alias(c) for c in ("matched", "lost", "gained")], F.max("max_shift").alias("max_shift"))


def worst_recordings(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    d = F.max(F.abs(F.col("prob_a").cast("double") - F.col("prob_b").cast("double"))).alias("largest")
    return pair_arms(a, b).groupBy("recording_id").agg(d).orderBy(F.desc("largest"), "recording_id").limit(k)


def patient_of(stem: Column) -> Column:
    return F.element_at(F.split(stem, "_"), 1)


def session_key(stem: Column) -> Column:
    """Parts 0, 1, 2 and 5 of a sample name, the last without its four-character extension."""
    p = F.split(stem, "_")
    last = F.coalesce(F.get(p, F.lit(5)), F.lit(""))
    return F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.substring(last, F.lit(1), F.greatest(F.length(last) - 4, F.lit(0))))


def grouped_split(samples: DataFrame, key: str, val_ratio: float = 0.25, seed: str = "0") -> DataFrame:
    """``part`` train or val: of each label's keys, in the order of a hash, the last share goes to val. Labels are split on their own."""
    keys = samples.select("label", key).distinct()
    w = Window.partitionBy("label")
    order = w.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key)
    n = F.count("*").over(w)
    part = F.when(F.row_number().over(order) > n - F.floor(n * val_ratio), "val").otherwise("train")
    return samples.join(keys.withColumn("part", part), ["label", key])


def class_weights(train: DataFrame) -> DataFrame:
    n = train.groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", (F.sum("n").over(Window.partitionBy(F.lit(0))) / (F.col("n") + 1e-6)).alias("weight"))  # one row a class


def oversample_minority(samples: DataFrame) -> DataFrame:
    """Positives repeated int(n_background / n_positive) times."""
    n = samples.agg(F.count_if(F.col("label") == 0).alias("b"), F.count_if(F.col("label") == 1).alias("p")).select(F.coalesce(F.try_divide("b", "p").cast("int"), F.lit(1)).alias("_k"))
    times = F.when(F.col("label") == 1, F.greatest(F.col("_k"), F.lit(1))).otherwise(1)
    return samples.join(F.broadcast(n)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_k")  # one row


def split_leakage(train: DataFrame, dev: DataFrame) -> DataFrame:
    """Patients on both sides, and the share of the dev side's rows that are theirs."""
    both = train.select("patient_id").intersect(dev.select("patient_id"))
    shared = dev.join(both, "patient_id", "left_semi").agg(F.count("*").alias("shared_rows"))
    return both.agg(F.count("*").alias("patients")).join(F.broadcast(shared)).join(F.broadcast(dev.agg(F.count("*").alias("rows")))).withColumn("share", F.try_divide("shared_rows", "rows"))


def interval_coverage_check(intervals: DataFrame) -> DataFrame:
    """Per recording: whether it begins at 0, gaps and overlaps between neighbours."""
    w = Window.partitionBy("recording_id").orderBy("start_s", "stop_s")
    d = F.col("start_s") - F.lag("stop_s").over(w)
    return intervals.withColumn("_d", d).groupBy("recording_id").agg((F.min("start_s") == 0).alias("from_zero"), F.count_if(F.col("_d") > 0).alias("gaps"), F.count_if(F.col("_d") < 0).alias("overlaps"))


def boundary_fingerprint_match(a: DataFrame, b: DataFrame, tol: float = 0.05) -> DataFrame:
    """Pairs of recordings that share interval boundaries, exactly or within ``tol``.

    Joined on the cells of start and stop, the one side with their neighbours, so that intervals that
    merely begin alike (as at 0) do not meet.
    """
    cell = lambda c: F.floor(F.col(c) / tol).cast("long")
    around = [F.struct((cell("start_s") + i).alias("c"), (cell("stop_s") + j).alias("d")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    x = a.select(F.col("recording_id").alias("rec_a"), F.col("start_s").alias("a0"), F.col("stop_s").alias("a1"), F.explode(F.array(*around)).alias("_c")).select("*", "_c.*")
    y = b.select(F.col("recording_id").alias("rec_b"), F.col("start_s").alias("b0"), F.col("stop_s").alias("b1"), cell("start_s").alias("c"), cell("stop_s").alias("d"))
    near = x.join(y, ["c", "d"]).where((F.abs(F.col("a0") - F.col("b0")) <= tol) & (F.abs(F.col("a1") - F.col("b1")) <= tol))
    return near.groupBy("rec_a", "rec_b").agg(F.count("*").alias("shared"), F.count_if((F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))).alias("exact"))


def build_manifest(recordings: DataFrame, annotations: DataFrame, windows: DataFrame, seg: int) -> DataFrame:
    """Cohort, reference count and seconds, duration (header, else last window's end, else 0), whether scored."""
    ann = annotations.groupBy("recording_id").agg(F.count("*").alias("seiz_count"), F.sum(F.col("stop_s") - F.col("start_s")).alias("seiz_total_s"))
    w = windows.groupBy("recording_id").agg((F.max("start_s") + seg).cast("double").alias("_end"))
    out = recordings.join(ann, "recording_id", "left").join(w, "recording_id", "left").fillna(0, ["seiz_count"]).fillna(0.0, ["seiz_total_s"])
    cohort = F.when(~F.col("has_reference"), "unannotated").when(F.col("seiz_count") > 0, "seizure").otherwise("nonseizure")
    return out.withColumns({"cohort": cohort, "duration_s": F.coalesce("duration_s", "_end", F.lit(0.0)), "cached": F.col("_end").isNotNull().cast("int")}).drop("_end")


def corpus_totals(manifest: DataFrame) -> DataFrame:
    m = manifest.where("cohort <> 'unannotated'")
    return m.agg(F.count("*").alias("recordings"), (F.sum("duration_s") / 3600).alias("hours"), (F.sum("seiz_total_s") / 3600).alias("ictal_hours"), F.try_divide(F.sum("seiz_total_s"), F.sum("duration_s")).alias("ictal_share"))


def review_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("recording_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "accepted", "edited", "rejected", "added")])


def export_selection(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Accepted, edited and added events, clamped, with confidence 1 and the model's score apart."""
    e = events.where(F.col("status").isin("accepted", "edited", "added")).join(durations.select("recording_id", "duration_s"), "recording_id")
    return e.select("recording_id", F.greatest("start_s", F.lit(0.0)).alias("start_s"), F.least("stop_s", "duration_s").alias("stop_s"), F.lit(1.0).alias("confidence"), F.col("prob").alias("model_score"), (F.col("status") == "added").alias("human_originated")).where("stop_s > start_s")


def export_summary(events: DataFrame, windows: DataFrame, durations: DataFrame) -> DataFrame:
    """Per recording: exported events, windows that were never assessed, and whether the export is empty."""
    n = export_selection(events, durations).groupBy("recording_id").agg(F.count("*").alias("exported"))
    w = windows.groupBy("recording_id").agg(F.count_if(F.coalesce(F.col("skip_code"), F.lit(0)) != 0).alias("unassessed"))
    out = durations.select("recording_id").join(n, "recording_id", "left").join(w, "recording_id", "left").fillna(0, ["exported", "unassessed"])
    return out.withColumn("empty_export", F.col("exported") == 0)


def scoring_backlog(recordings: DataFrame, runs: DataFrame) -> DataFrame:
    """Recordings without a run, or whose size differs or whose time of change differs by more than a second."""
    r = runs.select("recording_id", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    stale = F.col("_s").isNull() | (F.col("size") != F.col("_s")) | (F.abs(F.col("mtime") - F.col("_m")) > 1)
    return recordings.join(r, "recording_id", "left").where(stale).drop("_s", "_m")
