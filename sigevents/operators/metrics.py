"""Ranking metrics, reliability and per-recording statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.sources.scratch import stored


def in_ranges(df: DataFrame, column: str, bounds: Sequence[float], out: str) -> DataFrame:
    """``df`` with the number of the range between ``bounds`` that a number of ``column`` is in."""
    inner = sorted({x for x in bounds if abs(x) < float("inf")})
    if not inner:
        return df.withColumn(out, F.lit(0))
    return Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol=column, outputCol=out).transform(df).withColumn(out, F.col(out).cast("int"))


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = True, parts: int | None = None) -> DataFrame:
    """Running sums over all rows in order of a number, without a one-task window: ranges of ``order``
    are summed on their own, and each adds the totals of those before it.

    The ranges' bounds are numbers found once, so a row is of the same range however often and in
    whatever partitions the table is read; ``parts`` ranges, or as many as shuffle partitions. Rows
    without a number are left out; equal ones follow in any order.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))).withColumn("_order", F.col(order).cast("double"))
    found = df.agg(F.percentile_approx("_order", [k / n for k in range(1, n)], 100 * n).alias("b")).first().b if n > 1 else []
    ranged = in_ranges(df, "_order", found or [], "_part")
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).collect()
    rows, run = [], dict.fromkeys(values, 0)
    for r in sorted(totals, key=lambda r: r["_part"], reverse=descending):
        rows.append((r["_part"], *[run[v] for v in values]))
        run = {v: run[v] + (r[v] or 0) for v in values}
    base = spark.createDataFrame(rows, "_part int, " + ", ".join(f"_base_{v} long" for v in values))
    w = Window.partitionBy("_part").orderBy(F.desc("_order") if descending else F.asc("_order")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).join(F.broadcast(base), "_part")  # one row a range
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"_base_{v}") for v in values}).drop("_part", "_order", *[f"_base_{v}" for v in values])


def quantiles(df: DataFrame, value: Column, qs: Sequence[float]) -> list[float] | None:
    """Exact linear quantiles of all values, from counts of distinct ones; at most two rows for each come to the driver."""
    t = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n")).persist()
    total = t.agg(F.sum("n")).first()[0]
    if not total:
        return None
    places = [q * (total - 1) for q in qs]
    wanted = sorted({int(i) for x in places for i in (math.floor(x), math.ceil(x))})
    ends = prefix_sums(t, "v", ["n"], descending=False)
    hit = ends.select("v", F.explode(F.filter(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: (i < F.col("cum_n")) & (i >= F.col("cum_n") - F.col("n")))).alias("i"))
    at = {r.i: r.v for r in hit.collect()}
    t.unpersist()
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places]


def score_table(df: DataFrame, by: Sequence[str] = (), score: str = "prob", label: str = "label") -> DataFrame:
    """Distinct scores with counts of both classes and running counts from the highest score down."""
    t = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    if not by:
        return prefix_sums(t.persist(), "score", ["pos", "neg"])  # the distinct scores are read three times
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({"cum_pos": F.sum("pos").over(w), "cum_neg": F.sum("neg").over(w)})


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "prob", label: str = "label") -> DataFrame:
    """Exact rank AUC, ties count half; null if a class is missing."""
    t = score_table(df, by, score, label)
    above = (F.col("cum_pos") - F.col("pos")) + F.col("pos") / 2
    g = t.groupBy(*by).agg(F.sum(F.col("neg") * above).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*by, F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, by: Sequence[str] = (), score: str = "prob", label: str = "label") -> DataFrame:
    """Sum of precision times the step of recall, over distinct scores from the top."""
    t = score_table(df, by, score, label)
    g = t.groupBy(*by).agg(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_s"), F.sum("pos").alias("n_pos"))
    return g.select(*by, F.try_divide(F.col("_s"), F.col("n_pos")).alias("ap"), "n_pos")


def curve_points(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """ROC and precision-recall points at each distinct threshold."""
    t = score_table(df, (), score, label)
    totals = t.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    t = t.join(F.broadcast(totals))  # one row
    return t.select(F.col("score").alias("threshold"), F.try_divide(F.col("cum_neg"), F.col("_n")).alias("fpr"), F.try_divide(F.col("cum_pos"), F.col("_p")).alias("tpr"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def window_stats(labelled: DataFrame) -> DataFrame:
    """Windows, positives and excluded ones, per recording and pooled (null recording)."""
    ok = F.coalesce(F.col("skip_code"), F.lit(0)) == 0
    return labelled.rollup("recording_id").agg(F.count("*").alias("n_windows"), F.count_if(ok & (F.col("label") == 1)).alias("n_positive"), F.count_if(~ok).alias("n_excluded"))


def review_simulation(windows: DataFrame, cohorts: DataFrame, threshold: float) -> DataFrame:
    """A recording is flagged if any score reaches the threshold: recall, false-flag rate, candidate windows."""
    hot = F.col("prob").cast("double") >= threshold
    rec = windows.groupBy("recording_id").agg(F.bool_or(hot).alias("flag"), F.count_if(hot).alias("n")).join(cohorts, "recording_id")
    sick = F.col("cohort") == "seizure"
    return rec.agg(F.count_if(sick & F.col("flag")).alias("flagged_positive"), F.count_if(sick).alias("n_positive"), F.count_if(~sick & F.col("flag")).alias("flagged_negative"), F.count_if(~sick).alias("n_negative"), F.sum("n").alias("candidates"), F.sum("duration_s").alias("duration_s")).withColumns({"recall": F.try_divide("flagged_positive", "n_positive"), "false_flag_rate": F.try_divide("flagged_negative", "n_negative"), "candidates_per_hour": F.try_divide(F.col("candidates") * F.lit(3600.0), F.col("duration_s"))})


def probability_stats(windows: DataFrame) -> DataFrame:
    p = F.col("prob").cast("double")
    return windows.groupBy("recording_id").agg(F.max(p).alias("p_max"), F.percentile(p, 0.9).alias("p90"), F.avg(p).alias("p_mean"))


def infer_step(windows: DataFrame) -> DataFrame:
    """Rounded median distance of window starts; null with fewer than two windows."""
    d = F.col("start_s") - F.lag("start_s").over(Window.partitionBy("recording_id").orderBy("start_s"))
    return windows.withColumn("_d", d).groupBy("recording_id").agg(F.rint(F.percentile("_d", 0.5)).cast("int").alias("step"))


def step_mismatches(windows: DataFrame, step: int) -> DataFrame:
    return infer_step(windows).where(F.col("step") != step)


def bin_edges(df: DataFrame, n_bins: int, strategy: str, p: Column) -> list[float]:
    """Edges of equal width, or distinct linear quantiles with the ends at 0 and just over 1."""
    if strategy == "width":
        edges = [i / n_bins for i in range(n_bins + 1)]
    else:
        edges = sorted(set(quantiles(df, p, [i / n_bins for i in range(n_bins + 1)]) or [0.0, 1.0]))
        edges[0] = 0.0
    if len(edges) < 2:
        edges = [0.0, 1.0]
    edges[-1] = 1 + 1e-9
    return edges


def reliability(df: DataFrame, n_bins: int = 15, strategy: str = "quantile", score: str = "prob", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per bin ``[lo, hi)``: n, mean score, observed rate, positives; empty bins are absent."""
    p = F.col(score).cast("double")
    edges = F.array(*map(F.lit, bin_edges(df, n_bins, strategy, p)))
    index = F.size(F.filter(edges, lambda e: e <= p)) - 1
    return df.withColumn("bin", index).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"), F.sum(label).alias("n_pos"))


def ece_mce(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier_decomposition(df: DataFrame, bins: DataFrame, score: str = "prob", label: str = "label", eps: float = 1e-6) -> DataFrame:
    """Brier score, reliability, resolution, uncertainty, what is left, and log loss."""
    p, y = F.col(score).cast("double"), F.col(label)
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    whole = df.agg(F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(y.cast("double")).alias("base_rate"), F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    b = bins.join(F.broadcast(whole.select("base_rate")))  # one row
    parts = b.agg((F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("observed"), 2)) / F.sum("n")).alias("reliability"), (F.sum(F.col("n") * F.pow(F.col("observed") - F.col("base_rate"), 2)) / F.sum("n")).alias("resolution"))
    out = whole.join(F.broadcast(parts)).withColumn("uncertainty", F.col("base_rate") * (1 - F.col("base_rate")))
    return out.withColumn("residual", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def precision_at_threshold(df: DataFrame, threshold: float, score: str = "prob", label: str = "label") -> DataFrame:
    return df.where(F.col(score).cast("double") >= threshold).agg(F.avg(F.col(label).cast("double")).alias("precision"), F.count("*").alias("n"))


def false_positive_concentration(false: DataFrame, recordings: DataFrame) -> DataFrame:
    """False-positive windows per recording, most first, with rank and the running share of all; ties in order of the recording."""
    n = recordings.select("recording_id").join(false.groupBy("recording_id").agg(F.count("*").alias("n")), "recording_id", "left").fillna(0, ["n"])
    # recordings with as many are ranked among themselves, those with more by sums over distinct numbers
    same = n.groupBy(F.col("n").alias("n")).agg(F.count("*").alias("_of"), F.sum("n").alias("_sum"))
    total = same.agg(F.sum("_sum").alias("_total"))
    before = prefix_sums(same, "n", ["_of", "_sum"]).select("n", (F.col("cum__of") - F.col("_of")).alias("_ahead"), (F.col("cum__sum") - F.col("_sum")).alias("_more"))
    own = F.row_number().over(Window.partitionBy("n").orderBy("recording_id"))
    ranked = n.withColumn("_own", own).join(before, "n").join(F.broadcast(total))  # one row
    return ranked.select("recording_id", "n", (F.col("_ahead") + F.col("_own")).alias("rank"), F.try_divide(F.col("_more") + F.col("_own") * F.col("n"), "_total").alias("share"))


def background_percentiles(windows: DataFrame, q: float = 0.85) -> DataFrame:
    """Per recording: the q-quantile of its scored windows' scores."""
    return windows.where("coalesce(skip_code, 0) = 0").groupBy("recording_id").agg(F.percentile(F.col("prob").cast("double"), q).alias("background"))


def aggregate_arms(runs: DataFrame) -> DataFrame:
    """Counts summed per arm, rates from the sums."""
    sums = runs.groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("n_refs", "n_preds", "hits", "misses", "false_positives", "duplicates", "duration_s")])
    return sums.withColumns({"sensitivity": F.try_divide("hits", "n_refs"), "fp_per_24h": F.try_divide(F.col("false_positives") * F.lit(86400.0), F.col("duration_s"))})


def arm_auc(pairs: DataFrame, arms: dict[str, str], baseline: str, label: str = "label") -> DataFrame:
    """arm, auc, n_pos, n_neg, delta_auc (its distance from the baseline's) over windows that all arms have scored; ``arms``: name to column."""
    pairs, out = stored(pairs.select(*arms.values(), label), "pairs"), None
    for arm, score in arms.items():
        found = roc_auc(pairs, score=score, label=label).withColumn("arm", F.lit(arm))
        out = found if out is None else out.unionByName(found)
    out = stored(out, "areas")  # a row each
    base = out.where(F.col("arm") == baseline).select(F.col("auc").alias("_base"))
    return out.join(F.broadcast(base)).select("arm", "auc", "n_pos", "n_neg", (F.col("auc") - F.col("_base")).alias("delta_auc"))


def arm_deltas(per_arm: DataFrame, baseline: str, columns: Sequence[str] = ("sensitivity", "fp_per_24h")) -> DataFrame:
    base = per_arm.where(F.col("arm") == baseline).select(*[F.col(c).alias(f"_{c}") for c in columns])
    return per_arm.where(F.col("arm") != baseline).join(F.broadcast(base)).select("arm", *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in columns])


def matched_sensitivity(a: DataFrame, b: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Lowest false-alarm rate at which each curve reaches each target; change in per cent."""
    def best(c: DataFrame, name: str) -> DataFrame:
        t = c.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("sensitivity") >= F.col("target") - 1e-9)
        return t.groupBy("target").agg(F.min("fp_per_24h").alias(name))

    both = best(a, "fa_a").join(best(b, "fa_b"), "target")
    return both.withColumns({"change_pct": F.try_divide((F.col("fa_b") - F.col("fa_a")) * 100, F.col("fa_a")), "b_wins": F.col("fa_b") < F.col("fa_a")})


def adaptive_reference(windows: DataFrame, q: float = 0.85, floor: float = 0.5, least: int = 20) -> DataFrame:
    """Per recording: the q-quantile of scored windows, at least ``floor``; the floor with fewer than ``least`` windows. Scaled scores never rise; skipped ones stay 0."""
    w = Window.partitionBy("recording_id")
    ok = F.coalesce(F.col("skip_code"), F.lit(0)) == 0
    p = F.col("prob").cast("double")
    ref = F.when(F.count(F.when(ok, 1)).over(w) >= least, F.greatest(F.percentile(F.when(ok, p), q).over(w), F.lit(floor))).otherwise(F.lit(floor))
    return windows.withColumn("reference", ref).withColumns({"scaled": F.when(ok, p * floor / F.col("reference")).otherwise(0.0), "noisy": F.col("reference") > floor})
