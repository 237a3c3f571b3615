"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigevents.config import DEFAULT as OP
from sigevents.operators import calibration, channels, comparison, events, intervals, labels, matching, metrics, seconds, windows
from sigevents.shipping import ship
from sigevents.sources import driver_tables as T
from sigevents.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query; ``sql`` follows the common tables of driver_tables.SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: (ship(spark), f(spark, d))[1]
        if sql:
            start, sql_ = ("WITH RECURSIVE ", sql.removeprefix("RECURSIVE")) if sql.startswith("RECURSIVE") else ("WITH ", sql)
            SQL[f.__name__] = (start + T.SQL.strip() + sql_) if base else sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles and floats to six places."""
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _scored(spark, d):
    """Windows of annotated recordings with labels; skipped ones out."""
    w = T.windows(spark, d).where("recording_id % 7 <> 0 and skip_code = 0 and prob is not null")
    return labels.label_any_overlap(w, T.references(spark, d), OP.seg)


SECONDS = """,
cov AS (SELECT recording_id, unnest(range(start_s, start_s + 12)) AS s, CAST(prob AS DOUBLE) AS p FROM w WHERE prob IS NOT NULL),
curve AS (SELECT recording_id, s, CAST(avg(p) AS FLOAT) AS p, CAST(max(p) AS FLOAT) AS m FROM cov GROUP BY ALL),
axis AS (SELECT recording_id, unnest(range(0, CAST(duration_s AS INTEGER))) AS s FROM rec),
sec AS (SELECT axis.recording_id, CAST(axis.s AS INTEGER) AS s, coalesce(p, 0) AS p, coalesce(m, 0) AS m FROM axis LEFT JOIN curve USING (recording_id, s))
"""
LABELLED = """,
l AS (SELECT w.recording_id, w.start_s, w.prob, CAST(max(CASE WHEN r.recording_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS label
  FROM w LEFT JOIN r ON r.recording_id = w.recording_id AND w.start_s < r.stop_s AND w.start_s + 12 > r.start_s
  WHERE w.recording_id % 7 <> 0 AND skip_code = 0 AND prob IS NOT NULL GROUP BY ALL)
"""
CUM = LABELLED + """,
t AS (SELECT CAST(prob AS DOUBLE) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM t)
"""
EVENTS = SECONDS + """,
hot AS (SELECT recording_id, t AS threshold, s, CAST(p AS DOUBLE) AS p FROM sec, (SELECT unnest([0.5, 0.3, 0.1, 0.05, 0.01]::DOUBLE[]) AS t) WHERE CAST(p AS DOUBLE) >= t),
isl AS (SELECT *, s - row_number() OVER (PARTITION BY recording_id, threshold ORDER BY s) AS i FROM hot),
run AS (SELECT recording_id, threshold, CAST(min(s) AS DOUBLE) AS a, CAST(max(s) + 1 AS DOUBLE) AS z FROM isl GROUP BY recording_id, threshold, i),
gap AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id, threshold ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS n FROM run),
grp AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, threshold ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM gap),
evt AS (SELECT recording_id, threshold, min(a) AS start_s, max(z) AS stop_s FROM grp GROUP BY recording_id, threshold, g HAVING max(z) - min(a) >= 5),
ev AS (SELECT e.recording_id, e.threshold, greatest(e.start_s, 0) AS start_s, least(e.stop_s, duration_s) AS stop_s FROM evt e JOIN rec USING (recording_id) WHERE least(e.stop_s, duration_s) > greatest(e.start_s, 0))
"""


@query(SECONDS + "SELECT recording_id, s, round(CAST(p AS DOUBLE), 6) AS p FROM sec")
def per_second_mean(spark, d):
    return r6(seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg))


@query(SECONDS + "SELECT recording_id, s, round(CAST(m AS DOUBLE), 6) AS p FROM sec")
def per_second_max(spark, d):
    return r6(seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg, "max"))


@query(SECONDS + ", h AS (SELECT recording_id, s, s - row_number() OVER (PARTITION BY recording_id ORDER BY s) AS i FROM sec WHERE CAST(p AS DOUBLE) >= 0.5) SELECT recording_id, CAST(min(s) AS DOUBLE) AS start_s, CAST(max(s) + 1 AS DOUBLE) AS stop_s FROM h GROUP BY recording_id, i")
def runs_above(spark, d):
    return seconds.runs_above(seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg), OP.threshold)


@query(SECONDS + ", v AS (SELECT recording_id, s, CASE WHEN (CASE WHEN CAST(p AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN CAST(m AS DOUBLE) >= 0.9 THEN 1 ELSE 0 END) + (CASE WHEN CAST(p AS DOUBLE) >= 0.4 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS y FROM sec) SELECT recording_id, s, CAST(y AS INTEGER) AS y FROM v")
def majority_vote(spark, d):
    mean, most = (seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg, h) for h in ("mean", "max"))
    y = lambda c, t: c.select("recording_id", "s", seconds.binarise(F.col("p"), t).alias("y"))
    return seconds.majority_vote(y(mean, 0.5), y(most, 0.9), y(mean, 0.4))


@query(EVENTS + "SELECT e.recording_id, e.threshold, e.start_s, e.stop_s, round(max(h.p), 6) AS prob FROM ev e JOIN hot h ON h.recording_id = e.recording_id AND h.threshold = e.threshold AND h.s < e.stop_s AND h.s + 1 > e.start_s GROUP BY ALL")
def events_from_windows(spark, d):
    return r6(events.events_from_windows(T.windows(spark, d), T.recordings(spark, d), OP.grid))


@query(LABELLED + "SELECT recording_id, start_s, label FROM l")
def label_any_overlap(spark, d):
    return _scored(spark, d).select("recording_id", "start_s", "label")


@query(""", t AS (SELECT w.recording_id, w.start_s, bool_or(r.start_s <= w.start_s AND w.start_s + 12 <= r.stop_s) AS inside FROM w JOIN r ON r.recording_id = w.recording_id AND w.start_s < r.stop_s AND w.start_s + 12 > r.start_s GROUP BY ALL)
SELECT w.recording_id, w.start_s, CAST(CASE WHEN inside THEN 1 ELSE 0 END AS INTEGER) AS label, inside IS NULL OR inside AS keep FROM w LEFT JOIN t USING (recording_id, start_s)""")
def label_fully_inside(spark, d):
    return labels.label_fully_inside(T.windows(spark, d), T.references(spark, d), OP.seg).select("recording_id", "start_s", "label", "keep")


@query(" SELECT recording_id, start_s FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s) - 1 AS n FROM w) WHERE n % 2 = 0")
def non_overlapping(spark, d):
    return labels.non_overlapping(T.windows(spark, d), OP.seg, OP.step).select("recording_id", "start_s")


@query(SECONDS + ", h AS (SELECT DISTINCT recording_id, CAST(unnest(range(CAST(floor(start_s) AS BIGINT), CAST(ceil(stop_s) AS BIGINT))) AS INTEGER) AS s FROM r) SELECT sec.recording_id, sec.s, CAST(CASE WHEN h.s IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label FROM sec LEFT JOIN h USING (recording_id, s) WHERE p > 0")
def label_seconds(spark, d):
    return labels.label_seconds(seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg), T.references(spark, d)).select("recording_id", "s", "label")


@query(" SELECT r.recording_id, round(r.start_s, 6) AS start_s, round(r.stop_s, 6) AS stop_s, round(max(CAST(w.prob AS DOUBLE)), 6) AS peak FROM r JOIN w ON w.recording_id = r.recording_id AND w.start_s < r.stop_s AND w.start_s + 12 > r.start_s GROUP BY r.recording_id, r.start_s, r.stop_s HAVING max(w.prob) IS NOT NULL")
def peak_per_reference(spark, d):
    return r6(labels.peak_per_reference(T.windows(spark, d), T.references(spark, d), OP.seg))


@query(" SELECT recording_id, round(max(CAST(prob AS DOUBLE)), 6) AS bg_max, round(avg(CAST(prob AS DOUBLE)), 6) AS bg_mean FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.recording_id = w.recording_id AND w.start_s < r.stop_s AND w.start_s + 12 > r.start_s) GROUP BY recording_id")
def background_stats(spark, d):
    return r6(labels.background_stats(T.windows(spark, d), T.references(spark, d), OP.seg))


def _events_and_keys(spark, d):
    e = events.events_from_windows(T.windows(spark, d), T.recordings(spark, d), OP.grid).where("recording_id % 7 <> 0")
    keys = events.threshold_table(T.recordings(spark, d).where("has_reference").select("recording_id"), OP.grid)
    return e, keys


@query(EVENTS + "SELECT recording_id, threshold, start_s, stop_s FROM ev WHERE recording_id % 7 <> 0 AND EXISTS (SELECT 1 FROM r WHERE r.recording_id = ev.recording_id AND ev.start_s <= r.stop_s + 5 AND ev.stop_s >= r.start_s - 5)")
def proximity_hits(spark, d):
    return matching.proximity_hits(_events_and_keys(spark, d)[0], T.references(spark, d), OP.tolerance).select("recording_id", "threshold", "start_s", "stop_s")


@query(EVENTS + """, k AS (SELECT recording_id, unnest([0.5, 0.3, 0.1, 0.05, 0.01]::DOUBLE[]) AS threshold FROM rec WHERE has_reference)
SELECT k.recording_id, k.threshold, CAST((SELECT count(*) FROM r WHERE r.recording_id = k.recording_id AND EXISTS (SELECT 1 FROM ev WHERE ev.recording_id = k.recording_id AND ev.threshold = k.threshold AND ev.start_s < r.stop_s AND ev.stop_s > r.start_s)) AS BIGINT) AS hits,
 CAST((SELECT count(*) FROM ev WHERE ev.recording_id = k.recording_id AND ev.threshold = k.threshold AND NOT EXISTS (SELECT 1 FROM r WHERE r.recording_id = k.recording_id AND ev.start_s < r.stop_s AND ev.stop_s > r.start_s)) AS BIGINT) AS false_alarms,
 CAST((SELECT count(*) FROM r WHERE r.recording_id = k.recording_id) AS BIGINT) AS n_refs FROM k""")
def score_overlap(spark, d):
    e, keys = _events_and_keys(spark, d)
    return matching.score_overlap(e, T.references(spark, d), keys)


def event_runs(spark, d) -> DataFrame:
    """Per recording and threshold, the greedy matching's summary."""
    e, keys = _events_and_keys(spark, d)
    rec = T.recordings(spark, d)
    m = matching.match_events(e, T.references(spark, d), OP.tolerance, keys)
    return matching.summarise_run(m, rec.select("recording_id", "duration_s", "cohort"), keys)


@query(CUM + "SELECT round(sum(neg * (cp - pos + pos / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c")
def roc_auc_pooled(spark, d):
    return r6(metrics.roc_auc(_scored(spark, d)))


@query(LABELLED + ", t AS (SELECT recording_id, CAST(prob AS DOUBLE) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY recording_id ORDER BY score DESC) AS cp FROM t) SELECT recording_id, round(sum(neg * (cp - pos + pos / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY recording_id")
def roc_auc_per_recording(spark, d):
    return r6(metrics.roc_auc(_scored(spark, d), ["recording_id"]))


@query(CUM + "SELECT round(sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0), 6) AS ap, CAST(sum(pos) AS BIGINT) AS n_pos FROM c")
def average_precision(spark, d):
    return r6(metrics.average_precision(_scored(spark, d)))


@query(CUM + "SELECT round(score, 6) AS threshold, round(cn / (SELECT sum(neg) FROM t), 6) AS fpr, round(cp / (SELECT sum(pos) FROM t), 6) AS tpr, round(cp / (cp + cn), 6) AS precision FROM c")
def curve_points(spark, d):
    return r6(metrics.curve_points(_scored(spark, d)))


@query(LABELLED + ", a AS (SELECT w.*, coalesce(l.label, 0) AS label FROM w LEFT JOIN l USING (recording_id, start_s) WHERE w.recording_id % 7 <> 0 AND w.prob IS NOT NULL) SELECT recording_id, count(*) AS n_windows, count(*) FILTER (skip_code = 0 AND label = 1) AS n_positive, count(*) FILTER (skip_code <> 0) AS n_excluded FROM a GROUP BY ROLLUP (recording_id)")
def window_stats(spark, d):
    w = T.windows(spark, d).where("recording_id % 7 <> 0 and prob is not null")
    return metrics.window_stats(labels.label_any_overlap(w, T.references(spark, d), OP.seg))


@query(""", f AS (SELECT recording_id, bool_or(CAST(prob AS DOUBLE) >= 0.5) AS flag, count(*) FILTER (CAST(prob AS DOUBLE) >= 0.5) AS n FROM w GROUP BY 1), x AS (SELECT * FROM f JOIN rec USING (recording_id) WHERE has_reference)
SELECT count(*) FILTER (cohort = 'seizure' AND flag) AS flagged_positive, count(*) FILTER (cohort = 'seizure') AS n_positive, count(*) FILTER (cohort <> 'seizure' AND flag) AS flagged_negative, count(*) FILTER (cohort <> 'seizure') AS n_negative, CAST(sum(n) AS BIGINT) AS candidates, round(sum(duration_s), 6) AS duration_s,
round(count(*) FILTER (cohort = 'seizure' AND flag) / nullif(count(*) FILTER (cohort = 'seizure'), 0), 6) AS recall, round(count(*) FILTER (cohort <> 'seizure' AND flag) / nullif(count(*) FILTER (cohort <> 'seizure'), 0), 6) AS false_flag_rate, round(sum(n) * 3600.0 / sum(duration_s), 6) AS candidates_per_hour FROM x""")
def review_simulation(spark, d):
    rec = T.recordings(spark, d).where("has_reference").select("recording_id", "duration_s", "cohort")
    return r6(metrics.review_simulation(T.windows(spark, d), rec, OP.threshold))


@query(" SELECT recording_id, round(max(CAST(prob AS DOUBLE)), 6) AS p_max, round(quantile_cont(CAST(prob AS DOUBLE), 0.9), 6) AS p90, round(avg(CAST(prob AS DOUBLE)), 6) AS p_mean FROM w GROUP BY recording_id")
def probability_stats(spark, d):
    return r6(metrics.probability_stats(T.windows(spark, d)))


@query(" SELECT recording_id, CAST(round(median(x)) AS INTEGER) AS step FROM (SELECT recording_id, start_s - lag(start_s) OVER (PARTITION BY recording_id ORDER BY start_s) AS x FROM w) GROUP BY recording_id")
def infer_step(spark, d):
    return metrics.infer_step(T.windows(spark, d))


WIDTH_BINS = LABELLED + ", bins AS (SELECT CAST(least(floor(CAST(prob AS DOUBLE) * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(CAST(prob AS DOUBLE)) AS mean_p, avg(label) AS observed, CAST(sum(label) AS BIGINT) AS n_pos FROM l GROUP BY 1)"


@query(WIDTH_BINS + " SELECT n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed, n_pos FROM bins")
def reliability_width(spark, d):
    return r6(metrics.reliability(_scored(spark, d), 10, "width").drop("bin"))


@query(WIDTH_BINS + " SELECT round(sum(n * abs(mean_p - observed)) / sum(n), 6) AS ece, round(max(abs(mean_p - observed)), 6) AS mce FROM bins")
def ece_mce(spark, d):
    return r6(metrics.ece_mce(metrics.reliability(_scored(spark, d), 10, "width")))


@query(WIDTH_BINS + """, a AS (SELECT avg((CAST(prob AS DOUBLE) - label) ** 2) AS brier, avg(label) AS base_rate, avg(-CASE WHEN label = 1 THEN ln(least(greatest(CAST(prob AS DOUBLE), 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(CAST(prob AS DOUBLE), 1e-6), 1 - 1e-6)) END) AS log_loss FROM l),
x AS (SELECT sum(n * (mean_p - observed) ** 2) / sum(n) AS rel, sum(n * (observed - base_rate) ** 2) / sum(n) AS res FROM bins, a)
SELECT round(brier, 6) AS brier, round(base_rate, 6) AS base_rate, round(log_loss, 6) AS log_loss, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(base_rate * (1 - base_rate), 6) AS uncertainty, round(brier - (rel - res + base_rate * (1 - base_rate)), 6) AS residual FROM a, x""")
def brier_decomposition(spark, d):
    s = _scored(spark, d)
    return r6(metrics.brier_decomposition(s, metrics.reliability(s, 10, "width")))


@query()
def calibration_report(spark, d):
    """ECE and greatest gap of raw and out-of-fold calibrated scores over 15 quantile bins, scores that are exactly 0 or 1, mean score; five patient folds."""
    s = calibration.all_calibrated(_scored(spark, d).withColumn("patient", F.col("recording_id") % 20), "patient", 5)
    s = stored(s.select("prob", "label", *calibration.METHODS), "calibrated")

    def report(score: str, method: str) -> DataFrame:
        p = F.col(score).cast("double")
        ends = s.agg(F.count_if(p == 0).alias("n_zero"), F.count_if(p == 1).alias("n_one"), F.avg(p).alias("mean_p"))
        return metrics.ece_mce(metrics.reliability(s, score=score)).join(F.broadcast(ends)).withColumn("method", F.lit(method))  # one row

    return r6(reduce(lambda a, b: a.unionByName(b), [report("prob", "raw"), *(report(m, m) for m in calibration.METHODS)]))


@query()
def cluster_bootstrap(spark, d):
    return r6(calibration.cluster_bootstrap(_scored(spark, d), "recording_id", 2000, 0, target=0.5))


@query()
def paired_delta_bootstrap(spark, d):
    pairs = labels.label_any_overlap(comparison.pair_arms(T.windows(spark, d).where("recording_id % 7 <> 0"), T.second_arm(spark, d)), T.references(spark, d), OP.seg)
    return r6(calibration.paired_delta_bootstrap(pairs, "recording_id"))


@query(""", q AS (SELECT recording_id, count(*) FILTER (skip_code = 0) AS n, quantile_cont(CAST(prob AS DOUBLE), 0.85) FILTER (skip_code = 0) AS q FROM w GROUP BY 1), f AS (SELECT recording_id, CASE WHEN n >= 20 THEN greatest(q, 0.5) ELSE 0.5 END AS ref FROM q)
SELECT recording_id, start_s, round(ref, 6) AS reference, round(CASE WHEN skip_code = 0 THEN CAST(prob AS DOUBLE) * 0.5 / ref ELSE 0 END, 6) AS scaled, ref > 0.5 AS noisy FROM w JOIN f USING (recording_id)""")
def adaptive_reference(spark, d):
    return r6(metrics.adaptive_reference(T.windows(spark, d)).select("recording_id", "start_s", "reference", "scaled", "noisy"))


@query(" SELECT a.recording_id, a.start_s, round(CAST(a.prob AS DOUBLE), 6) AS prob_a, round(CAST(b.prob AS DOUBLE), 6) AS prob_b FROM w a JOIN w2 b USING (recording_id, start_s) WHERE a.skip_code = 0 AND b.skip_code = 0")
def pair_arms(spark, d):
    return r6(comparison.pair_arms(T.windows(spark, d), T.second_arm(spark, d)))


@query(""", p AS (SELECT CAST(a.prob AS DOUBLE) AS x, CAST(b.prob AS DOUBLE) AS y, abs(CAST(a.prob AS DOUBLE) - CAST(b.prob AS DOUBLE)) AS d FROM w a JOIN w2 b USING (recording_id, start_s) WHERE a.skip_code = 0 AND b.skip_code = 0)
SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS largest, count(*) FILTER ((x >= 0.5) <> (y >= 0.5)) AS flips, count(*) FILTER (d = 0) AS identical FROM p""")
def drift_report(spark, d):
    return r6(comparison.drift_report(T.windows(spark, d), T.second_arm(spark, d), OP.threshold))


@query(""", a AS (SELECT recording_id, start_s FROM w WHERE skip_code = 0), c AS (SELECT recording_id, start_s FROM w2 WHERE skip_code = 0)
SELECT 'both' AS part, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c)) AS n UNION ALL SELECT 'only_a', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)) UNION ALL SELECT 'only_b', (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)) UNION ALL SELECT 'either', (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM c))""")
def arm_set_ops(spark, d):
    return comparison.arm_set_ops(*(x.where("skip_code = 0") for x in (T.windows(spark, d), T.second_arm(spark, d))))


SPLIT = LABELLED + """, kk AS (SELECT DISTINCT label, recording_id % 20 AS patient_id FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(patient_id AS VARCHAR) || '|0'), patient_id) AS n, count(*) OVER (PARTITION BY label) AS c FROM kk), part AS (SELECT label, patient_id, CASE WHEN n > c - floor(c * 0.25) THEN 'val' ELSE 'train' END AS part FROM o)
"""


def _split(spark, d):
    return comparison.grouped_split(_scored(spark, d).withColumn("patient_id", F.col("recording_id") % 20), "patient_id")


@query(SPLIT + "SELECT l.recording_id, l.start_s, l.label, part FROM l JOIN part ON part.label = l.label AND part.patient_id = l.recording_id % 20")
def grouped_split(spark, d):
    return _split(spark, d).select("recording_id", "start_s", "label", "part")


@query(SPLIT + ", t AS (SELECT l.label, count(*) AS n FROM l JOIN part ON part.label = l.label AND part.patient_id = l.recording_id % 20 WHERE part = 'train' GROUP BY 1) SELECT label, round((SELECT sum(n) FROM t) / (n + 1e-6), 6) AS weight FROM t")
def class_weights(spark, d):
    return r6(comparison.class_weights(_split(spark, d).where("part = 'train'")))


@query(LABELLED + ", k AS (SELECT greatest(CAST(floor(count(*) FILTER (label = 0) / count(*) FILTER (label = 1)) AS BIGINT), 1) AS k FROM l) SELECT recording_id, start_s, CAST(unnest(range(1, CASE WHEN label = 1 THEN k + 1 ELSE 2 END)) AS INTEGER) AS copy FROM l, k")
def oversample_minority(spark, d):
    return comparison.oversample_minority(_scored(spark, d)).select("recording_id", "start_s", "copy")


@query(SPLIT + """, s AS (SELECT l.recording_id % 20 AS p, part FROM l JOIN part ON part.label = l.label AND part.patient_id = l.recording_id % 20), x AS (SELECT DISTINCT p FROM s WHERE part = 'train' INTERSECT SELECT DISTINCT p FROM s WHERE part = 'val')
SELECT (SELECT count(*) FROM x) AS patients, count(*) FILTER (p IN (SELECT p FROM x)) AS shared_rows, count(*) AS rows, round(count(*) FILTER (p IN (SELECT p FROM x)) / count(*), 6) AS share FROM s WHERE part = 'val'""")
def split_leakage(spark, d):
    s = _split(spark, d)
    return r6(comparison.split_leakage(s.where("part = 'train'"), s.where("part = 'val'")))


@query(" SELECT recording_id, min(start_s) = 0 AS from_zero, count(*) FILTER (x > 0) AS gaps, count(*) FILTER (x < 0) AS overlaps FROM (SELECT *, start_s - lag(stop_s) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS x FROM r) GROUP BY recording_id")
def interval_coverage(spark, d):
    return comparison.interval_coverage_check(T.references(spark, d))


@query(""" SELECT rec.recording_id, CASE WHEN NOT has_reference THEN 'unannotated' WHEN count(r.recording_id) > 0 THEN 'seizure' ELSE 'nonseizure' END AS cohort, count(r.recording_id) AS seiz_count, round(coalesce(sum(r.stop_s - r.start_s), 0), 6) AS seiz_total_s, duration_s FROM rec LEFT JOIN r USING (recording_id) GROUP BY rec.recording_id, has_reference, duration_s""")
def manifest(spark, d):
    rec = T.recordings(spark, d).select("recording_id", "has_reference", F.lit(None).cast("double").alias("duration_s"))
    return r6(comparison.build_manifest(rec, T.references(spark, d), T.windows(spark, d), OP.seg).select("recording_id", "cohort", "seiz_count", "seiz_total_s", "duration_s"))


@query(" SELECT recording_id, start_s, round(CAST(prob AS DOUBLE), 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY prob DESC NULLS LAST, start_s) AS n FROM w) WHERE n <= 8")
def top_windows(spark, d):
    return r6(matching.top_rows(T.windows(spark, d), 8, [F.desc("prob"), "start_s"]).select("recording_id", "start_s", "prob"))


@query(""", g AS (SELECT *, CASE WHEN start_s - max(stop_s) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS n FROM r), h AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT recording_id, round(min(start_s), 6) AS start_s, round(max(stop_s), 6) AS stop_s FROM h GROUP BY recording_id, g""")
def concatenate_nearby(spark, d):
    return r6(intervals.concatenate_nearby(T.references(spark, d), OP.merge_gap))


@query(""", k AS (SELECT recording_id, CAST(start_s AS DOUBLE) AS a, CAST(start_s + 12 AS DOUBLE) AS z FROM w WHERE skip_code <> 0), g AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS n FROM k), h AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT recording_id, min(a) AS start_s, max(z) AS stop_s FROM h GROUP BY recording_id, g""")
def unscored_spans(spark, d):
    return intervals.unscored_spans(T.windows(spark, d), OP.seg)


@query(EVENTS + "SELECT a.recording_id, round(greatest(a.start_s, r.start_s), 6) AS start_s, round(least(a.stop_s, r.stop_s), 6) AS stop_s, CAST(1.0 AS DOUBLE) AS confidence FROM ev a JOIN r ON r.recording_id = a.recording_id AND a.start_s < r.stop_s AND r.start_s < a.stop_s WHERE a.threshold = 0.5")
def intersect_hypotheses(spark, d):
    one = F.lit(1.0)
    e = events.events_from_windows(T.windows(spark, d), T.recordings(spark, d), [OP.threshold]).withColumn("confidence", one)
    return r6(intervals.intersect_hypotheses(e, T.references(spark, d).withColumn("confidence", one)))


@query(""", x AS (SELECT *, lag(start_s) OVER o AS p0, lag(stop_s) OVER o AS p1 FROM r WINDOW o AS (PARTITION BY recording_id ORDER BY start_s, stop_s))
SELECT recording_id, round(CASE WHEN p0 IS NULL OR start_s - p1 > 10 THEN start_s ELSE p0 END, 6) AS start_s, round(stop_s, 6) AS stop_s FROM x WHERE stop_s - start_s > 5 AND (p0 IS NULL OR start_s - p1 > 10 OR p1 - p0 > 5)""")
def pairwise_discard(spark, d):
    return r6(intervals.pairwise_discard(T.references(spark, d)))


@query(""" SELECT recording_id, round(start_s + i * CASE WHEN label = 'seiz' THEN 1 ELSE 3 END, 6) AS start_s, label FROM (SELECT *, unnest(range(0, CAST(ceil((stop_s - start_s - 5) / CASE WHEN label = 'seiz' THEN 1 ELSE 3 END) AS BIGINT))) AS i FROM (SELECT *, CASE WHEN floor(start_s) % 2 = 0 THEN 'seiz' ELSE 'bckg' END AS label FROM r) WHERE stop_s - start_s > 5)""")
def tile_intervals(spark, d):
    iv = T.references(spark, d).withColumn("label", F.when(F.floor("start_s") % 2 == 0, "seiz").otherwise("bckg"))
    return r6(windows.tile_labelled_intervals(iv, 5, 1, 3))


@query(" SELECT recording_id, CAST(unnest(range(0, CAST(duration_s AS BIGINT) - 11, 6)) AS INTEGER) AS start_s FROM rec")
def window_grid(spark, d):
    return windows.window_grid(T.recordings(spark, d), OP.seg, OP.step)


def _blocks(spark, d):
    """Embeddings as blocks of samples: four channels a recording."""
    e = T.read(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.expr("vec_id div 4").alias("recording_id"), F.element_at(F.array(*map(F.lit, ("F3", "F7", "P3", "O1"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("channel"), F.lit(0).alias("block_idx"), F.col("embedding").cast("array<double>").alias("samples"))


@query("""WITH e AS (SELECT vec_id // 4 AS recording_id, vec_id % 4 AS c, embedding AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.recording_id, 'F3-F7' AS derivation, round(list_sum([(CAST(a.x[i] AS DOUBLE) - CAST(b.x[i] AS DOUBLE)) * i for i in range(1, 65)]), 6) AS checksum FROM e a JOIN e b USING (recording_id) WHERE a.c = 0 AND b.c = 1""", base=False)
def bipolar_montage(spark, d):
    m = channels.apply_montage(_blocks(spark, d), [("F3", "F7")])
    return r6(m.select("recording_id", "derivation", F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("checksum")))


@query("SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]) / len(embedding)), 6) AS rms, round(list_max([abs(CAST(x AS DOUBLE)) for x in embedding]), 6) AS peak, round((SELECT quantile_cont(abs(CAST(v AS DOUBLE)), 0.98) FROM (SELECT unnest(embedding) AS v)), 6) AS p98 FROM embeddings WHERE embedding IS NOT NULL", base=False)
def channel_stats(spark, d):
    return r6(T.read(spark, d, "embeddings").where("embedding is not null").select("vec_id", *[c.alias(k) for k, c in channels.channel_stats(F.col("embedding")).items()]))


@query(" SELECT e.recording_id, count(*) FILTER (k % 5 = 0) AS proposed, count(*) FILTER (k % 5 = 1) AS accepted, count(*) FILTER (k % 5 = 2) AS edited, count(*) FILTER (k % 5 = 3) AS rejected, count(*) FILTER (k % 5 = 4) AS added FROM b e GROUP BY 1")
def review_counts(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("proposed", "accepted", "edited", "rejected", "added"))), (F.col("k") % 5 + 1).cast("int"))
    return comparison.review_counts(T.base(spark, d).withColumn("status", status))
