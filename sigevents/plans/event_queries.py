"""Queries over events of both arms: greedy matching, ablation, conventions, intervals, comparison, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigevents.config import DEFAULT as OP
from sigevents.config import OperatingPoint
from sigevents.operators import binned_draws, calibration, comparison, events, intervals, labels, matching, metrics, seconds, windows
from sigevents.plans.queries import EVENTS, LABELLED, SECONDS, _events_and_keys, _scored, event_runs, query, r6
from sigevents.sources import driver_tables as T
from sigevents.sources.scratch import stored

GRID = "[0.5, 0.3, 0.1, 0.05, 0.01]::DOUBLE[]"
KEYS = f""", k AS (SELECT recording_id, unnest({GRID}) AS threshold FROM rec WHERE has_reference)"""


def greedy_sql(preds: str, keys: str, cols: str, out: str = "m") -> str:
    """Tables of the greedy matching of ``preds`` (``cols``, start_s, stop_s) with the references of ``keys`` (``cols``): ``out`` has kind and both extents.

    Each prediction has its references in order of preference; one recursion over a key's predictions
    takes the first that is free.
    """
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols.split(", "))
    of = lambda a: ", ".join(f"{a}.{c}" for c in cols.split(", "))
    return f""",
{out}r AS (SELECT {of("q")}, r.start_s AS r0, r.stop_s AS r1, row_number() OVER (PARTITION BY {of("q")} ORDER BY r.start_s, r.stop_s) AS i FROM {keys} q JOIN r USING (recording_id)),
{out}p AS (SELECT {of("p")}, p.start_s AS a, p.stop_s AS z, row_number() OVER (PARTITION BY {of("p")} ORDER BY p.start_s, p.stop_s) AS n FROM {preds} p),
{out}c AS (SELECT {of("p")}, p.n, any_value(p.a) AS a, any_value(p.z) AS z, coalesce(list(x.i ORDER BY greatest(least(p.z, x.r1) - greatest(p.a, x.r0), 0) DESC, abs(p.a - x.r0), abs(p.z - x.r1), x.i) FILTER (x.i IS NOT NULL), []) AS cand
  FROM {out}p p LEFT JOIN {out}r x ON {on("p", "x")} AND p.a <= x.r1 + 5 AND p.z >= x.r0 - 5 GROUP BY {of("p")}, p.n),
{out}g AS (SELECT {cols}, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM {out}c GROUP BY ALL
  UNION ALL SELECT {of("c")}, c.n, CASE WHEN f.pick IS NULL THEN f.used ELSE list_append(f.used, f.pick) END, f.pick FROM (SELECT {of("g")}, c.n, g.used, list_filter(c.cand, lambda x: NOT list_contains(g.used, x))[1] AS pick FROM {out}g g JOIN {out}c c ON {on("g", "c")} AND c.n = g.n + 1) f JOIN {out}c c ON {on("f", "c")} AND c.n = f.n),
{out} AS (SELECT {of("c")}, CASE WHEN g.pick IS NOT NULL THEN 'match' WHEN len(c.cand) > 0 THEN 'duplicate' ELSE 'false_positive' END AS kind, c.a AS pred_start, c.z AS pred_stop, x.r0 AS ref_start, x.r1 AS ref_stop
  FROM {out}c c JOIN {out}g g ON {on("c", "g")} AND c.n = g.n LEFT JOIN {out}r x ON {on("x", "c")} AND x.i = g.pick
  UNION ALL SELECT {of("x")}, 'miss', NULL, NULL, x.r0, x.r1 FROM {out}r x WHERE NOT EXISTS (SELECT 1 FROM {out}g g WHERE {on("g", "x")} AND g.pick = x.i))"""


PREDS = EVENTS + ", pr AS (SELECT * FROM ev WHERE recording_id % 7 <> 0)" + KEYS
MATCH = PREDS + greedy_sql("pr", "k", "recording_id, threshold")
SUMS = "CAST(count(*) FILTER (kind = 'match') AS BIGINT) AS hits, CAST(count(*) FILTER (kind = 'miss') AS BIGINT) AS misses, CAST(count(*) FILTER (kind = 'false_positive') AS BIGINT) AS false_positives, CAST(count(*) FILTER (kind = 'duplicate') AS BIGINT) AS duplicates"


@query("RECURSIVE" + MATCH + " SELECT recording_id, threshold, kind, round(pred_start, 6) AS pred_start, round(pred_stop, 6) AS pred_stop, round(ref_start, 6) AS ref_start, round(ref_stop, 6) AS ref_stop FROM m")
def match_events(spark, d):
    e, keys = _events_and_keys(spark, d)
    return r6(matching.match_events(e, T.references(spark, d), OP.tolerance, keys))


RUNS = MATCH + f""", ru AS (SELECT k.recording_id, k.threshold, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, coalesce(false_positives, 0) AS false_positives, coalesce(duplicates, 0) AS duplicates, onset_error, offset_error, duration_s, cohort
 FROM k JOIN rec USING (recording_id) LEFT JOIN (SELECT recording_id, threshold, {SUMS}, avg(abs(pred_start - ref_start)) AS onset_error, avg(abs(pred_stop - ref_stop)) AS offset_error FROM m GROUP BY 1, 2) USING (recording_id, threshold))"""


@query("RECURSIVE" + RUNS + " SELECT recording_id, threshold, hits, misses, false_positives, duplicates, hits + misses AS n_refs, hits + false_positives + duplicates AS n_preds, round(onset_error, 6) AS onset_error, round(offset_error, 6) AS offset_error, round(hits / nullif(hits + misses, 0), 6) AS sensitivity, round(false_positives * 86400.0 / nullif(duration_s, 0), 6) AS fp_per_24h, duration_s, cohort FROM ru")
def summarise_run(spark, d):
    return r6(event_runs(spark, d))


SWEEP_SUMS = "CAST(sum(hits + misses) AS BIGINT) AS n_refs, CAST(sum(hits + false_positives + duplicates) AS BIGINT) AS n_preds, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(duplicates) AS BIGINT) AS duplicates, sum(duration_s) AS duration_s"
RATES = "round(hits / nullif(n_refs, 0), 6) AS sensitivity, round(false_positives * 86400.0 / nullif(duration_s, 0), 6) AS fp_per_24h"


@query("RECURSIVE" + RUNS + f" SELECT *, {RATES} FROM (SELECT threshold, cohort, {SWEEP_SUMS}, grouping(cohort) = 1 AS pooled FROM ru GROUP BY GROUPING SETS ((threshold), (threshold, cohort)))")
def event_sweep(spark, d):
    return r6(matching.event_sweep(event_runs(spark, d)))


def _hot_events(name: str, average: bool, shape: bool) -> str:
    """Events of one configuration: runs of hot seconds or windows, joined and dropped or as they are."""
    raw = "SELECT recording_id, threshold, a, z FROM run" if average else f"SELECT recording_id, threshold, min(a) AS a, max(z) AS z FROM (SELECT *, sum(n) OVER (PARTITION BY recording_id, threshold ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY recording_id, threshold ORDER BY a) < 1e-9 THEN 0 ELSE 1 END AS n FROM (SELECT recording_id, t AS threshold, CAST(start_s AS DOUBLE) AS a, CAST(start_s + 12 AS DOUBLE) AS z FROM w, (SELECT unnest({GRID}) AS t) WHERE CAST(prob AS DOUBLE) >= t))) GROUP BY recording_id, threshold, g"
    if shape:
        raw = f"SELECT recording_id, threshold, min(a) AS a, max(z) AS z FROM (SELECT *, sum(n) OVER (PARTITION BY recording_id, threshold ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id, threshold ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS n FROM ({raw}))) GROUP BY recording_id, threshold, g HAVING max(z) - min(a) >= 5"
    return f"SELECT recording_id, '{name}' AS config, threshold, greatest(a, 0) AS start_s, least(z, duration_s) AS stop_s FROM ({raw}) JOIN rec USING (recording_id) WHERE has_reference AND least(z, duration_s) > greatest(a, 0)"


ABLATION = EVENTS + ", pr AS (" + " UNION ALL ".join(_hot_events(n, *how) for n, how in matching.ABLATION.items()) + f"), k AS (SELECT recording_id, c AS config, t AS threshold FROM rec, (SELECT unnest({list(matching.ABLATION)!r}) AS c), (SELECT unnest({GRID}) AS t) WHERE has_reference)" + greedy_sql("pr", "k", "recording_id, config, threshold")


@query("RECURSIVE" + ABLATION + f" SELECT *, hits + misses AS n_refs, round(hits / nullif(hits + misses, 0), 6) AS sensitivity, round(false_positives * 86400.0 / nullif(duration_s, 0), 6) AS fp_per_24h FROM (SELECT config, threshold, {SUMS}, (SELECT sum(duration_s) FROM rec WHERE has_reference) AS duration_s FROM m GROUP BY 1, 2)")
def postprocessing_ablation(spark, d):
    rec = T.recordings(spark, d)
    return r6(matching.postprocessing_ablation(T.windows(spark, d), rec.select("recording_id", "duration_s", "cohort"), T.references(spark, d), rec.where("has_reference").select("recording_id"), OP.grid))


OVERLAP = """, met AS (SELECT p.*, r.start_s AS b0, r.stop_s AS b1 FROM pr p LEFT JOIN r ON r.recording_id = p.recording_id AND p.start_s < r.stop_s AND p.stop_s > r.start_s),
oh AS (SELECT threshold, count(*) AS hits FROM (SELECT DISTINCT recording_id, threshold, b0, b1 FROM met WHERE b0 IS NOT NULL) u JOIN r ON r.recording_id = u.recording_id AND r.start_s = b0 AND r.stop_s = b1 GROUP BY 1),
fa AS (SELECT recording_id, threshold, start_s, stop_s FROM met WHERE b0 IS NULL), fg AS (SELECT *, CASE WHEN start_s - max(stop_s) OVER (PARTITION BY recording_id, threshold ORDER BY start_s, stop_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30 THEN 0 ELSE 1 END AS n FROM fa),
o1 AS (SELECT threshold, count(*) AS false_alarms FROM fa GROUP BY 1), o2 AS (SELECT threshold, sum(n) AS false_alarms FROM fg GROUP BY 1)"""


@query("RECURSIVE" + MATCH + OVERLAP + """, al AS (SELECT threshold, 'greedy' AS convention, count(*) FILTER (kind = 'match') AS hits, count(*) FILTER (kind = 'false_positive') AS false_alarms FROM m GROUP BY 1
 UNION ALL SELECT threshold, 'overlap', hits, false_alarms FROM oh JOIN o1 USING (threshold) UNION ALL SELECT threshold, 'overlap_merged', hits, false_alarms FROM oh JOIN o2 USING (threshold))
SELECT threshold, convention, CAST(hits AS BIGINT) AS hits, CAST(false_alarms AS BIGINT) AS false_alarms, n_refs, du AS duration_s, round(hits / n_refs, 6) AS sensitivity, round(false_alarms * 86400.0 / du, 6) AS fa_per_24h FROM al, (SELECT count(*) AS n_refs FROM r), (SELECT sum(duration_s) AS du FROM rec WHERE has_reference)""")
def convention_comparison(spark, d):
    e, keys = _events_and_keys(spark, d)
    return r6(matching.convention_comparison(e, T.references(spark, d), T.recordings(spark, d), keys, OP.tolerance))


def _arm_runs(spark, d) -> DataFrame:
    """Summaries of both arms at the operating threshold."""
    rec, out = T.recordings(spark, d), None
    keys = events.threshold_table(rec.where("has_reference").select("recording_id"), [OP.threshold])
    for arm, w in (("a", T.windows(spark, d)), ("b", T.second_arm(spark, d))):
        e = events.events_from_windows(w, rec, [OP.threshold]).join(keys, ["recording_id", "threshold"], "left_semi")
        run = matching.summarise_run(matching.match_events(e, T.references(spark, d), OP.tolerance, keys), rec.select("recording_id", "duration_s"), keys).withColumn("arm", F.lit(arm))
        out = run if out is None else out.unionByName(run)
    return out


def _arm_events(name: str, table: str) -> str:
    """Events of an arm at 0.5, from per-second means: table ``name``."""
    return f""",
{name}1 AS (SELECT recording_id, unnest(range(start_s, start_s + 12)) AS s, CAST(prob AS DOUBLE) AS p FROM {table} WHERE prob IS NOT NULL),
{name}2 AS (SELECT c.recording_id, s, CAST(avg(p) AS FLOAT) AS p FROM {name}1 c JOIN rec ON rec.recording_id = c.recording_id AND s < duration_s GROUP BY ALL),
{name}3 AS (SELECT *, s - row_number() OVER (PARTITION BY recording_id ORDER BY s) AS i FROM {name}2 WHERE CAST(p AS DOUBLE) >= 0.5),
{name}4 AS (SELECT recording_id, CAST(min(s) AS DOUBLE) AS a, CAST(max(s) + 1 AS DOUBLE) AS z FROM {name}3 GROUP BY recording_id, i),
{name}5 AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS n FROM {name}4),
{name}6 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM {name}5),
{name} AS (SELECT g.recording_id, min(a) AS start_s, least(max(z), any_value(duration_s)) AS stop_s FROM {name}6 g JOIN rec USING (recording_id) GROUP BY g.recording_id, g HAVING max(z) - min(a) >= 5)"""


ARMS = _arm_events("ea", "w") + _arm_events("eb", "w2") + ", pr AS (SELECT *, 'a' AS arm FROM ea WHERE recording_id % 7 <> 0 UNION ALL SELECT *, 'b' FROM eb WHERE recording_id % 7 <> 0), k AS (SELECT recording_id, unnest(['a', 'b']) AS arm FROM rec WHERE has_reference)" + greedy_sql("pr", "k", "recording_id, arm") + f", ar AS (SELECT arm, {SUMS}, (SELECT sum(duration_s) FROM rec WHERE has_reference) AS duration_s FROM m GROUP BY 1)"


@query("RECURSIVE" + ARMS + " SELECT arm, hits + misses AS n_refs, hits + false_positives + duplicates AS n_preds, hits, misses, false_positives, duplicates, duration_s, round(hits / (hits + misses), 6) AS sensitivity, round(false_positives * 86400.0 / duration_s, 6) AS fp_per_24h FROM ar")
def aggregate_arms(spark, d):
    return r6(metrics.aggregate_arms(_arm_runs(spark, d)))


@query("RECURSIVE" + ARMS + " SELECT b.arm, round(b.hits / (b.hits + b.misses) - a.hits / (a.hits + a.misses), 6) AS delta_sensitivity, round((b.false_positives - a.false_positives) * 86400.0 / a.duration_s, 6) AS delta_fp_per_24h FROM ar a, ar b WHERE a.arm = 'a' AND b.arm = 'b'")
def arm_deltas(spark, d):
    return r6(metrics.arm_deltas(metrics.aggregate_arms(_arm_runs(spark, d)), "a"))


COMPARED = _arm_events("ea", "w") + _arm_events("eb", "w2") + """,
y AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS i FROM eb), x AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS n FROM ea),
c AS (SELECT x.recording_id, x.n, any_value(x.start_s) AS a, any_value(x.stop_s) AS z, coalesce(list(y.i ORDER BY least(x.stop_s, y.stop_s) - greatest(x.start_s, y.start_s) DESC, y.i) FILTER (y.i IS NOT NULL), []) AS cand FROM x LEFT JOIN y ON y.recording_id = x.recording_id AND x.start_s < y.stop_s AND y.start_s < x.stop_s GROUP BY 1, 2),
g AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM c
  UNION ALL SELECT recording_id, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT g.recording_id, c.n, g.used, list_filter(c.cand, lambda x: NOT list_contains(g.used, x))[1] AS pick FROM g JOIN c ON c.recording_id = g.recording_id AND c.n = g.n + 1)),
j AS (SELECT c.recording_id, count(g.pick) AS matched, count(*) AS nx, coalesce(max(greatest(abs(c.a - y.start_s), abs(c.z - y.stop_s))), 0) AS shift FROM c JOIN g USING (recording_id, n) LEFT JOIN y ON y.recording_id = c.recording_id AND y.i = g.pick GROUP BY 1),
ny AS (SELECT recording_id, count(*) AS ny FROM y GROUP BY 1),
co AS (SELECT recording_id, coalesce(matched, 0) AS matched, coalesce(nx, 0) - coalesce(matched, 0) AS lost, coalesce(ny, 0) - coalesce(matched, 0) AS gained, coalesce(shift, 0) AS max_shift FROM j FULL JOIN ny USING (recording_id))"""


def _compared(spark, d) -> DataFrame:
    rec = T.recordings(spark, d)
    a, b = (events.events_from_windows(w, rec, [OP.threshold]) for w in (T.windows(spark, d), T.second_arm(spark, d)))
    return matching.compare_event_lists(a, b)


@query("RECURSIVE" + COMPARED + " SELECT recording_id, matched, lost, gained, round(max_shift, 6) AS max_shift FROM co")
def event_list_drift(spark, d):
    return r6(_compared(spark, d))


@query("RECURSIVE" + COMPARED + " SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(gained) AS BIGINT) AS gained, round(max(max_shift), 6) AS max_shift FROM co")
def event_drift_totals(spark, d):
    return r6(comparison.event_totals(_compared(spark, d)))


@query(PREDS + OVERLAP + """, cu AS (SELECT threshold, hits / (SELECT count(*) FROM r) AS sens, o1.false_alarms AS fa1, o2.false_alarms AS fa2 FROM oh JOIN o1 USING (threshold) JOIN o2 USING (threshold)), ta AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS target),
be AS (SELECT target, min(fa1) AS a, min(fa2) AS b FROM ta JOIN cu ON sens >= target - 1e-9 GROUP BY 1), du AS (SELECT sum(duration_s) AS du FROM rec WHERE has_reference)
SELECT target, round(a * 86400.0 / du, 6) AS fa_a, round(b * 86400.0 / du, 6) AS fa_b, round((b - a) * 100.0 / a, 6) AS change_pct, b < a AS b_wins FROM be, du""")
def matched_sensitivity(spark, d):
    """False alarms of the overlap conventions without and with merging, at equal sensitivity."""
    e, keys = _events_and_keys(spark, d)
    c = matching.convention_comparison(e, T.references(spark, d), T.recordings(spark, d), keys, OP.tolerance).withColumnRenamed("fa_per_24h", "fp_per_24h")
    c = stored(c, "conventions")  # a few rows, read twice
    return r6(metrics.matched_sensitivity(c.where("convention = 'overlap'"), c.where("convention = 'overlap_merged'"), [0.05, 0.1, 0.2, 0.3]))


@query(""", cov AS (SELECT recording_id, unnest(range(start_s // 6, start_s // 6 + 3)) AS s, CAST(prob AS DOUBLE) AS p FROM w), n AS (SELECT recording_id, max(start_s // 6) + 3 AS n FROM w GROUP BY 1)
SELECT n.recording_id, CAST(x.s AS INTEGER) AS s, coalesce(round(CAST(CAST(avg(p) AS FLOAT) AS DOUBLE), 6), 0) AS p FROM (SELECT recording_id, unnest(range(0, n)) AS s FROM n) x JOIN n USING (recording_id) LEFT JOIN cov ON cov.recording_id = x.recording_id AND cov.s = x.s GROUP BY n.recording_id, x.s""")
def trailing_mean(spark, d):
    w = T.windows(spark, d).withColumn("start_s", F.expr("start_s div 6").cast("int"))
    total = w.groupBy("recording_id").agg((F.max("start_s") + 3).cast("double").alias("duration_s"))
    return r6(seconds.trailing_mean(w, 3, total))


@query(SECONDS + ", h AS (SELECT recording_id, s, s - row_number() OVER (PARTITION BY recording_id ORDER BY s) AS i FROM sec WHERE CAST(p AS DOUBLE) >= 0.3) SELECT recording_id, CAST(min(s) AS DOUBLE) AS start_s, CAST(max(s) + 1 AS DOUBLE) AS stop_s, CAST(0.3 AS DOUBLE) AS confidence FROM h GROUP BY recording_id, i")
def label_runs(spark, d):
    curve = seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg)
    return seconds.label_runs(curve.withColumn("y", seconds.binarise(F.col("p"), 0.3)), 0.3)


@query(""", h AS (SELECT recording_id, start_s, prob, n - row_number() OVER (PARTITION BY recording_id ORDER BY start_s) AS i FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s) AS n FROM w) WHERE CAST(prob AS DOUBLE) >= 0.5)
SELECT h.recording_id, CAST(min(start_s) AS DOUBLE) AS start_s, least(CAST(max(start_s) + 12 AS DOUBLE), any_value(duration_s)) AS stop_s, round(max(CAST(prob AS DOUBLE)), 6) AS prob FROM h JOIN rec USING (recording_id) GROUP BY h.recording_id, i""")
def consecutive_window_events(spark, d):
    return r6(events.consecutive_window_events(T.windows(spark, d), OP.threshold, OP.seg, T.recordings(spark, d)))


@query(""", x AS (SELECT r.recording_id, r.start_s - 20 AS a, CASE WHEN floor(r.start_s) % 3 = 0 THEN r.start_s - 30 ELSE r.stop_s END AS z, duration_s AS du FROM r JOIN rec USING (recording_id)),
y AS (SELECT recording_id, du, least(greatest(least(a, z), 0), du) AS a, least(greatest(greatest(a, z), 0), du) AS z FROM x), q AS (SELECT *, least(greatest(z, a + 15), du) AS wide FROM y)
SELECT recording_id, round(greatest(least(a, wide - 15), 0), 6) AS start_s, round(wide, 6) AS stop_s FROM q""")
def clamp_interval(spark, d):
    x = T.references(spark, d).join(T.recordings(spark, d).select("recording_id", "duration_s"), "recording_id")
    z = F.when(F.floor("start_s") % 3 == 0, F.col("start_s") - 30).otherwise(F.col("stop_s"))
    a, b = intervals.clamp_interval(F.col("start_s") - 20, z, F.col("duration_s"), 15.0)
    return r6(x.select("recording_id", a.alias("start_s"), b.alias("stop_s")))


STRICT = OperatingPoint(min_duration=13.0, merge_gap=1.0)  # so that runs of one window's width are dropped


@query(EVENTS.replace("< 10 THEN 0", "< 1 THEN 0").replace(">= 5)", ">= 13)") + " SELECT run.recording_id, run.a AS start_s, run.z AS stop_s FROM run WHERE threshold = 0.5 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.recording_id = run.recording_id AND ev.threshold = 0.5 AND ev.start_s <= run.a AND run.z <= ev.stop_s)")
def discarded_runs(spark, d):
    """Runs that rules of 13 s at least and joins below 1 s leave out."""
    w, rec = T.windows(spark, d), T.recordings(spark, d)
    runs = seconds.runs_above(seconds.per_second(w, rec, OP.seg), OP.threshold)
    return intervals.discarded_runs(runs, events.events_from_windows(w, rec, [OP.threshold], STRICT))


REVIEWED = """, y AS (SELECT *, CASE WHEN status = 'added' THEN start_s ELSE start_s - 4 END AS s0, CASE WHEN status = 'added' THEN stop_s ELSE stop_s + 3 END AS s1 FROM (SELECT recording_id, start_s, stop_s, i, CASE WHEN i % 4 > 0 THEN i * 3 END AS event_id, ['added', 'accepted', 'edited'][i % 3 + 1] AS status, CASE WHEN i % 3 > 0 THEN CAST(0.25 AS DOUBLE) END AS prob
  FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS i FROM r))),
x AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS n FROM (SELECT e.recording_id, e.start_s, e.stop_s, max(h.p) AS prob FROM ev e JOIN hot h ON h.recording_id = e.recording_id AND h.threshold = e.threshold AND h.s < e.stop_s AND h.s + 1 > e.start_s WHERE e.threshold = 0.5 GROUP BY ALL)),
o AS (SELECT x.recording_id, x.n, y.i, (least(x.stop_s, s1) - greatest(x.start_s, s0)) / least(x.stop_s - x.start_s, s1 - s0) AS share FROM x JOIN y ON y.recording_id = x.recording_id AND x.start_s < s1 AND s0 < x.stop_s),
c AS (SELECT x.recording_id, x.n, coalesce(list(o.i ORDER BY share DESC, o.i) FILTER (share >= 0.5), []) AS cand FROM x LEFT JOIN o USING (recording_id, n) GROUP BY 1, 2),
g AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM c
  UNION ALL SELECT recording_id, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT g.recording_id, c.n, g.used, list_filter(c.cand, lambda q: NOT list_contains(g.used, q))[1] AS pick FROM g JOIN c ON c.recording_id = g.recording_id AND c.n = g.n + 1)),
me AS (SELECT x.recording_id, y.event_id, coalesce(y.start_s, x.start_s) AS start_s, coalesce(y.stop_s, x.stop_s) AS stop_s, x.start_s AS source_start_s, x.stop_s AS source_stop_s, greatest(x.prob, y.prob) AS prob, coalesce(y.status, 'proposed') AS status FROM x JOIN g USING (recording_id, n) LEFT JOIN y ON y.recording_id = x.recording_id AND y.i = g.pick
  UNION ALL SELECT recording_id, event_id, start_s, stop_s, CASE WHEN status <> 'added' THEN s0 END, CASE WHEN status <> 'added' THEN s1 END, prob, status FROM y WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.recording_id = y.recording_id AND g.pick = y.i)),
ke AS (SELECT *, event_id > 0 AND event_id IS NOT NULL AND row_number() OVER (PARTITION BY recording_id, event_id ORDER BY start_s, stop_s) = 1 AS keep FROM me),
us AS (SELECT recording_id, coalesce(list(event_id) FILTER (keep), []) AS used, count(*) AS n FROM ke GROUP BY 1),
nu AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s ROWS UNBOUNDED PRECEDING) AS place FROM ke)"""


@query("RECURSIVE" + EVENTS + REVIEWED + " SELECT nu.recording_id, CAST(CASE WHEN keep THEN event_id ELSE list_filter(range(1, us.n + len(used) + 1), lambda q: NOT list_contains(used, q))[CAST(place AS BIGINT)] END AS INTEGER) AS event_id, round(start_s, 6) AS start_s, round(stop_s, 6) AS stop_s, round(source_start_s, 6) AS source_start_s, round(source_stop_s, 6) AS source_stop_s, round(prob, 6) AS prob, status FROM nu JOIN us USING (recording_id)")
def review_merge(spark, d):
    """Events at 0.5 as proposals, merged with reviewed events made of the references, then numbered."""
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "stop_s"))
    old = T.references(spark, d).withColumn("i", place)
    source = F.col("i") % 3 > 0
    old = old.select("recording_id", F.when(F.col("i") % 4 > 0, F.col("i") * 3).alias("event_id"), "start_s", "stop_s", F.when(source, F.col("start_s") - 4).alias("source_start_s"), F.when(source, F.col("stop_s") + 3).alias("source_stop_s"), F.when(source, 0.25).alias("prob"), F.element_at(F.array(*map(F.lit, ("added", "accepted", "edited"))), F.col("i") % 3 + 1).alias("status"))
    new = events.events_from_windows(T.windows(spark, d), T.recordings(spark, d), [OP.threshold]).select("recording_id", "start_s", "stop_s", "prob")
    return r6(events.assign_event_ids(matching.merge_review_state(new, old)).drop("review_note"))


SHARED = """, p AS (SELECT a.recording_id, a.start_s, CAST(a.prob AS DOUBLE) AS pa, CAST(b.prob AS DOUBLE) AS pb FROM w a JOIN w2 b USING (recording_id, start_s) WHERE a.skip_code = 0 AND b.skip_code = 0 AND a.prob IS NOT NULL AND recording_id % 7 <> 0),
y AS (SELECT p.*, CAST(EXISTS (SELECT 1 FROM r WHERE r.recording_id = p.recording_id AND p.start_s < r.stop_s AND p.start_s + 12 > r.start_s) AS INTEGER) AS label FROM p),
z AS (SELECT 'a' AS arm, pa AS score, label FROM y UNION ALL SELECT 'b', pb, label FROM y), t AS (SELECT arm, score, sum(label) AS pos, sum(1 - label) AS neg FROM z GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY arm ORDER BY score DESC) AS cp FROM t),
au AS (SELECT arm, sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY 1)"""


@query(SHARED + " SELECT arm, round(auc, 6) AS auc, n_pos, n_neg, round(auc - (SELECT auc FROM au WHERE arm = 'a'), 6) AS delta_auc FROM au")
def arm_auc(spark, d):
    """Both arms scored again on the windows that both have: area of each and its distance from the first one's."""
    pairs = comparison.pair_arms(T.windows(spark, d).where("recording_id % 7 <> 0 and prob is not null"), T.second_arm(spark, d))
    return r6(metrics.arm_auc(labels.label_any_overlap(pairs, T.references(spark, d), OP.seg), {"a": "prob_a", "b": "prob_b"}, "a"))


@query(""", g AS (SELECT *, CASE WHEN start_s < max(stop_s) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r), h AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_s, stop_s ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT recording_id, round(min(start_s), 6) AS start_s, round(max(stop_s), 6) AS stop_s FROM h GROUP BY recording_id, g""")
def merge_overlapping(spark, d):
    return r6(intervals.merge_overlapping(T.references(spark, d)))


@query(SECONDS + """, h AS (SELECT recording_id, s, s - row_number() OVER (PARTITION BY recording_id ORDER BY s) AS i FROM sec WHERE CAST(p AS DOUBLE) >= 0.3), q AS (SELECT recording_id, CAST(min(s) AS DOUBLE) AS a, CAST(max(s) + 1 AS DOUBLE) AS z FROM h GROUP BY recording_id, i HAVING count(*) >= 8),
g AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 12 THEN 0 ELSE 1 END AS n FROM q), o AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM g) SELECT recording_id, min(a) AS start_s, max(z) AS stop_s FROM o GROUP BY recording_id, g""")
def merge_binary_seconds(spark, d):
    runs = seconds.runs_above(seconds.per_second(T.windows(spark, d), T.recordings(spark, d), OP.seg), 0.3)
    return intervals.merge_binary_seconds(runs, 12.0, 8.0)


@query(""", e AS (SELECT *, CASE WHEN floor(start_s) % 5 < 2 THEN NULL WHEN floor(start_s) % 5 = 2 THEN -1 ELSE CAST(floor(start_s) AS INTEGER) % 4 END AS id FROM r),
f AS (SELECT *, id > 0 AND row_number() OVER (PARTITION BY recording_id, id ORDER BY start_s, stop_s) = 1 AS ok FROM e), g AS (SELECT recording_id, list(id) FILTER (ok) AS used, count(*) AS n FROM f GROUP BY 1),
h AS (SELECT f.*, list_filter(range(1, n + coalesce(len(used), 0) + 1), lambda x: NOT list_contains(coalesce(used, []), x)) AS free, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY f.recording_id ORDER BY start_s, stop_s ROWS UNBOUNDED PRECEDING) AS nth FROM f JOIN g USING (recording_id))
SELECT recording_id, round(start_s, 6) AS start_s, round(stop_s, 6) AS stop_s, CAST(CASE WHEN ok THEN id ELSE free[CAST(nth AS BIGINT)] END AS INTEGER) AS event_id FROM h""")
def assign_event_ids(spark, d):
    k = F.floor("start_s") % 5
    e = T.references(spark, d).withColumn("event_id", F.when(k < 2, None).when(k == 2, -1).otherwise((F.floor("start_s") % 4).cast("int")))
    return r6(events.assign_event_ids(e).select("recording_id", "start_s", "stop_s", "event_id"))


@query(", pe AS (SELECT r.recording_id, r.start_s, r.stop_s, max(CAST(w.prob AS DOUBLE)) AS peak FROM r JOIN w ON w.recording_id = r.recording_id AND w.start_s < r.stop_s AND w.start_s + 12 > r.start_s GROUP BY ALL HAVING max(w.prob) IS NOT NULL) SELECT t AS threshold, round(avg(CASE WHEN peak >= t THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n_refs FROM pe, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS t) GROUP BY 1")
def recall_at(spark, d):
    return r6(labels.recall_at(labels.peak_per_reference(T.windows(spark, d), T.references(spark, d), OP.seg), (0.1, 0.5, 0.9)))


@query(", s AS (SELECT r.*, duration_s FROM r JOIN rec USING (recording_id) WHERE floor(start_s) % 2 = 0) SELECT recording_id, round(start_s - o, 6) AS start_s, 'seiz' AS label FROM s, (SELECT unnest([3, 4]) AS o) WHERE start_s - o >= 0 AND start_s - o + 5 <= duration_s")
def pre_onset_windows(spark, d):
    iv = T.references(spark, d).withColumn("label", F.when(F.floor("start_s") % 2 == 0, "seiz").otherwise("bckg")).join(T.recordings(spark, d).select("recording_id", "duration_s"), "recording_id")
    return r6(windows.pre_onset_windows(iv, 5))


@query(" SELECT count(*) AS recordings, round(sum(duration_s) / 3600, 6) AS hours, round((SELECT sum(stop_s - start_s) FROM r) / 3600, 6) AS ictal_hours, round((SELECT sum(stop_s - start_s) FROM r) / sum(duration_s), 6) AS ictal_share FROM rec WHERE has_reference")
def corpus_totals(spark, d):
    rec = T.recordings(spark, d).select("recording_id", "has_reference", F.lit(None).cast("double").alias("duration_s"))
    return r6(comparison.corpus_totals(comparison.build_manifest(rec, T.references(spark, d), T.windows(spark, d), OP.seg)))


@query(LABELLED + " SELECT round(avg(CAST(label AS DOUBLE)), 6) AS precision, count(*) AS n FROM l WHERE CAST(prob AS DOUBLE) >= 0.5")
def precision_at_threshold(spark, d):
    return r6(metrics.precision_at_threshold(_scored(spark, d), OP.threshold))


@query(LABELLED + ", f AS (SELECT recording_id, count(*) AS n FROM l WHERE label = 0 AND CAST(prob AS DOUBLE) >= 0.5 GROUP BY 1), n AS (SELECT recording_id, coalesce(n, 0) AS n FROM rec LEFT JOIN f USING (recording_id) WHERE has_reference) SELECT recording_id, n, row_number() OVER (ORDER BY n DESC, recording_id) AS rank, round(sum(n) OVER (ORDER BY n DESC, recording_id) / (SELECT sum(n) FROM n), 6) AS share FROM n")
def false_positive_concentration(spark, d):
    false = _scored(spark, d).where((F.col("label") == 0) & (F.col("prob").cast("double") >= OP.threshold))
    return r6(metrics.false_positive_concentration(false, T.recordings(spark, d).where("has_reference")))


@query(" SELECT recording_id, round(quantile_cont(CAST(prob AS DOUBLE), 0.85), 6) AS background FROM w WHERE skip_code = 0 AND prob IS NOT NULL GROUP BY 1")
def background_percentiles(spark, d):
    return r6(metrics.background_percentiles(T.windows(spark, d).where("prob is not null")))


def _reviewed(spark, d) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("proposed", "accepted", "edited", "rejected", "added"))), (F.floor("start_s") % 5 + 1).cast("int"))
    return T.references(spark, d).withColumns({"status": status, "prob": F.lit(0.7)})


REVIEWED = ", ve AS (SELECT r.recording_id, ['proposed', 'accepted', 'edited', 'rejected', 'added'][CAST(floor(start_s) AS INTEGER) % 5 + 1] AS status, greatest(start_s, 0) AS a, least(stop_s, duration_s) AS z FROM r JOIN rec USING (recording_id))"


@query(REVIEWED + " SELECT recording_id, round(a, 6) AS start_s, round(z, 6) AS stop_s, CAST(1.0 AS DOUBLE) AS confidence, CAST(0.7 AS DOUBLE) AS model_score, status = 'added' AS human_originated FROM ve WHERE status IN ('accepted', 'edited', 'added') AND z > a")
def export_selection(spark, d):
    return r6(comparison.export_selection(_reviewed(spark, d), T.recordings(spark, d)))


@query(REVIEWED + ", x AS (SELECT recording_id, count(*) AS n FROM ve WHERE status IN ('accepted', 'edited', 'added') AND z > a GROUP BY 1), u AS (SELECT recording_id, count(*) FILTER (skip_code <> 0) AS n FROM w GROUP BY 1) SELECT rec.recording_id, coalesce(x.n, 0) AS exported, coalesce(u.n, 0) AS unassessed, coalesce(x.n, 0) = 0 AS empty_export FROM rec LEFT JOIN x USING (recording_id) LEFT JOIN u USING (recording_id)")
def export_summary(spark, d):
    return comparison.export_summary(_reviewed(spark, d), T.windows(spark, d), T.recordings(spark, d))


@query(" SELECT recording_id, round(start_s, 6) AS start_s, round(stop_s, 6) AS stop_s, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_s, stop_s) AS INTEGER) AS place FROM r")
def worklist(spark, d):
    return r6(matching.worklist(T.references(spark, d)).select("recording_id", "start_s", "stop_s", "place"))


@query(" SELECT recording_id, duration_s FROM rec ORDER BY duration_s, recording_id LIMIT 20")
def shortest_first(spark, d):
    return matching.shortest_first(T.recordings(spark, d), 20).select("recording_id", "duration_s")


@query(", p AS (SELECT a.recording_id, max(abs(CAST(a.prob AS DOUBLE) - CAST(b.prob AS DOUBLE))) AS x FROM w a JOIN w2 b USING (recording_id, start_s) WHERE a.skip_code = 0 AND b.skip_code = 0 GROUP BY 1) SELECT recording_id, round(x, 6) AS largest FROM p ORDER BY x DESC, recording_id LIMIT 10")
def worst_recordings(spark, d):
    return r6(comparison.worst_recordings(T.windows(spark, d), T.second_arm(spark, d), 10))


@query(" SELECT recording_id, 'p' || recording_id % 20 AS patient, 'p' || recording_id % 20 || '_s' || recording_id % 3 || '_t00' || recording_id % 5 || '_' || recording_id AS session FROM rec")
def patient_and_session(spark, d):
    r = F.col("recording_id")
    stem = F.concat_ws("_", *[F.concat(F.lit(p), x.cast("string")) for p, x in (("p", r % 20), ("s", r % 3), ("t00", r % 5), ("n", r % 2), ("q", r % 4), ("", r))])
    named = T.recordings(spark, d).select("recording_id", F.concat(stem, F.lit(".npy")).alias("stem"))
    return named.select("recording_id", comparison.patient_of(F.col("stem")).alias("patient"), comparison.session_key(F.col("stem")).alias("session"))


@query(" SELECT a.recording_id AS rec_a, b.recording_id AS rec_b, count(*) AS shared, count(*) FILTER (a.start_s = b.start_s AND a.stop_s = b.stop_s) AS exact FROM r a JOIN r b ON a.recording_id % 2 = 0 AND b.recording_id % 2 = 1 AND abs(a.start_s - b.start_s) <= 0.05 AND abs(a.stop_s - b.stop_s) <= 0.05 GROUP BY 1, 2")
def boundary_fingerprint_match(spark, d):
    r = T.references(spark, d)
    return comparison.boundary_fingerprint_match(r.where("recording_id % 2 = 0"), r.where("recording_id % 2 = 1"))


@query(" SELECT recording_id, CAST(count(*) AS BIGINT) * 100 AS size FROM w WHERE recording_id % 4 <> 0 GROUP BY 1 HAVING recording_id % 3 <> 0 UNION ALL SELECT recording_id, CAST(count(*) AS BIGINT) * 100 FROM w WHERE recording_id % 4 = 0 GROUP BY 1")
def scoring_backlog(spark, d):
    """Runs exist for three recordings of four; those of sizes that changed since are stale."""
    size = T.windows(spark, d).groupBy("recording_id").agg((F.count("*") * 100).alias("size")).withColumn("mtime", F.lit(1000.0))
    runs = size.where("recording_id % 4 <> 0").select("recording_id", (F.col("size") + F.when(F.col("recording_id") % 3 == 1, 1).otherwise(0)).alias("size"), F.when(F.col("recording_id") % 3 == 2, 1002.0).otherwise(1000.9).alias("mtime"))
    return comparison.scoring_backlog(size, runs).select("recording_id", "size")


@query(LABELLED + ", q AS (SELECT unnest(quantile_cont(CAST(prob AS DOUBLE), [" + ", ".join(f"{i}.0 / 15" for i in range(1, 15)) + "])) AS e FROM l), bi AS (SELECT (SELECT count(DISTINCT e) FROM q WHERE e <= CAST(prob AS DOUBLE) AND e < (SELECT max(CAST(prob AS DOUBLE)) FROM l)) AS bin, CAST(prob AS DOUBLE) AS p, label FROM l) SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS observed, CAST(sum(label) AS BIGINT) AS n_pos FROM bi GROUP BY bin")
def reliability_quantile(spark, d):
    return r6(metrics.reliability(_scored(spark, d)).drop("bin"))


@query()
def precision_interval(spark, d):
    return r6(calibration.precision_bootstrap(_scored(spark, d), OP.grid, "recording_id"))


@query()
def ece_interval(spark, d):
    return r6(calibration.ece_bootstrap(_scored(spark, d), "recording_id"))


@query()
def ece_methods(spark, d):
    """Errors over 15 quantile bins drawn anew, of raw and calibrated scores, and of their differences, by resampling recordings."""
    s = calibration.all_calibrated(_scored(spark, d).withColumn("patient", F.col("recording_id") % 20), "patient", 5, ("platt",))
    return r6(binned_draws.ece_intervals(s, "recording_id", {"raw": "prob", "platt": "platt"}))


@query()
def fold_auc_delta(spark, d):
    s = _scored(spark, d).withColumn("patient", F.col("recording_id") % 20)
    return r6(calibration.fold_auc_delta(calibration.cross_validated(s, "patient", 5, "platt")))


def _temperatures(rounds: int) -> str:
    """Tables t1, t2, ...: fold, lo, hi of the logarithm of its temperature after so many rounds of a grid of 17."""
    out = "t0 AS (SELECT fold, CAST(-4 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi FROM fo)"
    for k in range(1, rounds + 1):
        out += f""",
l{k} AS (SELECT t.fold, i, lo, hi, sum(y * (greatest(-z / exp(lo + i * ((hi - lo) / 16)), 0) + ln(1 + exp(-abs(z / exp(lo + i * ((hi - lo) / 16)))))) + (n - y) * (greatest(z / exp(lo + i * ((hi - lo) / 16)), 0) + ln(1 + exp(-abs(z / exp(lo + i * ((hi - lo) / 16))))))) AS loss
  FROM t{k - 1} t JOIN ct ON ct.fold <> t.fold, (SELECT unnest(range(0, 17)) AS i) GROUP BY ALL),
t{k} AS (SELECT fold, lo + greatest(arg_min(i, loss) - 1, 0) * ((hi - lo) / 16) AS lo, lo + least(arg_min(i, loss) + 1, 16) * ((hi - lo) / 16) AS hi FROM l{k} GROUP BY fold, lo, hi)"""
    return out


@query(LABELLED + """, pa AS (SELECT DISTINCT recording_id % 20 AS patient FROM l), fo AS (SELECT patient, (row_number() OVER (ORDER BY md5(CAST(patient AS VARCHAR) || '|0')) - 1) AS fold FROM pa),
sc AS (SELECT fold, CAST(prob AS DOUBLE) AS p, label, ln(least(greatest(CAST(prob AS DOUBLE), 1e-6), 1 - 1e-6) / (1 - least(greatest(CAST(prob AS DOUBLE), 1e-6), 1 - 1e-6))) AS z FROM l JOIN fo ON fo.patient = l.recording_id % 20),
ct AS (SELECT fold, z, CAST(sum(label) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY 1, 2), """ + _temperatures(4) + """
SELECT CAST(sc.fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(p), 5) AS mean_raw, round(avg(1 / (1 + exp(-z / exp((lo + hi) / 2)))), 5) AS mean_calibrated FROM sc JOIN t4 USING (fold) GROUP BY sc.fold""")
def leave_one_out(spark, d):
    """Temperature of everything but one patient, for each patient at a time: rows, positives, mean raw and calibrated score."""
    s = _scored(spark, d).withColumn("patient", F.col("recording_id") % 20)
    out = calibration.all_calibrated(s, "patient", None, ("temperature",), rounds=4)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.round(F.avg(F.col("prob").cast("double")), 5).alias("mean_raw"), F.round(F.avg("temperature"), 5).alias("mean_calibrated"))
