"""Curves and runs by sweeping, chains and interval joins by cells: against plain loops, over stretches of any length."""

import contextlib
import io
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigevents.config import OperatingPoint
from sigevents.operators import curves, events, interval_join, intervals, labels, matching, seconds

OP = OperatingPoint()
W = "recording_id string, start_s double, prob float, skip_code int"


def recordings(seed, n=6, long=260):
    """Windows and durations with gaps, ties, exact thresholds, skips, odd starts, windows beyond the end."""
    r = random.Random(seed)
    rows, ends = [], []
    for i in range(n):
        duration = r.choice([0.0, 5.0, 37.5, long, long * 2.3])
        t = r.choice([0.0, 3.0, 2.5])
        while t < duration + 8:
            if r.random() < 0.9:
                rows.append((f"r{i}", t, r.choice([0.0, 0.5, 0.3, 1.0, r.random(), r.random()]) if r.random() < 0.95 else None, int(r.random() < 0.1)))
            t += r.choice([6.0, 6.0, 6.0, 1.0, 30.5])
        ends.append((f"r{i}", float(duration)))
    return rows + [("no duration", 0.0, 0.9, 0)], ends


def plain_curve(rows, duration, seg, how, exclude=False):
    out = []
    for s in range(math.ceil(duration)):
        p = [float(np.float32(p)) for t, p, k in rows if p is not None and not (exclude and k) and math.floor(t) <= s < math.ceil(t + seg)]
        out.append(np.float32((max(p) if how == "max" else sum(p) / len(p)) if p else 0))
    return out


@pytest.mark.parametrize("span_s", [13, 60, 86_400])
def test_curves(spark, span_s):
    rows, ends = recordings(1)
    w, d = spark.createDataFrame(rows, W).repartition(5), spark.createDataFrame(ends, "recording_id string, duration_s double")
    for how in ("mean", "max"):
        for policy in ("zero", "exclude"):
            got: dict = {}
            for x in seconds.per_second(w, d, 12, how, policy, span_s=span_s).collect():
                got.setdefault(x.recording_id, {})[x.s] = np.float32(x.p)
            for rec, duration in ends:
                mine = [x[1:] for x in rows if x[0] == rec]
                want = plain_curve(mine, duration, 12, how, policy == "exclude") if mine else []
                assert got.get(rec, {}) == pytest.approx(dict(enumerate(want)), abs=1e-7), (rec, how, policy)
            assert "no duration" not in got


def plain_events(rows, duration, thresholds, average, shape):
    out = set()
    for t in thresholds:
        if average:
            marks = [(float(s), s + 1.0, float(p)) for s, p in enumerate(plain_curve(rows, duration, OP.seg, "mean")) if float(p) >= t]
        else:
            marks = sorted((a, a + OP.seg, float(np.float32(p))) for a, p, _ in rows if p is not None and float(np.float32(p)) >= t)

        def join(spans, gap):
            made: list[list[float]] = []
            for a, b in spans:
                if made and a - made[-1][1] < gap:
                    made[-1][1] = max(made[-1][1], b)
                else:
                    made.append([a, b])
            return made

        found = join([m[:2] for m in marks], 1e-9)
        if shape:
            found = [x for x in join(found, OP.merge_gap) if x[1] - x[0] >= OP.min_duration]
        for a, b in found:
            a, b = max(a, 0.0), min(b, duration)
            if b > a:
                out.add((t, a, b, round(max(p for x, y, p in marks if x < b and y > a), 6)))
    return out


@pytest.mark.parametrize("span_s", [17, 50, 86_400])
def test_events_of_many_thresholds(spark, span_s):
    """Five thresholds and two hundred, averaged or not, shaped or not, cut into stretches or not."""
    rows, ends = recordings(2)
    w, d = spark.createDataFrame(rows, W).repartition(4), spark.createDataFrame(ends, "recording_id string, duration_s double")
    many = [0.5, 0.3, 0.1, 0.05, 0.01] if span_s == 50 else [round(0.005 * k, 3) for k in range(1, 201)]
    for average in (True, False):
        got: dict = {}
        for x in curves.threshold_events(w, d, many, OP.seg, OP.min_duration, OP.merge_gap, average, (False, True), span_s=span_s).collect():
            got.setdefault((x.recording_id, x.shaped), []).append((x.threshold, x.start_s, x.stop_s, round(x.prob, 6)))
        for rec, duration in ends:
            for shape in (False, True):
                want = plain_events([x[1:] for x in rows if x[0] == rec], duration, many, average, shape)
                mine = got.get((rec, shape), [])
                assert len(mine) == len(set(mine)) and set(mine) == want, (rec, shape, average)
        assert not any(k[0] == "no duration" for k in got) and sum(map(len, got.values())) > 50


def test_rows_shuffled_do_not_grow_with_thresholds(spark):
    rows, ends = recordings(3, 4)
    w, d = spark.createDataFrame(rows, W), spark.createDataFrame(ends, "recording_id string, duration_s double")
    assert curves.dealt(w, d, 12, ["recording_id"], 60).where("not axis").count() <= 2 * len(rows)
    plans = []
    for thresholds in ([0.5], [k / 200 for k in range(200)]):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            events.events_from_windows(w, d, thresholds).explain()
        plans.append(out.getvalue())
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and all(p.count("MapInArrow") == 1 for p in plans)


def test_range_maxima():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 100):
        p = r.random(n)
        of = curves.range_maxima(p)
        a = r.integers(0, n, 50)
        b = a + 1 + (r.random(50) * (n - a)).astype(int)
        assert of(a, b).tolist() == [p[i:j].max() for i, j in zip(a, b)]


def spans(r, n, top=400.0):
    return [(a, a + r.choice([0.0, 3.0, 12.0, 90.0, r.random() * 20])) for a in (round(r.random() * top, 1) for _ in range(n))]


@pytest.mark.parametrize("cell_s", [7.0, 60.0, 86_400.0])
def test_matching_by_chains(spark, cell_s):
    r = random.Random(4)
    preds = {(f"r{i}", t): spans(r, r.randrange(60)) for i in range(4) for t in (0.5, 0.1)}
    refs = {f"r{i}": spans(r, r.choice([0, 3, 30])) for i in range(4)}
    p = spark.createDataFrame([(*k, *x) for k, v in preds.items() for x in v], "recording_id string, threshold double, start_s double, stop_s double")
    f = spark.createDataFrame([(k, *x) for k, v in refs.items() for x in v], "recording_id string, start_s double, stop_s double")
    keys = spark.createDataFrame(list(preds), "recording_id string, threshold double")
    got = sorted(map(str, map(tuple, matching.match_events(p, f, 5.0, keys, cell_s).collect())))

    def plain(preds, refs, tol):
        preds, refs = sorted(preds), sorted(refs)
        free, out = set(range(len(refs))), []
        for a, b in preds:
            near = [i for i, (x, y) in enumerate(refs) if a <= y + tol and b >= x - tol]
            mine = [i for i in near if i in free]
            if mine:
                best = min(mine, key=lambda i: (-max(0.0, min(b, refs[i][1]) - max(a, refs[i][0])), abs(a - refs[i][0]), abs(b - refs[i][1]), i))
                free.discard(best)
                out.append(("match", a, b, *refs[best]))
            else:
                out.append(("duplicate" if near else "false_positive", a, b, None, None))
        return out + [("miss", None, None, *refs[i]) for i in free]

    assert got == sorted(str((*k, *x)) for k, v in preds.items() for x in plain(v, refs[k[0]], 5.0))


@pytest.mark.parametrize("cell_s", [9.0, 86_400.0])
def test_event_lists_by_chains(spark, cell_s):
    r = random.Random(5)
    x, y = ({f"r{i}": sorted(spans(r, 40)) for i in range(3)} for _ in range(2))
    a, b = (spark.createDataFrame([(k, *s) for k, v in z.items() for s in v], "recording_id string, start_s double, stop_s double") for z in (x, y))
    got = {q.recording_id: (q.matched, q.lost, q.gained, q.max_shift) for q in matching.compare_event_lists(a, b, cell_s).collect()}
    for rec in x:
        free, matched, shift = set(range(len(y[rec]))), 0, 0.0
        for s, e in x[rec]:
            over = [(min(e, y[rec][i][1]) - max(s, y[rec][i][0]), -i) for i in free]
            if over and max(over)[0] > 0:
                i = -max(over)[1]
                free.discard(i)
                matched += 1
                shift = max(shift, abs(s - y[rec][i][0]), abs(e - y[rec][i][1]))
        assert got[rec] == (matched, len(x[rec]) - matched, len(free), shift)


@pytest.mark.parametrize("cell_s", [10.0, 86_400.0])
def test_review_merge_by_chains(spark, cell_s):
    """Each proposal takes the best unused reviewed event, by plain search among all; events without a source extent, and with another extent than their source's."""
    r = random.Random(6)
    new, old = {}, {}
    for i in range(3):
        new[f"r{i}"] = [(a, a + 1 + r.random() * 30, r.random()) for a in sorted({round(r.random() * 500, 2) for _ in range(40)})]
        old[f"r{i}"] = [(k, a, a + 2 + r.random() * 20, *((a + 300 * r.random(), 0.0) if r.random() < 0.3 else (None, None)), r.choice([None, r.random()])) for k, a in enumerate(sorted({round(r.random() * 500, 2) for _ in range(40)}), 1)]
        old[f"r{i}"] = [(k, a, b, s, s + 15 if s is not None else None, p) for k, a, b, s, _, p in old[f"r{i}"]]
    p = spark.createDataFrame([(k, *x) for k, v in new.items() for x in v], "recording_id string, start_s double, stop_s double, prob double")
    o = spark.createDataFrame([(k, *x, "edited") for k, v in old.items() for x in v], "recording_id string, event_id int, start_s double, stop_s double, source_start_s double, source_stop_s double, prob double, status string")
    got: dict = {}
    for x in matching.merge_review_state(p, o, cell_s=cell_s).collect():
        got.setdefault(x.recording_id, []).append((x.event_id, x.start_s, x.stop_s, x.source_start_s, x.source_stop_s, x.prob, x.status))
    for rec in new:
        used, want = set(), []
        for a, b, q in new[rec]:
            best = None
            for i, (_, s, e, s0, s1, _) in enumerate(old[rec]):
                c, d = (s, e) if s0 is None else (s0, s1)
                share = (min(b, d) - max(a, c)) / min(b - a, d - c)
                if i not in used and share >= 0.5 and (best is None or share > best[0]):
                    best = (share, i)
            if best:
                used.add(best[1])
                k, s, e, _, _, z = old[rec][best[1]]
                want.append((k, s, e, a, b, q if z is None else max(q, z), "edited"))
            else:
                want.append((None, a, b, a, b, q, "proposed"))
        want += [(k, s, e, s0, s1, z, "edited") for i, (k, s, e, s0, s1, z) in enumerate(old[rec]) if i not in used]
        assert sorted(map(str, got[rec])) == sorted(map(str, want))
        assert any(w[0] and w[6] == "edited" and w[3] != w[1] for w in want)


def test_a_long_recording_is_many_chains(spark):
    """100,000 events of one recording: chains over many tasks, in little time."""
    n = 50_000
    a = spark.range(n).select(F.lit("r").alias("recording_id"), F.lit(0.5).alias("threshold"), (F.col("id") * 20.0).alias("start_s"), (F.col("id") * 20.0 + 9 + F.col("id") % 3).alias("stop_s"))
    refs = a.where("start_s % 40 = 0").select("recording_id", (F.col("start_s") + 2).alias("start_s"), "stop_s").union(a.select("recording_id", F.col("start_s") + 5, F.col("start_s") + 6).limit(n // 2))
    began = time.time()
    got = matching.match_events(a, refs, 3.0, a.select("recording_id", "threshold").distinct())
    kinds = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    assert time.time() - began < 60 and kinds["match"] >= n // 2 and sum(kinds.values()) >= n
    used = matching.chained(a.withColumn("side", F.lit(0)), ["recording_id"], 3.0)
    assert used.select("chain").distinct().count() == n
    shared = used.groupBy(F.pmod(F.xxhash64("recording_id", "chain"), F.lit(8))).count().collect()
    assert len(shared) == 8 and max(r["count"] for r in shared) < n / 6


@pytest.mark.parametrize("cell_s", [None, 1.0, 30.0, 3_600.0])
def test_meeting_intervals(spark, cell_s):
    r = random.Random(7)
    left, right = ([(r.choice(["a", "b", None]), *s) for s in spans(r, 150)] + [("a", 5.0, 5_000.0), ("a", None, 3.0), ("b", -40.0, 2.0), ("b", 8.0, 8.0)] for _ in range(2))
    kind = "recording_id string, start_s double, stop_s double"
    x, y = spark.createDataFrame(left, kind).repartition(3), spark.createDataFrame(right, kind)
    for strict, tol in ((True, 0.0), (False, 0.0), (False, 4.0)):
        got = sorted(map(str, map(tuple, interval_join.meeting(x, y, strict=strict, tol=tol, cell_s=cell_s).collect())))
        want = [(k, a, b, c, d) for k, a, b in left for j, c, d in right if k is not None and k == j and None not in (a, b, c, d) and (a < d and b > c if strict else a <= d + tol and b >= c - tol)]
        assert got == sorted(map(str, want)) and len(want) > 500


def test_operators_by_cells(spark):
    """Every operator on the join gives the same rows by any cells."""
    r = random.Random(8)
    rows, ends = recordings(8, 5)
    w = spark.createDataFrame(rows, W).where("prob is not null")
    refs = spark.createDataFrame([(rec, a, b) for rec, _ in ends for a, b in spans(r, 8, 250.0) if b > a], "recording_id string, start_s double, stop_s double")
    ev = w.select("recording_id", "start_s", (F.col("start_s") + 7).alias("stop_s"), F.lit(0.5).alias("threshold"), F.lit(0.5).alias("confidence"))
    refs_c = refs.withColumn("confidence", F.lit(0.25))
    keys = ev.select("recording_id", "threshold").distinct()
    found = []
    for cell_s in (None, 2.0, 50.0):
        tables = [labels.label_any_overlap(w, refs, 12, cell_s=cell_s), labels.label_fully_inside(w, refs, 12, cell_s=cell_s), labels.peak_per_reference(w, refs, 12, False, True, cell_s), labels.background_stats(w, refs, 12, cell_s), matching.proximity_hits(ev, refs, 2.0, cell_s=cell_s), matching.proximity_misses(ev, refs, 2.0, cell_s=cell_s), matching.score_overlap(ev, refs, keys, 30.0, cell_s), intervals.intersect_hypotheses(ev, refs_c, cell_s=cell_s), intervals.discarded_runs(ev, refs, cell_s=cell_s)]
        found.append([sorted(map(str, map(tuple, t.collect()))) for t in tables])
    assert found[0] == found[1] == found[2] and all(found[0])


def test_one_recording_over_many_tasks(spark):
    """A million windows of one recording: the join deals them by cell."""
    w = spark.range(1_000_000).select(F.lit("r").alias("recording_id"), (F.col("id") * 6).alias("start_s"), F.lit(0.5).alias("prob"))
    refs = spark.range(2_000).select(F.lit("r").alias("recording_id"), (F.col("id") * 3_000.0 + 1).alias("start_s"), (F.col("id") * 3_000.0 + 40).alias("stop_s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        met = interval_join.meeting(w, refs, until=F.col("start_s") + 12).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        for k, v in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "4")):
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(met) >= 8 and max(r["count"] for r in met) < sum(r["count"] for r in met) / 4


def test_pieces_of_many_stretches_are_those_of_each():
    r = np.random.default_rng(3)
    begin = np.array([0.0, 100.0, 0.0, 200.0, 300.0])
    end = np.array([100.0, 131.5, 40.0, 300.0, 400.0])
    starts = [np.sort(b + r.integers(-20, 120, n) * r.choice([0.1, 1.0])) for b, n in zip(begin, (40, 25, 0, 1, 30), strict=True)]
    of, start = np.repeat(np.arange(5), list(map(len, starts))), np.concatenate(starts)
    got = curves.pieces_of_many(of, start, start + 12, begin, end)
    before = 0
    for k, s in enumerate(starts):
        edges, first, last = curves.pieces(s, s + 12, begin[k], end[k])
        mine = got[0] == k
        for x, y in zip(got[1:], (edges[:-1], edges[1:], first + before, last + before), strict=True):
            assert x[mine].tolist() == y.tolist()
        before += len(s)


def test_runs_end_where_their_stretch_ends():
    stretch, value = np.array([0, 0, 1, 1, 1, 2]), np.array([0.2, 0.9, 0.9, 0.1, 0.6, 0.6])
    which, first, last = curves.nested_runs(stretch, value, np.array([0.15, 0.5]))
    assert list(zip(which.tolist(), first.tolist(), last.tolist(), strict=True)) == [(0, 0, 1), (1, 1, 1), (0, 2, 2), (0, 4, 4), (1, 2, 2), (1, 4, 4), (0, 5, 5), (1, 5, 5)]


def test_matches_of_several_names_are_those_of_each(spark):
    rows = [(1, 0.5, "x", 0.0, 10.0), (1, 0.5, "y", 40.0, 50.0), (1, 0.5, "y", 9.0, 19.0), (2, 0.5, "x", 0.0, 5.0)]
    preds = spark.createDataFrame(rows, "recording_id long, threshold double, config string, start_s double, stop_s double")
    refs = spark.createDataFrame([(1, 8.0, 18.0), (2, 90.0, 99.0)], "recording_id long, start_s double, stop_s double")
    keys = spark.createDataFrame([(i, 0.5, c) for i in (1, 2) for c in "xy"], "recording_id long, threshold double, config string")
    got = sorted(map(str, map(tuple, matching.match_events(preds, refs, 5.0, keys, by=["recording_id", "threshold", "config"]).collect())))
    want = []
    for c in "xy":
        one = matching.match_events(preds.where(f"config = '{c}'").drop("config"), refs, 5.0, keys.where(f"config = '{c}'").drop("config"))
        want += [str((*x[:2], c, *x[2:])) for x in map(tuple, one.collect())]
    assert got == sorted(want)
