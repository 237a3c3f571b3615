"""Hand-made cases of the path from windows to events, metrics and review."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigevents.config import OperatingPoint
from sigevents.operators import calibration, channels, comparison, events, features, intervals, labels, matching, metrics, resampling, seconds, windows
from sigevents.sources import files

W = "recording_id string, start_s int, prob float, skip_code int"
E = "recording_id string, start_s double, stop_s double"


def win(spark, starts, probs, skip=None, rec="a"):
    return spark.createDataFrame([(rec, s, float(p), k) for s, p, k in zip(starts, probs, skip or [0] * len(starts))], W)


def dur(spark, d, rec="a"):
    return spark.createDataFrame([(rec, float(d))], "recording_id string, duration_s double")


def ev(spark, *pairs, rec="a"):
    return spark.createDataFrame([(rec, float(a), float(b)) for a, b in pairs], E)


def spans(df):
    return sorted((r.start_s, r.stop_s) for r in df.collect())


def curve(df):
    return [round(r.p, 4) for r in df.orderBy("s").collect()]


def test_per_second_mean(spark):
    assert curve(seconds.per_second(win(spark, [0], [0.8]), dur(spark, 12), 12)) == [0.8] * 12
    assert curve(seconds.per_second(win(spark, [0, 6], [1, 0]), dur(spark, 18), 12)) == [1] * 6 + [0.5] * 6 + [0] * 6
    assert curve(seconds.per_second(win(spark, [0], [1]), dur(spark, 30), 12)) == [1] * 12 + [0] * 18
    assert curve(seconds.per_second(win(spark, [], []), dur(spark, 30), 12)) == []
    two = win(spark, [0, 6], [0.9, 0], [0, 1])
    assert curve(seconds.per_second(two, dur(spark, 18), 12, skip_policy="exclude")) == [0.9] * 12 + [0] * 6
    assert curve(seconds.per_second(two, dur(spark, 18), 12))[6:12] == [0.45] * 6


def test_joining_and_dropping(spark):
    assert spans(intervals.concatenate_nearby(ev(spark, (0, 10), (15, 25)), 10)) == [(0, 25)]
    assert len(spans(intervals.concatenate_nearby(ev(spark, (0, 10), (30, 40)), 10))) == 2
    assert len(spans(intervals.concatenate_nearby(ev(spark, (0, 10), (20, 30)), 10))) == 2
    assert spans(intervals.concatenate_nearby(ev(spark, (0, 50), (5, 10), (55, 60)), 10)) == [(0, 60)]
    assert spans(intervals.discard_short(ev(spark, (0, 3), (10, 20)), 5)) == [(10, 20)]
    assert spans(intervals.discard_short(ev(spark, (0, 5)), 5)) == [(0, 5)]
    three = ev(spark, (0, 3), (6, 9), (18, 21))
    assert spans(intervals.shape_events(three, 5, 10)) == [(0, 21)]
    assert spans(intervals.shape_events(three, 5, 10, strict_discard_first=True)) == []


def test_events_from_windows(spark):
    starts = list(range(0, 120, 6))
    spike = [0.02] * 20
    spike[10] = 0.95
    one = win(spark, starts, spike)
    assert events.events_from_windows(one, dur(spark, 132), [0.5]).count() == 0
    raw = events.events_from_windows(one, dur(spark, 132), [0.5], average=False, shape=False).collect()
    assert [(r.start_s, r.stop_s) for r in raw] == [(60, 72)]
    longer = [0.95 if 5 <= i <= 11 else 0.02 for i in range(20)]
    got = events.events_from_windows(win(spark, starts, longer), dur(spark, 132), [0.5]).collect()
    assert len(got) == 1 and got[0].stop_s - got[0].start_s >= 5 and got[0].prob > 0.5
    assert spans(events.events_from_windows(win(spark, range(0, 60, 6), [0.99] * 10), dur(spark, 40), [0.5])) == [(0, 40)]
    op = OperatingPoint(seg=1, step=1)
    short = win(spark, range(30), [0.9 if 10 <= i <= 12 else 0 for i in range(30)])
    assert events.events_from_windows(short, dur(spark, 30), [0.5], op).count() == 0
    assert spans(events.events_from_windows(short, dur(spark, 30), [0.5], op, shape=False)) == [(10, 13)]
    got = spans(events.events_from_windows(win(spark, [0, 6, 12], [0.02, 0.99, 0.02]), dur(spark, 30), [0.5]))
    assert got == [(6, 18)]
    assert spans(events.consecutive_window_events(win(spark, [0, 6], [0.9, 0.1]), 0.5, 12, dur(spark, 60))) == [(0, 12)]


def test_clamp_and_spans(spark):
    a, b = intervals.clamp_interval(F.lit(50.0), F.lit(-5.0), F.lit(40.0), 0.1)
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (r.a, r.b) == (0, 40)
    assert spans(intervals.unscored_spans(win(spark, [0, 6, 12], [0] * 3, [1] * 3), 12)) == [(0, 24)]
    assert spans(intervals.unscored_spans(win(spark, [0, 6, 12, 60], [0] * 4, [1, 0, 0, 2]), 12)) == [(0, 12), (60, 72)]
    assert spans(intervals.unscored_spans(win(spark, range(0, 294, 6), [0] * 49, [1] * 49), 12)) == [(0, 300)]
    assert spans(intervals.discarded_runs(ev(spark, (0, 3), (10, 20)), ev(spark, (9, 21)))) == [(0, 3)]
    assert spans(intervals.merge_overlapping(ev(spark, (0, 10), (5, 20), (20, 30)))) == [(0, 20), (20, 30)]
    assert spans(intervals.merge_binary_seconds(ev(spark, (0, 10), (12, 13), (20, 30)), 10, 5)) == [(0, 30)]


def test_validate_windows(spark):
    x = spark.createDataFrame([("a", 0, 0.9, None), ("a", 6, 0.0, None), ("a", 12, 0.1, None)], W)
    assert [(r.skip_code, r.skip_code_is_exact) for r in files.validate_windows(x).orderBy("start_s").collect()] == [(0, False), (1, False), (0, False)]
    x = spark.createDataFrame([("a", 0, 0.0004, 0), ("a", 6, 0.0, 1)], W)
    assert [(r.skip_code, r.skip_code_is_exact) for r in files.validate_windows(x).orderBy("start_s").collect()] == [(0, True), (1, True)]
    x = spark.createDataFrame([("a", 0, float("nan"), 0), ("b", 0, 0.5, 0)], W)
    assert [r.recording_id for r in files.validate_windows(x).collect()] == ["b"]


def test_labels(spark):
    ref = ev(spark, (30, 90))
    got = {r.start_s: (r.label, r.keep) for r in labels.label_fully_inside(win(spark, [36, 0, 24, 84], [0] * 4), ref, 12).collect()}
    assert got == {36: (1, True), 0: (0, True), 24: (0, False), 84: (0, False)}
    assert labels.label_fully_inside(win(spark, [0], [0]), ev(spark, (0, 12)), 12).first().label == 1
    both = labels.label_fully_inside(labels.label_any_overlap(win(spark, range(0, 120, 6), [0] * 20), ref, 12).withColumnRenamed("label", "any"), ref, 12).collect()
    assert all(r.any == r.label for r in both if r.keep) and all(r.any == 1 for r in both if not r.keep)
    assert {r.label for r in labels.label_any_overlap(win(spark, range(0, 60, 6), [0] * 10), spark.createDataFrame([], E), 12).collect()} == {0}


def test_greedy():
    kinds = lambda m: [k for k, *_ in m]
    assert kinds(matching.greedy([(9, 21), (51, 58), (90, 96)], [(10, 20), (50, 60)], 5)) == ["match", "match", "false_positive"]
    assert kinds(matching.greedy([(10, 30), (36, 58)], [(10, 60)], 5)) == ["match", "duplicate"]
    assert kinds(matching.greedy([(10, 20), (200, 210)], [(10, 20)], 5)) == ["match", "false_positive"]
    assert kinds(matching.greedy([], [(100, 110)], 5)) == ["miss"]


def test_summary(spark):
    w, d, ref = win(spark, [0, 6, 18, 40], [0.7, 0.6, 0.1, 0.9]), dur(spark, 60), ev(spark, (5, 20))
    keys = spark.createDataFrame([("a", 0.5)], "recording_id string, threshold double")
    e = events.events_from_windows(w, d, [0.5], shape=False)
    r = matching.summarise_run(matching.match_events(e, ref, 5.0, keys), d, keys).first()
    assert (r.n_preds, r.hits, r.false_positives, r.sensitivity, r.fp_per_24h, r.onset_error) == (2, 1, 1, 1.0, 1440.0, 5.0)


def test_review(spark):
    p = spark.createDataFrame([("a", 12.0, 30.0, 0.9)], E + ", prob double")
    r = spark.createDataFrame([("a", 7, 10.0, 22.0, 12.0, 24.0, 0.8, "accepted", None)], "recording_id string, " + matching.REVIEW)
    got = matching.merge_review_state(p, r).collect()
    assert [(x.event_id, x.status, x.start_s, x.stop_s, x.prob) for x in got] == [(7, "accepted", 10, 22, 0.9)]
    r = spark.createDataFrame([("a", 3, 90.0, 110.0, None, None, None, "added", None)], "recording_id string, " + matching.REVIEW)
    got = matching.merge_review_state(p.limit(0), r).collect()
    assert [(x.event_id, x.status, x.prob) for x in got] == [(3, "added", None)]
    ids = spark.createDataFrame([("a", None, 0.0, 5.0), ("a", 2, 6.0, 9.0), ("a", 2, 10.0, 12.0)], "recording_id string, event_id int, start_s double, stop_s double")
    assert [x.event_id for x in events.assign_event_ids(ids).orderBy("start_s").collect()] == [1, 2, 3]


def test_auc_against_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(float(round(x, 1)), int(y)) for x, y in zip(r.random(300), r.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "prob double, label int")
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    true = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    for n in (1, 2, 8):
        assert metrics.roc_auc(df.repartition(n)).first().auc == pytest.approx(true)
    assert metrics.roc_auc(df.where("label = 1")).first().auc is None
    s = sorted(rows, reverse=True)
    ap, tp = 0.0, 0
    for v in sorted({x for x, _ in rows}, reverse=True):
        k = [y for x, y in s if x == v]
        before, tp = tp, tp + sum(k)
        ap += (tp - before) / len(pos) * tp / sum(x >= v for x, _ in rows)
    assert metrics.average_precision(df).first().ap == pytest.approx(ap)


def test_adaptive(spark):
    ref = lambda p, k=None: metrics.adaptive_reference(win(spark, range(0, 6 * len(p), 6), p, k)).first().reference
    assert ref([0.01] * 100) == 0.5 and ref([0.95] * 100) > 0.5 and ref([0.95] * 19) == 0.5
    mixed = [0.95] * 60 + [0.0] * 60
    assert ref(mixed, [0] * 60 + [1] * 60) >= ref(mixed)
    q = lambda x: metrics.adaptive_reference(win(spark, range(0, 600, 6), [0.01] * 80 + [0.99] * 20), x).first().noisy
    assert not q(0.5) and q(0.85)


def test_calibrators(spark):
    r = np.random.default_rng(3)
    p = r.random(2000)
    y = (r.random(2000) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b), i % 7) for i, (a, b) in enumerate(zip(p, y))], "prob double, label int, g int").cache()
    raw = metrics.ece_mce(metrics.reliability(df)).first().ece
    for m in ("temperature", "platt", "isotonic"):
        out = calibration.cross_validated(df, "g", 3, m)
        assert out.count() == 2000
        if m != "temperature":
            assert metrics.ece_mce(metrics.reliability(out, score="calibrated")).first().ece < raw / 2
    b = calibration.cluster_bootstrap(df, "g", 50).first()
    assert b.lo <= metrics.roc_auc(df).first().auc <= b.hi and b.n == 50


def test_spectra(spark):
    t = np.arange(3000) / 250
    tone = features.band_powers(20 * np.sin(2 * np.pi * 10 * t), 250)
    assert tone["alpha"] / sum(tone.values()) > 0.98 and abs(tone["alpha"] - 200) < 20
    assert set(features.band_powers(np.zeros(3000), 250).values()) == {0.0}
    x = np.random.default_rng(1).normal(size=(19, 3000)) * 30
    assert features.log_spectrogram(x).shape == (23, 19, 125) and (features.log_spectrogram(x) >= 0).all()
    assert features.interrupted(np.stack([x, np.vstack([x[:18], np.zeros((1, 3000))]), x * 0.01, x * 1000])).tolist() == [features.GOOD, features.RATIO, features.DC, features.UNSTABLE]
    assert features.interrupted(np.zeros((1, 0, 0))).tolist() == [features.EMPTY]
    assert np.allclose(features.resample(np.sin(2 * np.pi * 5 * np.arange(512) / 256), 500), np.sin(2 * np.pi * 5 * np.arange(500) / 250), atol=1e-9)


def test_channels(spark):
    n = spark.createDataFrame([("EEG T7-REF",), (" Fp1 ",), ("EEG O1-LE",)], "c string").select(channels.normalise_channel(F.col("c")).alias("c"))
    assert [r.c for r in n.collect()] == ["T3", "Fp1", "O1"]
    assert len(channels.pairs_of(channels.LONGITUDINAL)) == 18 and len(channels.pairs_of(channels.TRANSVERSE)) == 18
    s = spark.createDataFrame([("a", c, 0, [float(i), 2.0 * i]) for i, c in enumerate(channels.CANONICAL)], "recording_id string, channel string, block_idx int, samples array<double>")
    m = {r.derivation: r.samples for r in channels.apply_montage(s, channels.pairs_of(channels.LONGITUDINAL)).collect()}
    assert m["Fp1-F7"] == [-2.0, -4.0] and len(m) == 18
    car = {r.channel: r.samples for r in channels.common_average(s).collect()}
    assert car["C4"] == [1.0, 2.0] and car["Cz"] == [0.0, 0.0]
    ch = spark.createDataFrame([("a", "EEG F3-REF", 0), ("a", "EEG F7-REF", 1), ("b", "EEG F3-REF", 0)], "recording_id string, channel string, pos int")
    assert {r.recording_id for r in channels.select_channels(ch, ["F3", "F7"]).collect()} == {"a"}


def test_windows(spark):
    assert windows.window_grid(dur(spark, 11), 12, 6).count() == 0
    assert [r.start_s for r in windows.window_grid(dur(spark, 24), 12, 6).collect()] == [0, 6, 12]
    sig = spark.createDataFrame([("a", "C3", i, [float(x) for x in range(i * 10, i * 10 + 10)]) for i in range(3)], "recording_id string, channel string, block_idx int, samples array<double>")
    grid = spark.createDataFrame([("a", 0), ("a", 4), ("a", 8)], "recording_id string, start_s int")
    got = {r.start_s: r for r in windows.slice_windows(sig, grid, 4, 3, 10).collect()}
    assert got[4].samples == [float(x) for x in range(12, 24)] and got[4].skip_code == 0 and got[8].skip_code == 3
    iv = spark.createDataFrame([("a", 10.0, 20.0, "seiz", 100.0)], E + ", label string, duration_s double")
    assert [r.start_s for r in windows.tile_labelled_intervals(iv, 5, 1, 3).collect()] == [10, 11, 12, 13, 14]
    assert sorted(r.start_s for r in windows.pre_onset_windows(iv, 5).collect()) == [6, 7]


def test_files(spark, tmp_path):
    (tmp_path / "rec_a.csv_bi").write_text("# version = csv_v1.0.0\n# duration = 111.00 secs\n#\nchannel,start_time,stop_time,label,confidence\nTERM,31.9922,64.3341,seiz,1.0000\nTERM,64.3341,111.0000,bckg,1.0000\nTERM,1\n")
    (tmp_path / "rec_b.csv_bi").write_text("# duration = x secs\nTERM,5,4,seiz,1\n")
    a = files.read_annotations(spark, str(tmp_path))
    assert a.count() == 3 and files.reference_events(a).count() == 1
    assert {r.recording_id: r.duration_s for r in files.read_annotation_durations(spark, str(tmp_path)).collect()} == {"rec_a": 111.0, "rec_b": None}
    lines = files.annotation_lines(ev(spark, (1, 2)).withColumn("confidence", F.lit(0.5)), dur(spark, 9)).orderBy("k").collect()
    assert lines[-1].line == "TERM,1.0000,2.0000,seiz,0.5000" and len(lines) == 6
    assert files.list_recordings(spark, str(tmp_path), "*.csv_bi").count() == 2
    x = np.arange(-50, 50, dtype="<i2")
    field = lambda v, n: str(v).ljust(n).encode()
    head = b"".join([field("0", 8), field("", 80), field("", 80), field("", 8), field("", 8), field(512, 8), field("", 44), field(2, 8), field(1, 8), field(1, 4), field("EEG C3-REF", 16), field("", 80), field("uV", 8), field(-100, 8), field(100, 8), field(-50, 8), field(50, 8), field("", 80), field(50, 8), field("", 32)])
    (tmp_path / "r.edf").write_bytes(head.ljust(512) + x.tobytes())
    got = files.read_edf_signals(spark, str(tmp_path), 1).orderBy("block_idx").collect()
    assert [r.block_idx for r in got] == [0, 1] and got[0].samples[0] == -100.0 and got[0].fs == 50


def test_splits(spark):
    s = spark.createDataFrame([(i, i % 2, f"p{i % 8}") for i in range(64)], "id int, label int, patient_id string")
    out = comparison.grouped_split(s, "patient_id").collect()
    assert {r.part for r in out} == {"train", "val"} and sum(r.part == "val" for r in out) == 16
    one = comparison.grouped_split(s.where("patient_id = 'p0'"), "patient_id").collect()
    assert {r.part for r in one} == {"train"}
    k = spark.createDataFrame([("00009455_s003_t004_1_2_seiz.npy",)], "s string").select(comparison.patient_of(F.col("s")).alias("p"), comparison.session_key(F.col("s")).alias("k")).first()
    assert (k.p, k.k) == ("00009455", "00009455_s003_t004_seiz")
    a, b = ev(spark, (1, 2), (5, 9)), ev(spark, (1.02, 2.02), (5, 9), rec="z")
    assert [(r.rec_b, r.shared, r.exact) for r in comparison.boundary_fingerprint_match(a, b).collect()] == [("z", 2, 1)]


def exact_auc(p, y):
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    pos, neg = np.add.reduceat(y, starts), np.add.reduceat(1 - y, starts)
    return (neg * (np.cumsum(pos) - pos / 2)).sum() / pos.sum() / neg.sum(), (pos * np.cumsum(pos) / np.cumsum(pos + neg)).sum() / pos.sum()


def test_pooled_metrics_over_many_ranges(spark):
    """Sums over ranges equal numpy's, whatever the partitions of the table, and again when read again."""
    r = np.random.default_rng(8)
    y = (r.random(20_000) < 0.3).astype(int)
    p = np.round(r.normal(y * 0.8, 1), 3)
    pdf = pd.DataFrame({"prob": p, "label": y, "g": r.integers(0, 40, len(p))})
    auc, ap = exact_auc(p, y)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        for parts in (1, 7, 7):
            df = spark.createDataFrame(pdf).repartition(parts)
            assert metrics.roc_auc(df).first().auc == pytest.approx(auc, abs=1e-12)
            assert metrics.average_precision(df).first().ap == pytest.approx(ap, abs=1e-12)
            assert metrics.quantiles(df, F.col("prob"), [0, 0.013, 0.5, 1]) == pytest.approx(np.quantile(p, [0, 0.013, 0.5, 1]).tolist())
        curve = metrics.curve_points(df).toPandas().sort_values("threshold")
        assert curve.tpr.is_monotonic_decreasing and curve.tpr.max() == 1
        one = calibration.auc_draws(df.withColumn("g", F.lit("one")), "g", 5, 3).toPandas()  # drawn once in each draw
        assert np.allclose(one.auc, auc) and len(one) == 5
        order = {r.g: r["rank"] for r in resampling.ranked(df, "g", 3)[0].collect()}
        w = resampling.drawn(np.arange(40), 40, 0, 20, 3)
        names = sorted(order, key=order.get)
        got = calibration.auc_draws(df, "g", 20, 3).toPandas().sort_values("draw").auc
        for b in range(20):
            k = np.repeat(np.arange(len(p)), w[b][[names.index(g) for g in pdf.g]])
            assert got.iloc[b] == pytest.approx(exact_auc(p[k], y[k])[0])
        precision = calibration.precision_bootstrap(df, 0.5, "g", 300).first()
        assert precision.precision == pytest.approx(y[p >= 0.5].mean()) and precision.lo < precision.precision < precision.hi
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_matching_of_cached_events(spark):
    """The greedy matching is the same for events that are kept in memory, dealt by their key."""
    e = spark.createDataFrame([(k % 5, 0.5, float(k * 20), float(k * 20 + 8)) for k in range(40)], "recording_id long, threshold double, start_s double, stop_s double")
    e = e.groupBy("recording_id", "threshold", "start_s", "stop_s").count().drop("count").persist()
    refs = e.select("recording_id", "start_s", (F.col("stop_s") + 2).alias("stop_s"))
    keys = e.select("recording_id", "threshold").distinct()
    assert {r.kind: r["count"] for r in matching.match_events(e, refs, 5.0, keys).groupBy("kind").count().collect()} == {"match": 40}


def test_review_exports_and_refusals(spark):
    e = spark.createDataFrame([("a", 1.0, 4.0, "accepted", 0.5), ("a", 6.0, 99.0, "rejected", 0.5), ("b", 1.0, 2.0, "proposed", 0.1)], "recording_id string, start_s double, stop_s double, status string, prob double")
    d = spark.createDataFrame([("a", 50.0), ("b", 20.0)], "recording_id string, duration_s double")
    got = {r.recording_id: (r.exported, r.unassessed, r.empty_export) for r in comparison.export_summary(e, win(spark, [0, 6], [0.1, 0.2], [1, 0]), d).collect()}
    assert got == {"a": (1, 1, False), "b": (0, 0, True)}
    arms = [spark.createDataFrame(x, "recording_id string, stem string, sha256 string") for x in ([("1", "s", "x"), ("2", "s", "y"), ("3", "t", "z")], [("3", "t", "other"), ("4", "u", "v")])]
    assert {(r.recording_id, r.reason) for r in comparison.refusals(*arms).collect()} == {("1", "ambiguous"), ("2", "ambiguous"), ("3", "content")}
    assert [r.recording_id for r in matching.shortest_first(d, 1).collect()] == ["b"]
