"""Recordings read by ranges, scored in one stage, and written all or none."""

import io
import contextlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigevents.operators import features, recording_scorer, windows
from sigevents.sources import edf, files
from sigevents.sources.recording_files import write_files

NAMES = ["Fp1", "O1", "C3"]


def edf_file(signals, per_record, seconds=1, records=None, discontinuous=None, cut=0):
    """Bytes of an EDF file; ``signals``: name to whole numbers; ``discontinuous``: onsets of the records."""
    n_rec = len(next(iter(signals.values()))) // next(iter(per_record.values()))
    if discontinuous:
        signals = signals | {"EDF Annotations": None}
        per_record = per_record | {"EDF Annotations": 10}
    names = list(signals)
    cells = [("0", 8), ("", 80), ("", 80), ("", 8), ("", 8), (256 * (len(names) + 1), 8), ("EDF+D" if discontinuous else "", 44), (n_rec if records is None else records, 8), (seconds, 8), (len(names), 4)]
    for values, width in ((names, 16), ([""] * 9, 80), (["uV"] * 9, 8), ([-100] * 9, 8), ([100] * 9, 8), ([-1000] * 9, 8), ([1000] * 9, 8), ([""] * 9, 80), ([per_record[n] for n in names], 8), ([""] * 9, 32)):
        cells += [(v, width) for v, _ in zip(values, names)]
    body = b""
    for r in range(n_rec):
        for n in names:
            if signals[n] is None:
                body += f"+{discontinuous[r]}\x14\x14\x00".encode().ljust(20, b"\x00")
            else:
                body += np.asarray(signals[n][r * per_record[n] : (r + 1) * per_record[n]], "<i2").tobytes()
    head = "".join(str(v).ljust(w) for v, w in cells).encode()
    return head + body[: len(body) - cut]


def rows(df):
    return sorted((r.recording_id, r.channel, r.block_idx, r.start_s, r.fs, tuple(r.samples)) for r in df.collect())


@pytest.fixture
def signals():
    r = np.random.default_rng(1)
    return {"Fp1": r.integers(-900, 900, 480), "O1": r.integers(-900, 900, 480), "C3": r.integers(-900, 900, 240)}


def test_ranges_equal_the_whole_file(spark, tmp_path, signals):
    """Any cut of the files gives the rows of the decoder that reads them whole; records of two seconds, two rates."""
    per = {"Fp1": 20, "O1": 20, "C3": 10}
    made = {"a": edf_file(signals, per, 2), "b": edf_file({k: v[: len(v) // 2] for k, v in signals.items()}, per, 2, records=-1, cut=7)}
    for name, raw in made.items():
        (tmp_path / f"{name}.edf").write_bytes(raw)
    whole = spark.createDataFrame(list(made.items()), "recording_id string, content binary")
    for block_s in (2, 5, 60):
        want = rows(files.decode_signals(whole, block_s))
        for split in (64, 200, 700, 1 << 20):
            found = files.read_edf_signals(spark, str(tmp_path), block_s, split)
            assert rows(found) == want
            big = [len(raw) for raw in made.values() if len(raw) > split]
            assert found.rdd.getNumPartitions() == sum(-(-n // split) for n in big) + 1  # and one for small files, if there are any
    assert max(r[3] + len(r[5]) / r[4] for r in want if r[0] == "b") == 22  # the cut record is left out


def test_discontinuous_and_broken_files(spark, tmp_path, signals):
    onsets = [0, 1, 2, 10.5, 11.5, 40, 41]
    (tmp_path / "d.edf").write_bytes(edf_file({"Fp1": signals["Fp1"][:70]}, {"Fp1": 10}, 1, discontinuous=onsets))
    found = rows(files.read_edf_signals(spark, str(tmp_path), 60, 400))
    assert [(r[2], r[3]) for r in found] == list(enumerate(onsets)) and {r[1] for r in found} == {"Fp1"}
    assert files.read_edf_signals(spark, str(tmp_path / "d.edf"), 60).count() == 7
    (tmp_path / "none").mkdir()
    assert files.read_edf_signals(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "x.EDF").write_bytes(b"no header")
    with pytest.raises(Exception, match="no EDF header: .*x.EDF"):
        files.read_edf_signals(spark, str(tmp_path / "none")).collect()


scorer = lambda: lambda x: 1 - 1 / (1 + (x**2).mean((1, 2)) ** 0.5)  # noqa: E731 - so that it goes to the tasks as a value


def blocks_of(spark, data, block, fs, missing=()):
    """Signals table of recordings (name to channels x samples); ``missing``: (recording, channel, block) left out."""
    out = []
    for rec, x in data.items():
        for c, name in enumerate(NAMES):
            for k in range(-(-x.shape[1] // block)):
                if (rec, name, k) not in missing:
                    out.append((rec, name, k, k * block / fs, fs, x[c, k * block : (k + 1) * block].tolist()))
    np.random.default_rng(0).shuffle(out)
    return spark.createDataFrame([tuple([r[0], r[1], int(r[2]), float(r[3]), int(r[4]), list(map(float, r[5]))]) for r in out], "recording_id string, channel string, block_idx int, start_s double, fs int, samples array<float>")


def in_two_steps(signals, durations, seg, step, fs, block):
    """Scores by way of the table of windows."""
    grid = windows.window_grid(durations, seg, step)
    w = windows.slice_windows(signals, grid, seg, fs, block)
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("channel"))
    w = w.groupBy("recording_id", "start_s").agg(F.array_sort(F.collect_list(F.struct(place.alias("c"), "samples", "skip_code"))).alias("s"))
    whole = w.where((F.size("s") == len(NAMES)) & (F.size(F.filter("s", lambda x: x["skip_code"] > 0)) == 0)).withColumn("samples", F.transform("s", lambda x: x["samples"]))
    got = features.score_windows(whole.select("recording_id", "start_s", "samples"), scorer)
    return grid.join(got, ["recording_id", "start_s"], "left").fillna({"skip_code": 3, "prob": 0.0})


def scores(df):
    return sorted((r.recording_id, r.start_s, round(r.prob, 5), r.skip_code) for r in df.collect())


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_fused_scores_equal_two_steps(spark, batch):
    """Windows across the edges of blocks and of Arrow batches; blocks and channels missing; blocks longer and shorter than windows."""
    r = np.random.default_rng(2)
    fs, seg, step = 20, 4, 2
    data = {"a": r.normal(size=(3, 431)) * 40, "b": r.normal(size=(3, 90)) * 40, "c": r.normal(size=(3, 79)) * 40, "d": np.concatenate([r.normal(size=(3, 200)) * 40, np.zeros((3, 100)), r.normal(size=(3, 200)) * 1e5], 1)}
    durations = spark.createDataFrame([(k, x.shape[1] / fs) for k, x in data.items()], "recording_id string, duration_s double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for block in (27, 60, 200):
            missing = {("a", "O1", 2), ("b", "C3", 0)} if block == 27 else set()
            table = blocks_of(spark, data, block, fs, missing)
            fused = recording_scorer.score_recordings(table.union(table.where("channel = 'C3'").withColumn("channel", F.lit("ECG"))), NAMES, scorer, seg, step, fs, stack=3)
            want = scores(in_two_steps(table, durations, seg, step, fs, block))
            assert scores(fused) == want and {1, 0} <= {x[3] for x in want} and (not missing or 3 in {x[3] for x in want})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ranges_are_scored_where_they_are_read(spark, tmp_path, signals):
    """Files in ranges that hold what windows need beyond them: the scores of the whole table, and no exchange at all."""
    per = {"Fp1": 10, "O1": 10, "C3": 10}
    same = signals | {"C3": np.random.default_rng(3).integers(-900, 900, 480)}
    (tmp_path / "a.edf").write_bytes(edf_file(same, per))
    (tmp_path / "b.edf").write_bytes(edf_file({k: v[:250] for k, v in same.items()}, per))
    whole = files.read_edf_signals(spark, str(tmp_path), 3)
    for split in (150, 500, 1 << 20):
        ranges = edf.read_edf_ranges(spark, str(tmp_path), 3, split, ahead_s=5)
        fused = recording_scorer.score_recordings(ranges, NAMES, scorer, 5, 2, 10, layout="ranges")
        assert "Exchange" not in plan_of(fused)
        assert scores(fused) == scores(recording_scorer.score_recordings(whole, NAMES, scorer, 5, 2, 10)) and fused.count() == 22 + 11


def test_many_small_ranges_are_read_several_by_a_task(spark, tmp_path, signals):
    """Tasks grow with the bytes, not with the number of ranges, and rows of blocks come in large batches; the rows are the same."""
    for i in range(12):
        (tmp_path / f"r{i}.edf").write_bytes(edf_file(signals, {"Fp1": 20, "O1": 20, "C3": 10}, 2))
    reader = edf.EdfReader({"path": str(tmp_path), "block_s": 2, "split_bytes": 64, "ahead_s": 3})
    parts = reader.partitions()
    ranges = [x for p in parts for x in p.parts]
    assert len(ranges) > 600 and len(set(ranges)) == len(ranges) and len(parts) < 200
    assert all(len(list(reader.read(p))) <= 1 for p in parts)
    few = edf.read_edf_ranges(spark, str(tmp_path), 2, 64, ahead_s=3)
    assert rows(few.where("not ahead").drop("ahead")) == rows(files.read_edf_signals(spark, str(tmp_path), 2))
    fused = recording_scorer.score_recordings(edf.read_edf_ranges(spark, str(tmp_path), 3, 64, ahead_s=5).where("channel <> 'C3'"), ["Fp1", "O1"], scorer, 5, 2, 10, layout="ranges")
    whole = files.read_edf_signals(spark, str(tmp_path), 3).where("channel <> 'C3'")
    assert scores(fused) == scores(recording_scorer.score_recordings(whole, ["Fp1", "O1"], scorer, 5, 2, 10))


def test_bucketed_signals_are_not_shuffled(spark, tmp_path):
    data = {f"r{i}": np.random.default_rng(i).normal(size=(3, 300)) * 30 for i in range(5)}
    table = blocks_of(spark, data, 50, 10)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rec LOCATION '{tmp_path}/rec'")
    try:
        recording_scorer.write_signals(table, "rec.signals", 3)
        fused = recording_scorer.score_recordings(spark.table("rec.signals"), NAMES, scorer, 5, 5, 10, layout="bucketed")
        assert "Exchange" not in plan_of(fused)
        assert scores(fused) == scores(recording_scorer.score_recordings(table, NAMES, scorer, 5, 5, 10)) and fused.count() == 30
    finally:
        spark.sql("DROP DATABASE rec CASCADE")


def test_transform_and_cleaner(spark):
    """The scorer gets spectrograms, and windows that the cleaner gives back; wrong rates are errors."""
    table = blocks_of(spark, {"a": np.random.default_rng(5).normal(size=(3, 500)) * 30}, 100, 50)
    shapes = recording_scorer.score_recordings(table, NAMES, lambda: lambda x: np.full(len(x), x.shape[1] * x.shape[2] * x.shape[3] / 1e4), 2, 2, 50, transform=lambda x: features.log_spectrogram(x, 50), make_cleaner=lambda: lambda w: w if w[0, 0] > 0 else None)
    got = scores(shapes)
    assert {x[2:] for x in got} == {(round(3 * 3 * 25 / 1e4, 5), 0), (0.0, 2)} and len(got) == 5
    with pytest.raises(Exception, match="50 samples a second, not 250"):
        recording_scorer.score_recordings(table, NAMES, scorer).collect()


def test_files_are_written_all_or_none(spark, tmp_path):
    lines = spark.createDataFrame([(f"r{i % 7}", f"{i:03}") for i in range(200)], "recording_id string, line string").repartition("recording_id").sortWithinPartitions("recording_id", "line")
    write_files(lines, str(tmp_path / "ok"), ".txt")
    assert sorted(os.listdir(tmp_path / "ok")) == ["_SUCCESS", *(f"r{i}.txt" for i in range(7))]
    assert (tmp_path / "ok" / "r3.txt").read_text().split() == [f"{i:03}" for i in range(200) if i % 7 == 3]

    def breaks(batches):
        for b in batches:
            yield b.slice(0, 1)
            if "r5" in b.column(0).to_pylist():
                raise ValueError("this task fails")
            yield b.slice(1)

    with pytest.raises(Exception, match="this task fails"):
        write_files(lines.mapInArrow(breaks, lines.schema), str(tmp_path / "failed"), ".txt")
    left = [f for _, _, names in os.walk(tmp_path / "failed") for f in names]
    assert left == []
    for bad in (lines.withColumn("recording_id", F.lit("a/b")), lines.repartition(3)):
        with pytest.raises(Exception, match="no name of one|two partitions"):
            write_files(bad, str(tmp_path / "bad"), ".txt")
    assert [f for _, _, names in os.walk(tmp_path / "bad") for f in names] == []
