"""Queries of readers and writers: each writes what Spark derives from the given tables and reads it back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigevents.config import DEFAULT as OP
from sigevents.operators import comparison, recording_scorer, windows
from sigevents.operators.fingerprint import content_fingerprint
from sigevents.plans.queries import query, r6
from sigevents.plans.signal_queries import SCORED_SQL, rms_scorer, scored_rows
from sigevents.sources import driver_tables as T
from sigevents.sources import edf, files
from sigevents.sources.recording_files import write_files
from sigevents.sources.scratch import scratch_path


def _annotation_folder(spark, d) -> str:
    path = scratch_path(spark, "annotations")
    e = T.references(spark, d).withColumn("confidence", (F.floor("start_s") % 10) / 10)
    files.write_annotations(e, T.recordings(spark, d).where("has_reference"), path)
    return path


@query(" SELECT CAST(recording_id AS VARCHAR) AS recording_id, 'TERM' AS channel, round(start_s, 4) AS start_s, round(stop_s, 4) AS stop_s, 'seiz' AS label, round((CAST(floor(start_s) AS INTEGER) % 10) / 10.0, 4) AS confidence FROM r")
def annotations_round_trip(spark, d):
    """write_annotations, read_annotations, reference_events."""
    return files.reference_events(files.read_annotations(spark, _annotation_folder(spark, d)))


@query(" SELECT CAST(recording_id AS VARCHAR) AS recording_id, round(duration_s, 2) AS duration_s FROM rec WHERE has_reference")
def annotation_durations(spark, d):
    return files.read_annotation_durations(spark, _annotation_folder(spark, d))


@query(" SELECT CAST(r.recording_id AS VARCHAR) AS recording_id, round(start_s, 3) AS start_s, round(CASE WHEN floor(start_s) % 4 = 0 THEN duration_s ELSE stop_s END, 3) AS stop_s, 'seiz' AS label, CAST(0.5 AS DOUBLE) AS confidence FROM r JOIN rec USING (recording_id)")
def interval_list(spark, d):
    """Intervals with open ends, read and resolved to the recordings' ends."""
    path = scratch_path(spark, "intervals")
    stop = F.when(F.floor("start_s") % 4 == 0, "END").otherwise(F.format_string("%.3f", "stop_s"))
    T.references(spark, d).select(F.concat_ws(" ", F.col("recording_id").cast("string"), F.format_string("%.3f", "start_s"), stop, F.lit("seiz"), F.lit("0.5")).alias("value")).write.text(path)
    rec = T.recordings(spark, d).select(F.col("recording_id").cast("string").alias("recording_id"), "duration_s")
    return windows.resolve_end(files.read_interval_list(spark, path), rec).select("recording_id", F.round("start_s", 3).alias("start_s"), F.round("stop_s", 3).alias("stop_s"), "label", "confidence")


@query(" SELECT 'p' || rec.recording_id AS stem, CASE WHEN NOT has_reference THEN 'unannotated' WHEN count(r.recording_id) > 0 THEN 'seizure' ELSE 'nonseizure' END AS cohort, CAST(has_reference AS INTEGER) AS has_reference, duration_s, CAST(count(r.recording_id) AS INTEGER) AS seiz_count, round(coalesce(sum(r.stop_s - r.start_s), 0), 4) AS seiz_total_s FROM rec LEFT JOIN r USING (recording_id) WHERE rec.recording_id % 5 <> 0 GROUP BY rec.recording_id, has_reference, duration_s")
def manifest_round_trip(spark, d):
    """Rows without a file are dropped when the manifest is read."""
    rec = T.recordings(spark, d).select("recording_id", "has_reference", F.lit(None).cast("double").alias("duration_s"))
    m = comparison.build_manifest(rec, T.references(spark, d), T.windows(spark, d), OP.seg)
    edf = F.when(F.col("recording_id") % 5 != 0, F.concat(F.lit("/e/"), F.col("recording_id").cast("string")))
    path = scratch_path(spark, "manifest")
    files.write_manifest(m.withColumns({"stem": F.concat(F.lit("p"), F.col("recording_id").cast("string")), "edf": edf, "has_reference": F.col("has_reference").cast("int")}), path)
    return files.read_manifest(spark, path).select("stem", "cohort", "has_reference", "duration_s", "seiz_count", F.round("seiz_total_s", 4).alias("seiz_total_s"))


@query(" SELECT recording_id, start_s, round(CAST(prob AS DOUBLE), 6) AS prob, CAST(CASE WHEN recording_id % 2 = 0 THEN skip_code WHEN prob = 0 THEN 1 ELSE 0 END AS INTEGER) AS skip_code, recording_id % 2 = 0 AS skip_code_is_exact FROM w WHERE recording_id NOT IN (SELECT recording_id FROM w WHERE prob IS NULL)")
def windows_round_trip(spark, d):
    """Score tables by arm; where skip codes were not kept they are made again, and recordings with a missing score are rejected."""
    path = scratch_path(spark, "windows")
    w = T.windows(spark, d).withColumns({"arm": F.lit("a"), "skip_code": F.when(F.col("recording_id") % 2 == 0, F.col("skip_code"))})
    files.write_windows(w, path)
    got = files.read_windows(spark, path)
    return r6(got.select("recording_id", "start_s", "prob", F.col("skip_code").cast("int").alias("skip_code"), "skip_code_is_exact"))


@query(" SELECT recording_id || ' ' || printf('%.4f', start_s) || ' ' || printf('%.4f', stop_s) || ' 0.5000 TERM' AS value FROM r")
def hypotheses_round_trip(spark, d):
    path = scratch_path(spark, "hypotheses")
    files.write_hypotheses(T.references(spark, d).withColumns({"confidence": F.lit(0.5), "channel": F.lit(None).cast("string")}), path)
    return spark.read.text(path)


@query(""", x AS (SELECT recording_id, count(*) AS n, max(start_s) AS last, count(*) FILTER (CAST(prob AS DOUBLE) >= 0.5) AS h1, count(*) FILTER (CAST(prob AS DOUBLE) >= 0.3) AS h2 FROM w GROUP BY 1)
SELECT 'recordings' AS part, CAST(recording_id AS DOUBLE) AS key, n, CAST(last AS BIGINT) AS value FROM x UNION ALL SELECT 'thresholds', 0.5, CAST(sum(n) AS BIGINT), CAST(sum(h1) AS BIGINT) FROM x UNION ALL SELECT 'thresholds', 0.3, CAST(sum(n) AS BIGINT), CAST(sum(h2) AS BIGINT) FROM x
UNION ALL SELECT 'metrics', CAST(max(last) AS DOUBLE), CAST(sum(n) AS BIGINT), count(*) FROM x""")
def report_round_trip(spark, d):
    """One nested document with pooled figures, a part for each threshold and one for each recording, read back and laid flat."""
    path = scratch_path(spark, "report")
    p = F.col("prob").cast("double")
    x = T.windows(spark, d).groupBy("recording_id").agg(F.count("*").alias("n"), F.max("start_s").alias("last"), F.count_if(p >= 0.5).alias("h1"), F.count_if(p >= 0.3).alias("h2"))
    pooled = x.agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.count("*").alias("recordings"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    sweep = pooled.select(F.explode(F.array(F.struct(F.lit(0.5).alias("threshold"), "n", F.col("h1").alias("hot")), F.struct(F.lit(0.3).alias("threshold"), "n", F.col("h2").alias("hot")))).alias("s")).select("s.*")
    files.write_report(pooled.select("last", "n", "recordings"), sweep, x.select("recording_id", "n", "last"), path)
    kind = "metrics struct<last: bigint, n: bigint, recordings: bigint>, thresholds array<struct<threshold: double, n: bigint, hot: bigint>>, recordings array<struct<recording_id: bigint, n: bigint, last: bigint>>"
    j = spark.read.schema(kind).json(f"{path}/report.json", multiLine=True)
    parts = [j.select(F.lit("metrics").alias("part"), F.col("metrics.last").cast("double").alias("key"), "metrics.n", F.col("metrics.recordings").alias("value"))]
    for name, key, value in (("thresholds", "threshold", "hot"), ("recordings", "recording_id", "last")):
        parts.append(j.select(F.explode(name).alias("x")).select(F.lit(name).alias("part"), F.col(f"x.{key}").cast("double").alias("key"), "x.n", F.col(f"x.{value}").alias("value")))
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", base=False)
def run_meta(spark, d):
    runs = T.read(spark, d, "events").select("event_id", F.col("props").alias("meta"))
    return files.parse_run_meta(runs, "k int").select("event_id", "meta.k")


@query(", u AS (SELECT recording_id, count(*) FILTER (skip_code <> 0) AS n FROM w GROUP BY 1) SELECT r.recording_id, count(*) AS n, CAST(count(*) FILTER (floor(start_s) % 3 > 0) AS INTEGER) AS n_exported, round(sum(start_s), 4) AS starts, any_value(u.n) AS windows_not_assessed, CAST(0.5 AS DOUBLE) AS threshold FROM r JOIN u USING (recording_id) GROUP BY 1")
def provenance(spark, d):
    """The JSON of each recording's decisions, read again."""
    status = F.when(F.floor("start_s") % 3 == 0, "rejected").when(F.floor("start_s") % 3 == 1, "accepted").otherwise("added")
    out = files.emit_provenance(T.references(spark, d).withColumns({"status": status, "prob": F.lit(0.5), "review_note": F.lit(None).cast("string")}), T.windows(spark, d))
    j = out.select("recording_id", F.from_json("json", "n_exported int, windows_not_assessed bigint, detector struct<threshold: double>, decisions array<struct<start_s: double>>").alias("j"))
    starts = F.aggregate("j.decisions", F.lit(0.0), lambda a, x: a + x["start_s"])
    return j.select("recording_id", F.size("j.decisions").cast("long").alias("n"), "j.n_exported", F.round(starts, 4).alias("starts"), "j.windows_not_assessed", "j.detector.threshold")


@query()
def recordings_and_content(spark, d):
    """list_recordings and content_fingerprint over the given tables' own files."""
    found = files.list_recordings(spark, d, "*.parquet")
    return found.join(content_fingerprint(spark, d, "*.parquet"), "path").select("recording_id", "size", "sha256")


def _edf(samples: np.ndarray) -> bytes:
    """An EDF file of signals (channel, time) of 16 samples a second: records of a second, a tenth of a unit for each step."""
    names = ("C3", "C4", "P3", "P4")[: len(samples)]
    seconds = samples.shape[1] // 16
    cells = [("0", 8), *[("", 80)] * 2, ("", 8), ("", 8), (str(256 * (len(names) + 1)), 8), ("", 44), (str(seconds), 8), ("1", 8), (str(len(names)), 4)]
    for per_signal in ([(n, 16) for n in names], *[[(text, width)] * len(names) for text, width in (("", 80), ("uV", 8), ("-3276.8", 8), ("3276.7", 8), ("-32768", 8), ("32767", 8), ("", 80), ("16", 8), ("", 32))]):
        cells += per_signal
    return "".join(text.ljust(n) for text, n in cells).encode() + samples.reshape(len(names), seconds, 16).swapaxes(0, 1).astype("<i2").tobytes()


@query("SELECT CAST(vec_id AS VARCHAR) AS recording_id, 'C3' AS channel, CAST(b AS INTEGER) AS block_idx, CAST(b * 2 AS DOUBLE) AS start_s, CAST(16 AS INTEGER) AS fs, CAST(list_sum([CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) for x in embedding[b * 32 + 1 : b * 32 + 32]]) AS BIGINT) AS total FROM embeddings, (SELECT unnest(range(0, 2)) AS b) WHERE embedding IS NOT NULL", base=False)
def edf_signals(spark, d):
    """Vectors written as EDF files in a column, decoded to blocks of two seconds."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"recording_id": pdf["vec_id"].astype(str), "content": [_edf(np.floor(np.asarray(x, float) * 1000)[None]) for x in pdf["samples"]]})

    raw = T.read(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    blocks = files.decode_signals(raw.mapInPandas(encode, "recording_id string, content binary"), 2)
    total = F.aggregate(F.transform("samples", lambda x: F.round(x.cast("double") * 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("recording_id", "channel", "block_idx", "start_s", "fs", total.alias("total"))


def _recording_files(spark, d, n: int, channels: int, scale) -> str:
    """EDF files of ``n`` vectors each: a vector is four seconds of a channel, channels take turns; whole numbers of ``scale`` units."""
    path = scratch_path(spark, "edf")
    c = (F.col("vec_id") % channels).cast("int").alias("c")
    rec = F.expr(f"vec_id div {n}")
    v = T.read(spark, d, "embeddings").where("embedding is not null").select(rec.alias("rec"), c, F.expr(f"vec_id % {n} div {channels}").alias("b"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale(rec % 4, c))).alias("x"))
    whole = v.groupBy("rec", "b").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("s")).where(F.size("s") == channels)
    whole = whole.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("b", "s"))).alias("blocks"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [_edf(np.concatenate([np.stack([s["x"] for s in b["s"]]) for b in blocks], 1)) for blocks in pdf["blocks"]]
            yield pd.DataFrame({"recording_id": pdf["rec"].astype(str), "content": content})

    write_files(whole.mapInPandas(encode, "recording_id string, content binary"), path, ".edf")
    return path


@query("""WITH e AS (SELECT vec_id // 64 AS r, vec_id % 64 AS b, embedding AS x FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT r, b * 64 + i AS i, CAST(floor(CAST(x[i + 1] AS DOUBLE) * 1000) AS BIGINT) AS v FROM e, (SELECT unnest(range(0, 64)) AS i))
SELECT CAST(r AS VARCHAR) AS recording_id, 'C3' AS channel, CAST(i // 80 AS INTEGER) AS block_idx, CAST(i // 80 * 5 AS DOUBLE) AS start_s, CAST(16 AS INTEGER) AS fs, CAST(count(*) AS INTEGER) AS n, CAST(sum(v * (i % 80 + 1)) AS BIGINT) AS total FROM s GROUP BY r, i // 80""", base=False)
def edf_ranges(spark, d):
    """EDF files of 64 vectors, read in ranges of 2,000 bytes, several a file, to blocks of five seconds."""
    blocks = files.read_edf_signals(spark, _recording_files(spark, d, 64, 1, lambda r, c: F.lit(1000.0)), 5, 2000)
    total = F.aggregate(F.transform("samples", lambda x, i: F.round(x.cast("double") * 10).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("recording_id", "channel", "block_idx", "start_s", "fs", F.size("samples").alias("n"), total.alias("total"))


@query("""WITH e AS (SELECT vec_id // 128 AS r, vec_id % 128 // 4 AS b, vec_id % 4 AS c, embedding AS x FROM embeddings WHERE embedding IS NOT NULL), full4 AS (SELECT r, b FROM e GROUP BY 1, 2 HAVING count(*) = 4),
s AS (SELECT CAST(r AS VARCHAR) AS recording_id, c, b * 64 + i AS i, CAST(CAST(CAST(floor(CAST(x[i + 1] AS DOUBLE) * CASE WHEN r % 4 = 1 THEN 5.0 WHEN r % 4 = 3 AND c > 0 THEN 100.0 WHEN r % 4 = 3 THEN 30000.0 ELSE 3000.0 END) AS BIGINT) * CAST(0.1 AS DOUBLE) AS FLOAT) AS DOUBLE) AS x FROM e JOIN full4 USING (r, b), (SELECT unnest(range(0, 64)) AS i))"""
    + SCORED_SQL, base=False)
def scored_ranges(spark, d):
    """EDF files of four channels, read in ranges with six seconds more, and scored in the same stage: no shuffle of samples."""
    path = _recording_files(spark, d, 128, 4, lambda r, c: F.when(r == 1, 5.0).when((r == 3) & (c > 0), 100.0).when(r == 3, 30000.0).otherwise(3000.0))
    blocks = edf.read_edf_ranges(spark, path, 4, 5000, ahead_s=6)
    return scored_rows(recording_scorer.score_recordings(blocks, ["C3", "C4", "P3", "P4"], rms_scorer, 6, 3, 16, layout="ranges"))
