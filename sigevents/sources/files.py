"""Readers and writers of annotations, intervals, manifests, score tables and recordings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigevents.config import DEFAULT, OperatingPoint
from sigevents.sources import edf
from sigevents.sources.recording_files import write_files


def _stem(path: Column) -> Column:
    """The recording of a file: of the folder that ``write_annotations`` makes for it, else the file's name without ending."""
    folder = F.regexp_extract(path, r"/recording_id=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    return t.select(_stem(F.col("_metadata.file_path")).alias("recording_id"), F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of five fields; blank lines, comments, the heading and short lines are skipped."""
    x = _lines(spark, path).where("line <> '' and not startswith(line, '#') and not startswith(lower(line), 'channel')").withColumn("f", F.split("line", ",")).where(F.size("f") >= 5)
    num = lambda i: F.trim(F.get("f", F.lit(i))).try_cast("double")
    return x.select("recording_id", F.trim(F.get("f", F.lit(0))).alias("channel"), num(1).alias("start_s"), num(2).alias("stop_s"), F.trim(F.get("f", F.lit(3))).alias("label"), num(4).alias("confidence"))


def read_annotation_durations(spark: SparkSession, path: str) -> DataFrame:
    """The first `# duration = X secs` line of each file; null if malformed or absent."""
    x = _lines(spark, path)
    d = F.regexp_extract("line", r"(?i)^#\s*duration\s*=\s*(\S+)", 1).try_cast("double")
    is_d = F.col("line").rlike(r"(?i)^#\s*duration\s*=")
    return x.groupBy("recording_id").agg(F.min_by(F.when(is_d, d), F.when(is_d, F.struct("at", "n"))).alias("duration_s"))


def reference_events(annotations: DataFrame) -> DataFrame:
    return annotations.where("label = 'seiz' and stop_s > start_s").orderBy("recording_id", "start_s", "stop_s")


def read_interval_list(spark: SparkSession, path: str) -> DataFrame:
    """`file start stop label confidence`; a stop of END is null (see windows.resolve_end)."""
    x = spark.read.csv(path, sep=" ", schema="recording_id string, start_s double, stop string, label string, confidence double")
    return x.withColumn("stop_s", F.col("stop").try_cast("double")).where("stop_s is not null or stop = 'END'").select("recording_id", "start_s", "stop_s", "label", "confidence")


MANIFEST = "stem string, cohort string, has_reference int, duration_s double, seiz_count int, seiz_total_s double, cached int, edf string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST).where("edf is not null and edf <> ''")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.csv(path, header=True)


def validate_windows(windows: DataFrame) -> DataFrame:
    """Recordings whose starts decrease (in the order of ``pos``) or that hold a non-finite score are rejected whole;
    a missing skip code is 1 where the score is 0, and ``skip_code_is_exact`` tells."""
    w = Window.partitionBy("recording_id")
    back = F.coalesce(F.col("start_s") < F.lag("start_s").over(w.orderBy("pos")), F.lit(False)) if "pos" in windows.columns else F.lit(False)
    bad = back | F.isnan("prob") | F.col("prob").isNull() | (F.abs(F.col("prob").cast("double")) == float("inf"))
    x = windows.withColumn("_b", bad).withColumn("_bad", F.bool_or("_b").over(w)).where("not _bad").drop("_b", "_bad")
    return x.withColumn("skip_code_is_exact", F.col("skip_code").isNotNull()).withColumn("skip_code", F.coalesce("skip_code", F.when(F.col("prob") == 0, 1).otherwise(0)).cast("byte"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return validate_windows(spark.read.parquet(path))


def write_windows(windows: DataFrame, path: str) -> None:
    windows.repartition("arm").write.partitionBy("arm").parquet(path)


def list_recordings(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder: id, path, size, time of change; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return f.select(_stem(F.col("path")).alias("recording_id"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def decode_edf(content: bytes) -> list[tuple[str, int, np.ndarray]]:
    """Label, rate and physical samples of each signal of a whole EDF file."""
    h = edf.parse_header(content, len(content))
    samples = edf.decode_records(content[h.bytes : h.bytes + h.records * h.record_bytes], h)
    return [(h.labels[i], h.rate(i), x) for i, x in enumerate(samples)]


def read_edf_signals(spark: SparkSession, root: str, block_s: int = 60, split_bytes: int = 32 << 20) -> DataFrame:
    """Blocks of ``block_s`` seconds of each channel of the EDF files below a folder; a file is read by ranges (edf.py)."""
    return edf.read_edf_ranges(spark, root, block_s, split_bytes).drop("ahead")


def decode_signals(files: DataFrame, block_s: int = 60) -> DataFrame:
    """The same rows for a table of recording_id and a file's whole content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, content in zip(pdf["recording_id"], pdf["content"], strict=True):
                for label, fs, x in decode_edf(content):
                    if "annotation" in label.lower():
                        continue
                    step = fs * block_s
                    rows = [(rec, label, i // step, i / fs, fs, x[i : i + step].astype(np.float32).tolist()) for i in range(0, len(x), step)]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in edf.SIGNALS.split(", ")])

    return files.mapInPandas(run, edf.SIGNALS)


def annotation_lines(events: DataFrame, recordings: DataFrame) -> DataFrame:
    """Lines of annotation files in order: heading, then sorted rows."""
    head = recordings.select("recording_id", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), t.alias("line")) for i, t in enumerate([F.lit("# version = csv_v1.0.0"), F.concat(F.lit("# bname = "), F.col("recording_id").cast("string")), F.format_string("# duration = %.2f secs", F.col("duration_s")), F.lit("#"), F.lit("channel,start_time,stop_time,label,confidence")])])).alias("x")).select("recording_id", "x.k", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "x.line")
    body = events.select("recording_id", F.lit(9).alias("k"), F.col("start_s").alias("a"), F.col("stop_s").alias("b"), F.format_string("TERM,%.4f,%.4f,seiz,%.4f", "start_s", "stop_s", F.coalesce(F.col("confidence"), F.lit(1.0))).alias("line"))
    return head.unionByName(body)


def write_annotations(events: DataFrame, recordings: DataFrame, path: str) -> None:
    """One annotation file a recording, below one folder, all or none (recording_files.py)."""
    lines = annotation_lines(events, recordings).repartition("recording_id").sortWithinPartitions("recording_id", "k", "a", "b")
    write_files(lines.select(F.col("recording_id").cast("string").alias("recording_id"), "line"), path, ".csv")


def hypothesis_lines(events: DataFrame) -> DataFrame:
    """`file start stop confidence channel` of positive runs."""
    return events.select(F.format_string("%s %.4f %.4f %.4f %s", F.col("recording_id").cast("string"), "start_s", "stop_s", "confidence", F.coalesce(F.col("channel"), F.lit("TERM"))).alias("value"))


def write_hypotheses(events: DataFrame, path: str) -> None:
    hypothesis_lines(events).write.text(path)


def report_lines(metrics: DataFrame, sweep: DataFrame, per_recording: DataFrame) -> DataFrame:
    """recording_id (``report``), line of one JSON document: {"metrics": {...}, "thresholds": [...], "recordings": [...]}.

    ``metrics``: one row. The rows of the others are in order of their first two columns, a line each, so
    that the document streams through one task, however many recordings it has.
    """
    parts = [metrics.select(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.concat(F.lit('{"metrics": '), F.to_json(F.struct("*"))).alias("line"))]
    for k, (name, t) in enumerate((("thresholds", sweep), ("recordings", per_recording)), 1):
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in zip(t.columns, ("a", "b"))]
        keys += [F.lit("").alias("b")] * (len(t.columns) == 1)
        rows = t.select(F.lit(2 * k).alias("part"), *keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
        first = rows.agg(F.min(F.struct("a", "b", "line")).alias("_first"))
        rows = rows.join(F.broadcast(first)).withColumn("line", F.when(F.struct("a", "b", "line") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), "line"))).drop("_first")  # one row
        parts += [metrics.select(F.lit(2 * k - 1).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(f', "{name}": [' if k == 1 else f'], "{name}": [').alias("line")), rows]
    parts.append(metrics.select(F.lit(5).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("]}").alias("line")))
    whole = reduce(lambda x, y: x.unionByName(y), parts)
    return whole.repartition(1).sortWithinPartitions("part", "a", "b", "line").select(F.lit("report").alias("recording_id"), "line")


def write_report(metrics: DataFrame, sweep: DataFrame, per_recording: DataFrame, path: str) -> None:
    """The nested report as ``report.json`` in a folder."""
    write_files(report_lines(metrics, sweep, per_recording), path, ".json")


def parse_run_meta(runs: DataFrame, schema: str) -> DataFrame:
    return runs.withColumn("meta", F.from_json("meta", schema))


def emit_provenance(events: DataFrame, windows: DataFrame, op: OperatingPoint = DEFAULT) -> DataFrame:
    """One JSON text per recording: what was decided on each event, what is exported, what was never assessed, and the operating point.

    ``events``: recording_id, start_s, stop_s, status, prob, review_note.
    """
    decision = F.struct(F.round("start_s", 4).alias("start_s"), F.round("stop_s", 4).alias("stop_s"), "status", F.round("prob", 6).alias("score"), "review_note")
    e = events.groupBy("recording_id").agg(F.array_sort(F.collect_list(decision)).alias("decisions"))
    w = windows.groupBy("recording_id").agg(F.count("*").alias("n_windows"), F.count_if(F.coalesce(F.col("skip_code"), F.lit(0)) != 0).alias("windows_not_assessed"))
    exported = F.filter("decisions", lambda x: x["status"].isin("accepted", "edited", "added"))
    detector = F.struct(F.lit(op.seg).alias("segment_s"), F.lit(op.step).alias("step_s"), F.lit(op.fs).alias("fs"), F.lit(op.threshold).alias("threshold"))
    text = F.struct("recording_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("exported_utc"), detector.alias("detector"), F.size(exported).alias("n_exported"), exported.alias("exported"), "decisions", "n_windows", "windows_not_assessed", F.lit(False).alias("scores_are_calibrated"))
    return e.join(w, "recording_id", "left").fillna(0, ["n_windows", "windows_not_assessed"]).select("recording_id", F.to_json(text).alias("json"))
