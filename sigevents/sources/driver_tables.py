"""The driver's event stream re-read as a detector's output.

A user is a recording; events in time are windows of 12 s at stride 6; the value is the score;
errors are skipped windows; some purchases carry reference intervals. A second arm has shifted scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered by recording; the tables below are columns and rows of it, read and shuffled for what a query needs of it."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("recording_id"), ((n - 1) * 6).cast("int").alias("start_s"), F.least(F.col("value") / 100, F.lit(1.0)).cast("float").alias("prob"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("skip_code"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("recording_id", "start_s", "prob", "skip_code")


def second_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("recording_id", "start_s", (F.col("prob").cast("double") * 0.9 + 0.05).cast("float").alias("prob"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("skip_code"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("start_s") + F.col("k") / 10.0
    return base(spark, sf_dir).where("event_type = 'purchase' and k >= 85 and recording_id % 7 <> 0").select("recording_id", a.alias("start_s"), (a + 10 + F.col("k") / 2.0).alias("stop_s"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, patient_id, duration_s, has_reference, cohort of annotated recordings and others."""
    d = base(spark, sf_dir).groupBy("recording_id").agg((F.max("start_s") + 12).cast("double").alias("duration_s"), F.bool_or((F.col("event_type") == "purchase") & (F.col("k") >= 85)).alias("_ref"))
    has = F.col("recording_id") % 7 != 0
    return d.select("recording_id", (F.col("recording_id") % 20).alias("patient_id"), "duration_s", has.alias("has_reference"), F.when(~has, "unannotated").when(F.col("_ref"), "seizure").otherwise("nonseizure").alias("cohort"))


#: The same tables as common table expressions: b, w, w2, r (references), rec.
SQL = """
b AS (SELECT user_id AS recording_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 6 AS INTEGER) AS start_s,
  CAST(least(value / 100, 1.0) AS FLOAT) AS prob, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS skip_code, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
w AS (SELECT recording_id, start_s, prob, skip_code FROM b),
w2 AS (SELECT recording_id, start_s, CAST(CAST(prob AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS FLOAT) AS prob, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS skip_code FROM b),
r AS (SELECT recording_id, start_s + k / CAST(10 AS DOUBLE) AS start_s, start_s + k / CAST(10 AS DOUBLE) + 10 + k / CAST(2 AS DOUBLE) AS stop_s FROM b WHERE event_type = 'purchase' AND k >= 85 AND recording_id % 7 <> 0),
rec AS (SELECT recording_id, recording_id % 20 AS patient_id, CAST(max(start_s) + 12 AS DOUBLE) AS duration_s, recording_id % 7 <> 0 AS has_reference,
  CASE WHEN recording_id % 7 = 0 THEN 'unannotated' WHEN bool_or(event_type = 'purchase' AND k >= 85) THEN 'seizure' ELSE 'nonseizure' END AS cohort FROM b GROUP BY recording_id)
"""
