"""Queries over signals: the embeddings table re-read as blocks of samples of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigevents.operators import channels, features, recording_scorer, windows
from sigevents.plans.queries import query, r6
from sigevents.sources import driver_tables as T

RAW = ("EEG T7-REF", "EEG T8-LE", "P7", "eeg P8-REF", "Fp1", "EEG F3-REF", "Cz-LE", "O1")
CANONICAL = "[" + ", ".join(f"'{c}'" for c in channels.CANONICAL) + "]"


def checksum(samples: str | Column) -> Column:
    """Samples weighted by their place, summed in order."""
    return F.aggregate(F.transform(samples, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _vectors(spark, d) -> DataFrame:
    return T.read(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def _montage(spark, d) -> DataFrame:
    """Nineteen channels a recording, one block."""
    name = F.element_at(F.array(*map(F.lit, channels.CANONICAL)), (F.col("vec_id") % 19 + 1).cast("int"))
    return _vectors(spark, d).select(F.expr("vec_id div 19").alias("recording_id"), name.alias("channel"), F.lit(0).alias("block_idx"), (F.col("vec_id") % 19).cast("int").alias("pos"), "samples")


def _scaled(spark, d) -> DataFrame:
    """Windows of four channels whose scale makes some of them sound, flat, wild or uneven."""
    e = _vectors(spark, d).withColumns({"recording_id": F.expr("vec_id div 4"), "c": F.col("vec_id") % 4})
    r = F.col("recording_id") % 4
    by = F.when(r == 1, 1.0).when(r == 2, 1e6).when((r == 3) & (F.col("c") == 0), 1e5).otherwise(100.0)
    return e.withColumn("samples", F.transform("samples", lambda v: v * by)).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("c", "samples"))).alias("s")).select("recording_id", F.lit(0).alias("start_s"), F.transform("s", lambda x: x["samples"]).alias("samples"))


SCALED = """WITH e AS (SELECT vec_id // 4 AS recording_id, vec_id % 4 AS c, [CAST(x AS DOUBLE) * CASE WHEN (vec_id // 4) % 4 = 1 THEN 1.0 WHEN (vec_id // 4) % 4 = 2 THEN 1e6 WHEN (vec_id // 4) % 4 = 3 AND vec_id % 4 = 0 THEN 1e5 ELSE 100.0 END for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT recording_id, list_max([abs(v) for v in x]) AS peak, [list_aggregate(x[6 * i + 1 : 6 * i + 6], 'stddev_pop') for i in range(0, 10)] AS sp, list_sum([v * v for v in x]) AS sq FROM e),
q AS (SELECT recording_id, min(peak) AS lo, max(peak) AS hi, min(list_min(sp)) AS s0, max(list_max(sp)) AS s1, sum(sq) AS sq, count(*) AS n FROM p GROUP BY recording_id),
f AS (SELECT *, CAST(CASE WHEN lo <= 0 OR hi > 50 * lo THEN 1 WHEN s0 < 1 THEN 2 WHEN s1 > 5000 THEN 3 ELSE 0 END AS INTEGER) AS reason FROM q)
"""


@query(SCALED + "SELECT recording_id, reason FROM f", base=False)
def interrupted_flag(spark, d):
    return features.interrupted_flag(_scaled(spark, d).drop("start_s"))


@query(SCALED + "SELECT recording_id, 0 AS start_s, CASE WHEN reason = 0 THEN round(CAST(CAST(1 - 1 / (1 + sqrt(sq / (n * 64))) AS FLOAT) AS DOUBLE), 5) ELSE 0.0 END AS prob, CAST(CASE WHEN reason = 0 THEN 0 ELSE 1 END AS INTEGER) AS skip_code FROM f", base=False)
def score_windows(spark, d):
    """Scores of sound windows; interrupted ones are skipped."""
    out = features.score_windows(_scaled(spark, d), rms_scorer)
    return out.select("recording_id", "start_s", F.round(F.col("prob").cast("double"), 5).alias("prob"), F.col("skip_code").cast("int").alias("skip_code"))


def rms_scorer():
    return lambda x: 1 - 1 / (1 + (x**2).mean((1, 2)) ** 0.5)


#: Scores of windows of six seconds at stride three out of samples s (recording_id, c, i, x) of four channels at 16 Hz.
SCORED_SQL = """, w AS (SELECT recording_id, unnest(range(0, n // 16 - 5, 3)) AS t FROM (SELECT recording_id, max(i) + 1 AS n FROM s GROUP BY 1)),
v AS (SELECT w.recording_id, t, c, i - 16 * t AS j, x FROM w JOIN s ON s.recording_id = w.recording_id AND i >= 16 * t AND i < 16 * t + 96),
p AS (SELECT recording_id, t, c, count(*) AS n, max(abs(x)) AS peak, sum(x * x) AS sq FROM v GROUP BY ALL), k AS (SELECT recording_id, t, c, j // 9 AS k, stddev_pop(x) AS sp FROM v WHERE j < 90 GROUP BY ALL),
q AS (SELECT recording_id, t, count(*) = 4 AND min(n) = 96 AS whole, min(peak) AS lo, max(peak) AS hi, sum(sq) AS sq FROM p GROUP BY ALL), g AS (SELECT recording_id, t, min(sp) AS s0, max(sp) AS s1 FROM k GROUP BY ALL),
f AS (SELECT w.recording_id, w.t, sq, CASE WHEN NOT coalesce(whole, false) THEN 3 WHEN lo <= 0 OR hi > 50 * lo OR s0 < 1 OR s1 > 5000 THEN 1 ELSE 0 END AS skip_code FROM w LEFT JOIN q USING (recording_id, t) LEFT JOIN g USING (recording_id, t))
SELECT recording_id, CAST(t AS INTEGER) AS start_s, CASE WHEN skip_code = 0 THEN round(1 - 1 / (1 + sqrt(sq / 384)), 4) ELSE 0.0 END AS prob, CAST(skip_code AS INTEGER) AS skip_code FROM f"""


def scored_rows(out: DataFrame) -> DataFrame:
    return out.select("recording_id", "start_s", F.round(F.col("prob").cast("double"), 4).alias("prob"), F.col("skip_code").cast("int").alias("skip_code"))


@query("""WITH s AS (SELECT vec_id // 32 AS recording_id, vec_id % 4 AS c, vec_id % 32 // 4 * 64 + i AS i, CAST(CAST(CAST(embedding[i + 1] AS DOUBLE) * CASE WHEN vec_id // 32 % 4 = 1 THEN 1.0 WHEN vec_id // 32 % 4 = 2 AND vec_id % 32 < 16 THEN 1e6 WHEN vec_id // 32 % 4 = 3 AND vec_id % 4 = 0 THEN 1e5 ELSE 100.0 END AS FLOAT) AS DOUBLE) AS x
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) WHERE embedding IS NOT NULL AND vec_id % 29 <> 7)""" + SCORED_SQL, base=False)
def scored_recordings(spark, d):
    """Blocks of four channels to scores in one stage; some blocks lack a channel, whose name is another one there."""
    r, c = F.expr("vec_id div 32 % 4"), F.col("vec_id") % 4
    by = F.when(r == 1, 1.0).when((r == 2) & (F.col("vec_id") % 32 < 16), 1e6).when((r == 3) & (c == 0), 1e5).otherwise(100.0)
    name = F.when(F.col("vec_id") % 29 == 7, "ECG").otherwise(F.element_at(F.array(*map(F.lit, ("C3", "C4", "P3", "P4"))), (c + 1).cast("int")))
    block = F.expr("vec_id % 32 div 4").cast("int")
    signals = _vectors(spark, d).select(F.expr("vec_id div 32").alias("recording_id"), name.alias("channel"), block.alias("block_idx"), (block * 4.0).alias("start_s"), F.lit(16).alias("fs"), F.transform("samples", lambda v: v * by).alias("samples"))
    return scored_rows(recording_scorer.score_recordings(signals, ["C3", "C4", "P3", "P4"], rms_scorer, 6, 3, 16))


@query("SELECT vec_id, ['T3', 'T4', 'T5', 'T6', 'Fp1', 'F3', 'Cz', 'O1'][vec_id % 8 + 1] AS channel FROM embeddings", base=False)
def normalise_channel(spark, d):
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("vec_id") % 8 + 1).cast("int"))
    return T.read(spark, d, "embeddings").select("vec_id", channels.normalise_channel(raw).alias("channel"))


@query(f"""WITH c AS (SELECT vec_id // 8 AS recording_id, CASE WHEN vec_id % 37 = 6 THEN 'ECG' ELSE {list(RAW)!r}[vec_id % 8 + 1] END AS channel, CAST(vec_id % 8 AS INTEGER) AS pos FROM embeddings),
h AS (SELECT recording_id, wanted, channel, pos, row_number() OVER (PARTITION BY recording_id, wanted ORDER BY pos) AS n FROM c, (SELECT unnest(['t7', 'P', 'Cz']) AS wanted) WHERE contains(upper(channel), upper(wanted))),
g AS (SELECT recording_id FROM h WHERE n = 1 GROUP BY recording_id HAVING count(*) = 3) SELECT recording_id, wanted, channel, pos FROM h JOIN g USING (recording_id) WHERE n = 1""", base=False)
def select_channels(spark, d):
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("vec_id") % 8 + 1).cast("int"))
    raw = F.when(F.col("vec_id") % 37 == 6, "ECG").otherwise(raw)
    c = T.read(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("recording_id"), raw.alias("channel"), (F.col("vec_id") % 8).cast("int").alias("pos"))
    return channels.select_channels(c, ["t7", "P", "Cz"]).select("recording_id", "wanted", "channel", "pos")


def _montage_sql(pairs: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    return f"""WITH e AS (SELECT vec_id // 19 AS recording_id, {CANONICAL}[vec_id % 19 + 1] AS channel, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL), m(pos, a, b) AS (VALUES {rows})
SELECT p.recording_id, CAST(pos AS INTEGER) AS pos, a || '-' || b AS derivation, round(list_sum([(p.x[i] - q.x[i]) * i for i in range(1, 65)]), 6) AS checksum FROM m JOIN e p ON p.channel = a JOIN e q ON q.channel = b AND q.recording_id = p.recording_id"""


def _montage_query(spark, d, montage):
    m = channels.apply_montage(_montage(spark, d), channels.pairs_of(montage))
    return r6(m.select("recording_id", "pos", "derivation", checksum("samples").alias("checksum")))


@query(_montage_sql(channels.pairs_of(channels.LONGITUDINAL)), base=False)
def longitudinal_montage(spark, d):
    return _montage_query(spark, d, channels.LONGITUDINAL)


@query(_montage_sql(channels.pairs_of(channels.TRANSVERSE)), base=False)
def transverse_montage(spark, d):
    return _montage_query(spark, d, channels.TRANSVERSE)


@query(f"""WITH e AS (SELECT vec_id // 19 AS recording_id, {CANONICAL}[vec_id % 19 + 1] AS channel, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT recording_id, i, avg(v) AS m FROM (SELECT recording_id, unnest(x) AS v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL)
SELECT e.recording_id, channel, round(sum((e.x[i] - m) * i), 5) AS checksum FROM e JOIN m USING (recording_id) GROUP BY ALL""", base=False)
def common_average(spark, d):
    return channels.common_average(_montage(spark, d)).select("recording_id", "channel", F.round(checksum("samples"), 5).alias("checksum"))


@query("""WITH e AS (SELECT vec_id // 19 AS recording_id, vec_id % 19 AS c, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL), g AS (SELECT recording_id FROM e GROUP BY 1 HAVING count(*) = 19)
SELECT a.recording_id, round(list_sum([(a.x[i] - b.x[i]) * i for i in range(1, 65)]), 6) AS f3_f7, round(list_sum([(p.x[i] - o.x[i]) * i for i in range(1, 65)]), 6) AS p3_o1 FROM g JOIN e a USING (recording_id) JOIN e b USING (recording_id) JOIN e p USING (recording_id) JOIN e o USING (recording_id) WHERE a.c = 3 AND b.c = 2 AND p.c = 13 AND o.c = 17""", base=False)
def two_channel_derivation(spark, d):
    w = _montage(spark, d).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("pos", "samples"))).alias("s")).where(F.size("s") == 19)
    two = w.select("recording_id", channels.two_channel_derivation(F.transform("s", lambda x: x["samples"])).alias("x"))
    return r6(two.select("recording_id", checksum(F.get("x", F.lit(0))).alias("f3_f7"), checksum(F.get("x", F.lit(1))).alias("p3_o1")))


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, j, sum(x[i + 1] * (1 + 2 * list_sum([cos(2 * pi() * k * (j / 32.0 - i / 64.0)) for k in range(1, 16)]) + 2 * cos(pi() * i / 2.0) * (1 - 2 * (j % 2)))) / 64 AS y FROM e, (SELECT unnest(range(0, 32)) AS j), (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(1000 + sum(y * (j + 1)), 2) AS checksum FROM n GROUP BY vec_id""", base=False)
def resample_signal(spark, d):
    """64 samples at 128 Hz to 32 at 64 Hz."""
    out = features.resample_signal(_vectors(spark, d), 128, 64)
    return out.select("vec_id", F.size("resampled").alias("n"), F.round(checksum("resampled") + 1000, 2).alias("checksum"))


@query("""WITH b AS (SELECT vec_id // 8 AS recording_id, flatten(list([CAST(x AS DOUBLE) for x in embedding] ORDER BY vec_id)) AS x FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1),
w AS (SELECT recording_id, CAST(t AS INTEGER) AS start_s, x[t * 16 + 1 : (t + 6) * 16] AS y FROM b, (SELECT unnest(range(0, 31, 3)) AS t) WHERE len(x) > t * 16)
SELECT recording_id, start_s, CAST(len(y) AS INTEGER) AS n, CAST(CASE WHEN len(y) < 96 THEN 3 ELSE 0 END AS INTEGER) AS skip_code, round(list_sum([y[i] * i for i in range(1, len(y) + 1)]), 5) AS checksum FROM w""", base=False)
def slice_windows(spark, d):
    """Windows of 6 s at stride 3 s out of blocks of 4 s at 16 Hz."""
    blocks = _vectors(spark, d).select(F.expr("vec_id div 8").alias("recording_id"), F.lit("C3").alias("channel"), (F.col("vec_id") % 8).cast("int").alias("block_idx"), "samples")
    grid = blocks.select("recording_id").distinct().withColumn("start_s", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(3))))
    out = windows.slice_windows(blocks, grid, 6, 16, 64)
    return out.select("recording_id", "start_s", F.size("samples").alias("n"), "skip_code", F.round(checksum("samples"), 5).alias("checksum"))


@query("SELECT vec_id, CAST(11 AS INTEGER) AS n, round(list_sum([CAST(embedding[6 * i + 1] AS DOUBLE) * (i + 1) for i in range(0, 11)]), 6) AS checksum FROM embeddings WHERE embedding IS NOT NULL", base=False)
def downsample_stride(spark, d):
    out = _vectors(spark, d).withColumn("samples", channels.downsample_stride(F.col("samples"), 10))
    return r6(out.select("vec_id", F.size("samples").alias("n"), checksum("samples").alias("checksum")))


@query("""WITH e AS (SELECT vec_id, embedding AS x FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT vec_id, t, k, sum(CAST(x[32 * t + i + 1] AS DOUBLE) * cos(2 * pi() * k * i / 32.0)) AS re, sum(CAST(x[32 * t + i + 1] AS DOUBLE) * sin(2 * pi() * k * i / 32.0)) AS im FROM e, (SELECT unnest(range(0, 2)) AS t), (SELECT unnest(range(1, 11)) AS k), (SELECT unnest(range(0, 32)) AS i) GROUP BY ALL)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(sqrt(re * re + im * im) * (t * 10 + k)), 5) AS checksum FROM b GROUP BY vec_id""", base=False)
def fft_bins(spark, d):
    out = features.fft_bin_table(_vectors(spark, d), 32, 10)
    return out.select("vec_id", F.size("bins").alias("n"), F.round(checksum("bins"), 5).alias("checksum"))


@query("""WITH e AS (SELECT vec_id // 4 AS recording_id, vec_id % 4 AS c, embedding AS x FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT recording_id, c, t, k, sum(CAST(x[8 * t + i + 1] AS DOUBLE) * 100 * sin(pi() * (i + 0.5) / 16) * cos(2 * pi() * k * i / 16.0)) AS re, sum(CAST(x[8 * t + i + 1] AS DOUBLE) * 100 * sin(pi() * (i + 0.5) / 16) * sin(2 * pi() * k * i / 16.0)) AS im
 FROM e, (SELECT unnest(range(0, 7)) AS t), (SELECT unnest(range(1, 9)) AS k), (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL)
SELECT recording_id, CAST(count(DISTINCT t) AS INTEGER) AS n_time, CAST(count(DISTINCT c) AS INTEGER) AS n_ch, CAST(count(DISTINCT k) AS INTEGER) AS n_freq, round(sum(greatest(log10(sqrt(re * re + im * im) + 1e-6), 0) * (t * 32 + c * 8 + k)), 1) AS checksum FROM b GROUP BY recording_id""", base=False)
def spectrograms(spark, d):
    """Log spectrograms of windows of four channels, frames of 16 samples."""
    e = _vectors(spark, d).groupBy(F.expr("vec_id div 4").alias("recording_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "samples"))).alias("c"))
    s = features.stft_features(e.select("recording_id", F.transform("c", lambda x: (x["vec_id"] % 4).cast("int")).alias("c"), F.transform("c", lambda x: F.transform(x["samples"], lambda v: v * 100)).alias("samples")), 16)
    channel = lambda i: F.get("c", (F.floor(i / F.col("n_freq")) % F.col("n_ch")).cast("int"))  # noqa: E731 - a recording may lack some of the four
    place = lambda i: F.floor(i / (F.col("n_ch") * F.col("n_freq"))) * 32 + channel(i) * 8 + i % F.col("n_freq") + 1
    total = F.aggregate(F.transform("spec", lambda x, i: x * place(i)), F.lit(0.0), lambda a, x: a + x)
    return s.select("recording_id", "n_time", "n_ch", "n_freq", F.round(total, 1).alias("checksum"))


BANDS_SQL = ", ".join(f"round(sum(CASE WHEN b = '{n}' THEN area END), 6) AS {n}" for n in features.BANDS)


@query(f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
fr AS (SELECT vec_id, t, x[16 * t + 1 : 16 * t + 32] AS y FROM e, (SELECT unnest(range(0, 3)) AS t)), de AS (SELECT vec_id, t, [(y[i] - list_avg(y)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 32)) for i in range(1, 33)] AS y FROM fr),
ft AS (SELECT vec_id, t, k, sum(y[i + 1] * cos(2 * pi() * k * i / 32.0)) AS re, sum(y[i + 1] * sin(2 * pi() * k * i / 32.0)) AS im FROM de, (SELECT unnest(range(0, 17)) AS k), (SELECT unnest(range(0, 32)) AS i) GROUP BY ALL),
d AS (SELECT vec_id, list(p ORDER BY k) AS p FROM (SELECT vec_id, k, avg(re * re + im * im) / (64.0 * 12) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM ft GROUP BY vec_id, k) GROUP BY vec_id),
bands(b, lo, hi) AS (VALUES {", ".join(f"('{n}', CAST({lo} AS DOUBLE), CAST({min(hi, 32.0)} AS DOUBLE))" for n, (lo, hi) in features.BANDS.items())}),
g AS (SELECT b, list_sort(list_distinct([lo, hi] || [CAST(2 * k AS DOUBLE) for k in range(0, 17) if 2 * k > lo and 2 * k < hi])) AS f FROM bands),
v AS (SELECT vec_id, b, f, [p[CAST(floor(z / 2) AS INTEGER) + 1] + CASE WHEN z >= 32 THEN 0 ELSE (p[least(CAST(floor(z / 2) AS INTEGER) + 2, 17)] - p[CAST(floor(z / 2) AS INTEGER) + 1]) * (z / 2 - floor(z / 2)) END for z in f] AS q FROM d, g),
a AS (SELECT vec_id, b, list_sum([(f[i + 1] - f[i]) * (q[i] + q[i + 1]) / 2 for i in range(1, len(f))]) AS area FROM v), s AS (SELECT vec_id, sum(area) AS total FROM a GROUP BY 1)
SELECT a.vec_id, {BANDS_SQL}, round(sum(CASE WHEN b = 'alpha' THEN area END) / any_value(total), 6) AS alpha_ratio FROM a JOIN s USING (vec_id) GROUP BY a.vec_id""", base=False)
def band_powers(spark, d):
    return r6(features.band_power_table(_vectors(spark, d), 64.0, 32).select("vec_id", *features.BANDS, "alpha_ratio"))


@query()
def channel_importance(spark, d):
    """A forest of 300 trees."""
    rows = _vectors(spark, d).select(F.col("samples").alias("features"), (F.get("samples", F.lit(17)) > 0).cast("int").alias("label"))
    return r6(features.channel_importance(rows, 4))
