"""Channel names, selection, montages, and array operators on blocks of samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The canonical order of channels and the older names of four of them.
CANONICAL = "Fp1 Fp2 F7 F3 Fz F4 F8 T3 C3 Cz C4 T4 T5 P3 Pz P4 T6 O1 O2".split()
LEGACY = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}
# The pairs of the bipolar montages, in their order.
LONGITUDINAL = "Fp1-F7 F7-T3 T3-T5 T5-O1 Fp2-F8 F8-T4 T4-T6 T6-O2 Fp1-F3 F3-C3 C3-P3 P3-O1 Fp2-F4 F4-C4 C4-P4 P4-O2 Fz-Cz Cz-Pz".split()
TRANSVERSE = "F7-Fp1 Fp1-Fp2 Fp2-F8 F7-F3 F3-Fz Fz-F4 F4-F8 T3-C3 C3-Cz Cz-C4 C4-T4 T5-P3 P3-Pz Pz-P4 P4-T6 T5-O1 O1-O2 O2-T6".split()


def pairs_of(montage: Sequence[str]) -> list[tuple[str, str]]:
    return [tuple(x.split("-")) for x in montage]


def normalise_channel(name: Column, to_legacy: bool = True) -> Column:
    """Without blanks, the leading `EEG ` and the trailing `-REF` or `-LE`; older or newer names."""
    c = F.regexp_replace(F.regexp_replace(F.trim(name), r"(?i)^EEG\s+", ""), r"(?i)-(REF|LE)$", "")
    swap = LEGACY if to_legacy else {v: k for k, v in LEGACY.items()}
    table = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(c)), c)


def select_channels(channels: DataFrame, wanted: Sequence[str], partial: bool = True) -> DataFrame:
    """For each wanted label the first raw channel (by ``pos``) that contains or equals it; a recording that lacks one is rejected.

    ``channels``: recording_id, channel, pos. The wanted labels are a literal array: no join of two tables.
    """
    w = channels.withColumn("wanted", F.explode(F.array(*map(F.lit, wanted))))
    hit = F.contains(F.upper("channel"), F.upper("wanted")) if partial else F.upper("channel") == F.upper("wanted")
    first = w.where(hit).withColumn("_n", F.row_number().over(Window.partitionBy("recording_id", "wanted").orderBy("pos"))).where("_n = 1").drop("_n")
    whole = first.groupBy("recording_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select("recording_id")
    return first.join(whole, "recording_id", "left_semi")


def apply_montage(signals: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Bipolar derivations a - b per block, in one pass; ``signals``: recording_id, channel, block_idx, samples.

    A literal table tells the pairs and the side each channel is on; both sides of a pair meet in one aggregate.
    """
    sides = reduce(lambda c, x: c.when(F.col("channel") == x, F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p[0] == x).alias("plus"), F.lit("-".join(p)).alias("derivation")) for i, p in enumerate(pairs) if x in p])), dict.fromkeys(c for p in pairs for c in p), F)
    dealt = signals.select("recording_id", "block_idx", "samples", F.explode(sides).alias("_x")).select("recording_id", "block_idx", "samples", "_x.*")
    met = dealt.groupBy("recording_id", "block_idx", "pos", "derivation").agg(F.first(F.when(F.col("plus"), F.col("samples")), ignorenulls=True).alias("_a"), F.first(F.when(~F.col("plus"), F.col("samples")), ignorenulls=True).alias("_b"))
    return met.where("_a is not null and _b is not null").select("recording_id", "block_idx", "pos", "derivation", F.zip_with("_a", "_b", lambda x, y: x - y).alias("samples"))


def common_average(signals: DataFrame) -> DataFrame:
    """Each channel minus the mean over the channels, per sample; one row of all channels per block in between."""
    g = signals.groupBy("recording_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("_c"))
    mean = F.transform(F.get("_c", F.lit(0)).getField("samples"), lambda x, i: F.aggregate("_c", F.lit(0.0), lambda a, c: a + F.get(c["samples"], i).cast("double")) / F.size("_c"))
    g = g.withColumn("_m", mean)
    return g.select("recording_id", "block_idx", "_m", F.explode("_c").alias("_x")).select("recording_id", "block_idx", F.col("_x.channel").alias("channel"), F.zip_with("_x.samples", "_m", lambda x, m: x - m).alias("samples"))


def two_channel_derivation(window: Column) -> Column:
    """F3-F7 and P3-O1 of a window in canonical channel order."""
    d = lambda a, b: F.zip_with(F.get(window, F.lit(a)), F.get(window, F.lit(b)), lambda x, y: x - y)
    return F.array(d(3, 2), d(13, 17))


def channel_stats(samples: Column) -> dict[str, Column]:
    """RMS, greatest magnitude and its 98th percentile (linear) of an array."""
    x = F.transform(samples, lambda v: F.abs(v.cast("double")))
    s = F.array_sort(x)
    at = (F.size(s) - 1) * F.lit(0.98)
    lo = F.get(s, F.floor(at).cast("int"))
    hi = F.get(s, F.ceil(at).cast("int"))
    return {"rms": F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)), "peak": F.array_max(x), "p98": lo + (hi - lo) * (at - F.floor(at))}


def downsample_stride(samples: Column, target: int) -> Column:
    """Every max(1, n // target)-th sample."""
    step = F.greatest(F.lit(1), F.floor(F.size(samples) / target).cast("int"))
    return F.filter(samples, lambda x, i: i % step == 0)
