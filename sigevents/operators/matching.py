"""Matching of event lists. Greedy matching is sequential by nature, but only among events near each other:
tasks stream over chains of such events; everything about proximity alone is a join."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sigevents.config import DEFAULT, OperatingPoint
from sigevents.operators.curves import threshold_events
from sigevents.operators.events import threshold_table
from sigevents.operators.interval_join import CELL_S, meeting
from sigevents.operators.intervals import concatenate_nearby
from sigevents.sources.scratch import stored

KEY = ("recording_id", "threshold")
MATCHES = "kind string, pred_start double, pred_stop double, ref_start double, ref_stop double"
#: Seconds of a stretch in which chains are found by one task.
CHAIN_CELL_S = 86_400.0


def chained(events: DataFrame, by: Sequence[str], reach: float, cell_s: float = CHAIN_CELL_S) -> DataFrame:
    """``events`` (start_s, stop_s) with ``chain``: the start of the first event of a chain, in which each begins at most ``reach`` after the end of all before it.

    Events that come within ``reach`` of each other are of one chain, so whatever is decided between such
    events is decided inside chains. Stretches of ``cell_s`` seconds are ordered by themselves; what they
    need of those before, the greatest end and the last begin of a chain, is carried over by a window over
    one row a stretch, so a long recording is dealt over many tasks. Events are stored first, since they are
    read three times. Reversed intervals count as their start.
    """
    by = list(by)
    end = F.greatest("start_s", "stop_s")
    x = stored(events, "chained").withColumns({"_cell": F.floor(F.col("start_s") / cell_s), "_end": end})
    ends = x.groupBy(*by, "_cell").agg(F.max("_end").alias("_top"))
    over = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_cell", F.max("_top").over(over).alias("_before"))
    same = lambda a, b: reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, "_cell"]])
    x = x.alias("x").join(carried.alias("c"), same("x", "c")).select("x.*", "_before")
    w = Window.partitionBy(*by, "_cell").orderBy("start_s", "stop_s")
    before = F.greatest(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    x = x.withColumn("_first", F.when(before.isNull() | (F.col("start_s") > before + reach), F.col("start_s")))
    begins = x.groupBy(*by, "_cell").agg(F.max("_first").alias("_last"))
    late = begins.select(*by, "_cell", F.max("_last").over(over).alias("_chain"))
    x = x.withColumn("_own", F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.alias("x").join(late.alias("c"), same("x", "c")).withColumn("chain", F.coalesce("_own", "_chain")).drop("_cell", "_end", "_before", "_first", "_own", "_chain", *[F.col(f"c.{c}") for c in by], F.col("c._cell"))


def nearby(spans: list[tuple], reach: float, long: float) -> Callable[[float, float], range]:
    """For an interval, the places of those of ``spans`` (in order, ``long`` the length of the longest) that can come within ``reach`` of it."""
    starts = [s[0] for s in spans]
    return lambda a, b: range(bisect_left(starts, a - reach - long), bisect_right(starts, b + reach))


def greedy(preds: list[tuple], refs: list[tuple], tol: float) -> list[tuple]:
    """Predictions in time order claim the unclaimed reference within ``tol`` of greatest overlap,
    then least onset and offset error; near a claimed one only: duplicate; near none: false positive."""
    preds, refs = sorted(preds), sorted(refs)
    if not refs:
        return [("false_positive", a, b, None, None) for a, b in preds]
    free, out = set(range(len(refs))), []
    around = nearby(refs, tol, max((b - a for a, b in refs), default=0.0))
    for a, b in preds:
        near = [i for i in around(a, b) if a <= refs[i][1] + tol and b >= refs[i][0] - tol]
        mine = [i for i in near if i in free]
        if mine:
            best = max(mine, key=lambda i: (max(0.0, min(b, refs[i][1]) - max(a, refs[i][0])), -abs(a - refs[i][0]), -abs(b - refs[i][1]), -i))
            free.discard(best)
            out.append(("match", a, b, *refs[best]))
        else:
            out.append(("duplicate" if near else "false_positive", a, b, None, None))
    return out + [("miss", None, None, *refs[i]) for i in sorted(free)]


def by_chain(sides: DataFrame, by: Sequence[str], columns: Sequence[str], decide: Callable[[list, list], list[tuple]], schema: str) -> DataFrame:
    """``decide`` of the left and the right rows (``side`` 0 and 1; tuples of ``columns``) of each chain: rows of ``by`` and ``schema``.

    Chains are dealt by a hash of their key and stream through a task one at a time.
    """
    kinds = [sides.schema[c].dataType for c in by]
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrow = [*map(to_arrow_type, kinds), *map(to_arrow_type, (_parse_datatype_string(t) for t in types))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
        out: list[tuple] = []
        n = len(by)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=[*by, *names])
        for key, group in groupby(rows, key=lambda r: r[: n + 1]):
            pair: tuple[list, list] = ([], [])
            for r in group:
                pair[r[n + 1]].append(r[n + 2 :])
            out += [(*key[:n], *x) for x in decide(*pair)]
            if len(out) > 20_000:
                yield batch()
                out = []
        if out:
            yield batch()

    # by a hash of the key: with the key itself Spark may take a cached side as dealt already and leave the shuffle of the union out
    n = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.select(*by, "chain", "side", *columns).repartition(n, F.xxhash64(*by, "chain")).sortWithinPartitions(*by, "chain")
    head = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(by, kinds, strict=True))
    return dealt.mapInArrow(run, f"{head}, {schema}")


def match_events(preds: DataFrame, refs: DataFrame, tol: float, keys: DataFrame, cell_s: float = CHAIN_CELL_S, by: Sequence[str] = KEY) -> DataFrame:
    """One row per prediction and per missed reference. ``keys``: the recordings and thresholds (``by``, which has recording_id) to be scored.

    Matching is decided inside chains of predictions and references that come within ``tol`` of each other, so the events of a long recording are dealt over many tasks.
    """
    sides = preds.select(*by, F.lit(0).alias("side"), "start_s", "stop_s").unionByName(keys.select(*by).join(refs, "recording_id").select(*by, F.lit(1).alias("side"), "start_s", "stop_s"))
    return by_chain(chained(sides, by, tol, cell_s), by, ["start_s", "stop_s"], lambda a, b: greedy(a, b, tol), MATCHES)


def proximity_hits(events: DataFrame, others: DataFrame, tol: float, by: tuple[str, ...] = ("recording_id",), cell_s: float | None = CELL_S) -> DataFrame:
    """Events within ``tol`` of any other, ends included."""
    return _told_apart(events, others, tol, by, "left_semi", cell_s)


def proximity_misses(events: DataFrame, others: DataFrame, tol: float, by: tuple[str, ...] = ("recording_id",), cell_s: float | None = CELL_S) -> DataFrame:
    return _told_apart(events, others, tol, by, "left_anti", cell_s)


def _told_apart(events: DataFrame, others: DataFrame, tol: float, by: tuple[str, ...], how: str, cell_s: float | None) -> DataFrame:
    events, key = stored(events, "events"), [*by, "start_s", "stop_s"]
    near = meeting(events.select(*key), others, by, strict=False, tol=tol, cell_s=cell_s).select(*key).distinct()
    return events.join(near, key, how)


def score_overlap(preds: DataFrame, refs: DataFrame, keys: DataFrame, merge_fa_s: float | None = None, cell_s: float | None = CELL_S) -> DataFrame:
    """Per key: references that any prediction overlaps, and predictions that overlap none (those nearer than ``merge_fa_s`` count once)."""
    r = refs.groupBy("recording_id", "start_s", "stop_s").agg(F.count("*").alias("_times"))
    p = stored(preds.select(*KEY, "start_s", "stop_s"), "predictions")
    met = meeting(p, r, keep=["_times"], cell_s=cell_s).select(*KEY, "start_s", "stop_s", "_r0", "_r1", "_times")
    hits = met.groupBy(*KEY, "_r0", "_r1").agg(F.first("_times").alias("_hits")).groupBy(*KEY).agg(F.sum("_hits").alias("hits"))
    false = p.join(met.select(*KEY, "start_s", "stop_s").distinct(), [*KEY, "start_s", "stop_s"], "left_anti")
    if merge_fa_s is not None:
        false = concatenate_nearby(false, merge_fa_s, KEY)
    found = hits.join(false.groupBy(*KEY).agg(F.count("*").alias("false_alarms")), list(KEY), "full")
    n = r.groupBy("recording_id").agg(F.sum("_times").alias("n_refs"))
    return keys.select(*KEY).distinct().join(found, list(KEY), "left").join(n, "recording_id", "left").select(*KEY, "hits", "false_alarms", "n_refs").fillna(0)


def summarise_run(matches: DataFrame, durations: DataFrame, keys: DataFrame) -> DataFrame:
    """Per recording and threshold: counts, sensitivity (null without references), false positives per 24 h (null without duration), mean errors."""
    n = lambda k: F.count_if(F.col("kind") == k)
    m = matches.groupBy(*KEY).agg(n("match").alias("hits"), n("miss").alias("misses"), n("false_positive").alias("false_positives"), n("duplicate").alias("duplicates"), F.avg(F.abs(F.col("pred_start") - F.col("ref_start"))).alias("onset_error"), F.avg(F.abs(F.col("pred_stop") - F.col("ref_stop"))).alias("offset_error"))
    out = keys.select(*KEY).distinct().join(m, list(KEY), "left").fillna(0, ["hits", "misses", "false_positives", "duplicates"]).join(durations, "recording_id")
    return add_rates(out.withColumns({"n_refs": F.col("hits") + F.col("misses"), "n_preds": F.col("hits") + F.col("false_positives") + F.col("duplicates")}))


def add_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"sensitivity": F.try_divide(F.col("hits"), F.col("n_refs")), "fp_per_24h": F.try_divide(F.col("false_positives") * F.lit(86400.0), F.col("duration_s"))})


def event_sweep(runs: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Summed pooled and per cohort; rates from the sums. ``pooled`` tells the total from a null cohort."""
    sums = [F.sum(c).alias(c) for c in ("n_refs", "n_preds", "hits", "misses", "false_positives", "duplicates", "duration_s")]
    g = runs.groupingSets([["threshold"], ["threshold", cohort]], "threshold", cohort).agg(*sums, (F.grouping_id() == 1).alias("pooled"))
    return add_rates(g)


ABLATION = {"raw": (False, False), "shape": (False, True), "average": (True, False), "average_shape": (True, True)}


def postprocessing_ablation(windows: DataFrame, durations: DataFrame, refs: DataFrame, keys: DataFrame, thresholds: Sequence[float], op: OperatingPoint = DEFAULT) -> DataFrame:
    """The event sweep for hot windows as they are, shaped, averaged per second, and both; ``config`` tells which.

    ``keys``: the recordings to be scored; ``durations``: recording_id, duration_s, cohort.
    """
    runs = []
    for average in (False, True):  # one sweep gives events both as they are and shaped
        e = threshold_events(windows, durations, thresholds, op.seg, op.min_duration, op.merge_gap, average, (False, True)).join(keys, "recording_id", "left_semi")
        name = {shape: config for config, (mean, shape) in ABLATION.items() if mean == average}
        runs.append(e.withColumn("config", F.when(F.col("shaped"), name[True]).otherwise(name[False])).drop("shaped"))
    preds = runs[0].unionByName(runs[1])
    of = threshold_table(keys.select("recording_id", F.explode(F.array(*map(F.lit, ABLATION))).alias("config")), thresholds)
    matches = match_events(preds, refs, op.tolerance, of, by=[*KEY, "config"])
    counts = matches.groupBy("config", "threshold").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("match", "hits"), ("miss", "misses"), ("false_positive", "false_positives"), ("duplicate", "duplicates"))])
    total = durations.join(keys, "recording_id", "left_semi").agg(F.sum("duration_s").alias("duration_s"))
    grid = windows.sparkSession.createDataFrame([(c, float(t)) for c in ABLATION for t in thresholds], "config string, threshold double")
    out = grid.join(counts, ["config", "threshold"], "left").fillna(0).join(F.broadcast(total))  # one row
    return add_rates(out.withColumn("n_refs", F.col("hits") + F.col("misses")))


def convention_comparison(preds: DataFrame, refs: DataFrame, durations: DataFrame, keys: DataFrame, tol: float, merge_fa_s: float = 30.0) -> DataFrame:
    """Per threshold: hits, false alarms, sensitivity and false alarms per 24 h by greedy matching, by any overlap, and by any overlap with near false alarms merged."""
    preds = stored(preds, "predictions")
    m = match_events(preds, refs, tol, keys).groupBy("threshold").agg(F.count_if(F.col("kind") == "match").alias("hits"), F.count_if(F.col("kind") == "false_positive").alias("false_alarms"), F.count_if(F.col("kind").isin("match", "miss")).alias("n_refs"))
    parts = [m.withColumn("convention", F.lit("greedy"))]
    for name, merge in (("overlap", None), ("overlap_merged", merge_fa_s)):
        o = score_overlap(preds, refs, keys, merge).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("hits", "false_alarms", "n_refs")])
        parts.append(o.withColumn("convention", F.lit(name)))
    total = durations.join(keys.select("recording_id").distinct(), "recording_id", "left_semi").agg(F.sum("duration_s").alias("duration_s"))
    out = reduce(lambda a, b: a.unionByName(b), parts).join(F.broadcast(total))  # one row
    return out.withColumns({"sensitivity": F.try_divide("hits", "n_refs"), "fa_per_24h": F.try_divide(F.col("false_alarms") * F.lit(86400.0), "duration_s")})


def compare_event_lists(a: DataFrame, b: DataFrame, cell_s: float = CHAIN_CELL_S) -> DataFrame:
    """Per recording: greedy matching by overlap in time order; matched, lost, gained, greatest shift of a boundary. Decided by chains of events that touch."""

    def decide(x: list[tuple], y: list[tuple]) -> list[tuple]:
        x, y = sorted(x), sorted(y)
        free, matched, shift = set(range(len(y))), 0, 0.0
        around = nearby(y, 0.0, max((e - s for s, e in y), default=0.0))
        for s, e in x:
            over = [(min(e, y[i][1]) - max(s, y[i][0]), -i) for i in around(s, e) if i in free]
            if over and max(over)[0] > 0:
                i = -max(over)[1]
                free.discard(i)
                matched += 1
                shift = max(shift, abs(s - y[i][0]), abs(e - y[i][1]))
        return [(matched, len(x) - matched, len(free), shift)]

    sides = a.select("recording_id", F.lit(0).alias("side"), "start_s", "stop_s").unionByName(b.select("recording_id", F.lit(1).alias("side"), "start_s", "stop_s"))
    parts = by_chain(chained(sides, ["recording_id"], 0.0, cell_s), ["recording_id"], ["start_s", "stop_s"], decide, "matched bigint, lost bigint, gained bigint, max_shift double")
    return parts.groupBy("recording_id").agg(*[F.sum(c).alias(c) for c in ("matched", "lost", "gained")], F.max("max_shift").alias("max_shift"))


REVIEW = "event_id int, start_s double, stop_s double, source_start_s double, source_stop_s double, prob double, status string, review_note string"


def merge_review_state(proposals: DataFrame, reviewed: DataFrame, least: float = 0.5, cell_s: float = CHAIN_CELL_S) -> DataFrame:
    """Each proposal takes the best unused reviewed event that overlaps at least ``least`` of the shorter
    one (on source extents) and inherits its id, status, note and extent; reviewed ones left over stay.

    ``least`` is more than 0, so this is decided by chains of events whose source extents touch. A reviewed
    event without a source extent (an added one) has its own; ties go to the first reviewed event in time.
    """
    names = [c.split()[0] for c in REVIEW.split(", ")]
    top = lambda *p: max((x for x in p if x is not None and x == x), default=None)

    def decide(left: list[tuple], right: list[tuple]) -> list[tuple]:
        old = sorted((dict(zip(names, r[2:], strict=True)) | {"at": r[:2]} for r in right), key=lambda r: (r["start_s"], r["stop_s"]))
        order = sorted(range(len(old)), key=lambda i: old[i]["at"])
        around = nearby([old[i]["at"] for i in order], 0.0, max((r["at"][1] - r["at"][0] for r in old), default=0.0))
        used, out = set(), []
        for p in sorted((dict(zip(names, r[2:], strict=True)) for r in left), key=lambda r: (r["start_s"], r["stop_s"])):
            share = []
            for i in (order[k] for k in around(p["start_s"], p["stop_s"])):
                r0, r1 = old[i]["at"]
                short = min(p["stop_s"] - p["start_s"], r1 - r0)
                if i not in used and short > 0 and (s := (min(p["stop_s"], r1) - max(p["start_s"], r0)) / short) >= least:
                    share.append((s, -i))
            if share:
                i = -max(share)[1]
                used.add(i)
                out.append(old[i] | {"source_start_s": p["start_s"], "source_stop_s": p["stop_s"], "prob": top(p["prob"], old[i]["prob"])})
            else:
                out.append({"event_id": None, "start_s": p["start_s"], "stop_s": p["stop_s"], "source_start_s": p["start_s"], "source_stop_s": p["stop_s"], "prob": p["prob"], "status": "proposed", "review_note": None})
        out += [r for i, r in enumerate(old) if i not in used]
        return [tuple(r[c] for c in names) for r in out]

    def side(df: DataFrame, k: int, a: Column, b: Column) -> DataFrame:
        there = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names]
        cast = [c.cast(t).alias(f"_{n}") for c, n, t in zip(there, names, (x.split()[1] for x in REVIEW.split(", ")), strict=True)]
        return df.select("recording_id", F.lit(k).alias("side"), a.cast("double").alias("start_s"), b.cast("double").alias("stop_s"), *cast)

    known = F.col("source_start_s").isNotNull() & ~F.isnan(F.col("source_start_s").cast("double"))
    own = lambda s, e: F.when(known, F.col(s)).otherwise(F.col(e))
    sides = side(proposals, 0, F.col("start_s"), F.col("stop_s")).unionByName(side(reviewed, 1, own("source_start_s", "start_s"), own("source_stop_s", "stop_s")))
    return by_chain(chained(sides, ["recording_id"], 0.0, cell_s), ["recording_id"], ["start_s", "stop_s", *[f"_{n}" for n in names]], decide, REVIEW)


def shortest_first(recordings: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` shortest recordings; ties in order of the recording."""
    return recordings.orderBy("duration_s", "recording_id").limit(limit)


def worklist(events: DataFrame) -> DataFrame:
    """Each recording's events with ``place``, their order of review: by start, then stop."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "stop_s")))


def top_rows(df: DataFrame, k: int, order: list, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
