"""Curves of scores over time, and their runs above any number of thresholds, from one pass over the windows.

Windows are dealt by recording and stretch of ``span_s`` seconds; one that reaches into the next stretch
goes to both, so at most two rows a window are shuffled, and a long recording is dealt over many tasks.

In a stretch, the windows' begins and ends are swept in order of time. Windows of one length that cover a
moment are neighbours in this order, so mean and maximum of what covers each piece between two boundaries
are reductions over ranges; the sum is never a difference of larger ones. For events the stretches of many
recordings are swept in one go.

Runs are nested: a piece that is above a threshold is above all lower ones. So with thresholds in order
each piece has a level, the number of thresholds it reaches; where the level rises from i to k, runs begin
for the thresholds i to k - 1, where it falls they end, and begins and ends of a threshold pair up in order.
The work is that of the sweep and of the runs there are, not of thresholds times seconds. The highest score
in a run is a range maximum from a table of powers of two. Runs nearer than the gap are joined where they
are made; those at the edges of stretches are joined over all of them in a window over these few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPAN_S = 86_400
#: A gap that only touching intervals have.
TOUCH = 1e-9


def dealt(windows: DataFrame, durations: DataFrame, seg: int, by: Sequence[str], span_s: int, skip_policy: str = "zero") -> DataFrame:
    """by, span, axis, start, p: windows in each stretch they reach into, and for each stretch of the recording a row with ``axis`` and the duration as ``p``."""
    by = list(by)
    scored = windows.where("coalesce(skip_code, 0) = 0") if skip_policy == "exclude" else windows
    first, last = F.floor(F.floor("start_s") / span_s), F.floor((F.ceil(F.col("start_s") + seg) - 1) / span_s)
    w = scored.where("prob is not null and start_s is not null").select(*by, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("span"), F.lit(False).alias("axis"), F.col("start_s").cast("double").alias("start"), F.col("prob").cast("double").alias("p"))
    n = durations.select("recording_id", F.col("duration_s").cast("double").alias("p")).where("p > 0")
    ends = windows.select(*by).distinct().join(n, "recording_id")
    stretches = F.sequence(F.lit(0), F.floor((F.ceil("p") - 1) / span_s).cast("int"))
    axis = ends.select(*by, F.explode(stretches).alias("span"), F.lit(True).alias("axis"), F.lit(0.0).alias("start"), "p")
    rows = w.unionByName(axis)
    # by a hash of the key: with the keys themselves Spark may take a side of the union as dealt already; a number is
    # given because partitions are joined by their bytes else, which are few for the work that they make
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.xxhash64(*by, "span")).sortWithinPartitions(*by, "span", F.desc("axis"), "start")


Group = tuple[tuple, int, float | None, np.ndarray, np.ndarray]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Group]:
    """key, span, duration or None, starts, scores of each recording's stretch."""
    key, held = None, []

    def whole() -> Group:
        start, p = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        axis = np.concatenate([h[2] for h in held])
        return key[:-1], key[-1], float(p[axis][0]) if axis.any() else None, start[~axis], p[~axis]

    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys + 1)), strict=True))
        axis, start, p = (batch.column(keys + k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        begin = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[begin]:
                if key is not None and names[begin] != key:
                    yield whole()
                    held = []
                key = names[begin]
                held.append((start[begin:i], p[begin:i], axis[begin:i].astype(bool)))
                begin = i
    if held:
        yield whole()


def pieces(lo: np.ndarray, hi: np.ndarray, begin: float, end: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of a stretch [begin, end) swept by windows [lo, hi) in order, and for each piece between two the range of windows that cover it."""
    edges = np.unique(np.concatenate([[begin, end], lo, hi]))
    edges = edges[(edges >= begin) & (edges <= end)]
    return edges, np.searchsorted(hi, edges[:-1], "right"), np.searchsorted(lo, edges[:-1], "right")


def pieces_of_many(of: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """``pieces`` of many stretches at once: each piece's stretch, its bounds, and the range of windows that cover it.

    ``of``: each window's stretch, in order. A stretch and a time are one whole number, the stretch's and
    the time's place among all times, so nothing is added to a time.
    """
    k = np.arange(len(begin))
    times, place = np.unique(np.concatenate([begin, end, lo, hi]), return_inverse=True)
    key = np.concatenate([k, k, of, of]) * len(times) + place
    first_edge, last_edge, lo_key, hi_key = np.split(key, [len(k), 2 * len(k), 2 * len(k) + len(of)])
    edges = np.unique(key)
    stretch = edges // len(times)
    edges = edges[(edges >= first_edge[stretch]) & (edges <= last_edge[stretch])]
    stretch, time = np.divmod(edges, len(times))
    at = np.flatnonzero(stretch[1:] == stretch[:-1])
    return stretch[at], times[time[at]], times[time[at + 1]], np.searchsorted(hi_key, edges[at], "right"), np.searchsorted(lo_key, edges[at], "right")


def reduced(ufunc: np.ufunc, p: np.ndarray, first: np.ndarray, last: np.ndarray, none: float) -> np.ndarray:
    """``ufunc`` over the ranges [first, last) of ``p``; ``none`` for empty ones."""
    out, some = np.full(len(first), none), first < last
    if some.any():
        at = np.stack([first[some], last[some]], 1).ravel()
        out[some] = ufunc.reduceat(np.append(p, 0.0), at)[::2]
    return out


def curve(start: np.ndarray, p: np.ndarray, seg: int, begin: float, end: float, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Edges and float scores of the pieces of the per-second curve: whole seconds that a window touches count as covered; 0 where none is."""
    lo, hi = np.floor(start), np.ceil(start + seg)
    edges, first, last = pieces(lo, hi, begin, end)
    if how == "max":
        return edges, reduced(np.maximum, p, first, last, 0.0).astype(np.float32)
    return edges, (reduced(np.add, p, first, last, 0.0) / np.maximum(last - first, 1)).astype(np.float32)


def per_second(windows: DataFrame, durations: DataFrame, seg: int, how: str, skip_policy: str, by: Sequence[str], span_s: int = SPAN_S) -> DataFrame:
    """by, s, p of every second of the recordings."""
    by = list(by)
    kinds = [windows.schema[c].dataType for c in by]
    arrow = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            n = [len(s) for _, s, _ in held]
            at = np.repeat(np.arange(len(held)), n)
            keys = [pa.array([k[i] for k, _, _ in held], t).take(pa.array(at)) for i, t in enumerate(arrow)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([s for _, s, _ in held]).astype(np.int32)), pa.array(np.concatenate([v for _, _, v in held]))], names=[*by, "s", "p"])

        total = 0
        for key, span, duration, start, p in groups(batches, len(by)):
            if duration is None:
                continue
            begin, end = span * span_s, min((span + 1) * span_s, int(np.ceil(duration)))
            edges, value = curve(start, p, seg, begin, end, how)
            held.append((key, np.arange(begin, end), np.repeat(value, np.diff(edges).astype(int))))
            total += end - begin
            if total > 50_000:
                yield packed()
                held, total = [], 0
        if held:
            yield packed()

    schema = ", ".join([f"`{c}` {k.simpleString()}" for c, k in zip(by, kinds, strict=True)] + ["s int", "p float"])
    return dealt(windows, durations, seg, by, span_s, skip_policy).mapInArrow(run, schema)


def range_maxima(p: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of ranges [first, last), none empty, that gives their maxima: two entries of a table of powers of two each."""
    table = [p]
    while 2 << len(table) - 1 <= len(p):
        half = 1 << len(table) - 1
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))
    flat = np.concatenate(table)
    begins = np.cumsum([0, *map(len, table)])

    def of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp(last - first)[1] - 1
        return np.maximum(flat[begins[level] + first], flat[begins[level] + last - (1 << level)])

    return of


def nested_runs(stretch: np.ndarray, value: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """threshold's place, first and last piece of every maximal run of pieces of a stretch with value >= threshold; thresholds ascend. In order of stretch, threshold and time."""
    level = np.searchsorted(thresholds, value, "right")
    other = stretch[1:] != stretch[:-1]
    before, after = np.r_[0, np.where(other, 0, level[:-1])], np.r_[np.where(other, 0, level[1:]), 0]

    def spread(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = high - low
        which = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(at, n)
        order = np.lexsort((place, which, stretch[place]))
        return which[order], place[order]

    up, down = np.flatnonzero(level > before), np.flatnonzero(level > after)
    which, first = spread(up, before[up], level[up])
    _, last = spread(down, after[down], level[down])
    return which, first, last


def joined(stretch: np.ndarray, which: np.ndarray, a: np.ndarray, b: np.ndarray, top: np.ndarray, gap: float) -> tuple[np.ndarray, ...]:
    """Disjoint runs in order, with those of one stretch and threshold joined whose gap is less than ``gap``."""
    if not len(which):
        return stretch, which, a, b, top
    new = np.r_[True, (stretch[1:] != stretch[:-1]) | (which[1:] != which[:-1]) | (a[1:] - b[:-1] >= gap)]
    at = np.flatnonzero(new)
    return stretch[at], which[at], a[at], b[np.r_[at[1:] - 1, len(b) - 1]], np.maximum.reduceat(top, at)


#: Windows, and stretches, that are swept in one go.
SWEEP_WINDOWS, SWEEP_STRETCHES = 50_000, 5_000


def threshold_events(windows: DataFrame, durations: DataFrame, thresholds: Sequence[float], seg: int, min_duration: float, gap: float, average: bool = True, shapes: Sequence[bool] = (True,), skip_policy: str = "zero", span_s: int = SPAN_S) -> DataFrame:
    """recording_id, threshold, shaped, start_s, stop_s, prob: events of all thresholds, clamped to the recording.

    ``average``: runs of the per-second mean; else of time under hot windows, joined where they touch.
    ``shapes``: for True, runs nearer than ``gap`` are joined, then ones shorter than ``min_duration`` left
    out; for False runs as they are. prob is the highest score of what is hot in the event.
    """
    kind = windows.schema["recording_id"].dataType
    arrow = [to_arrow_type(kind), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
    names = ["recording_id", "threshold", "shaped", "start_s", "stop_s", "prob"]
    sorted_ = np.array(sorted({float(t) for t in thresholds}))
    gaps = {shape: max(gap, TOUCH) if shape else TOUCH for shape in shapes}

    def runs_of(held: list[Group]) -> tuple[np.ndarray, ...]:
        """stretch, threshold's place, begin, end and highest score of all runs of some stretches."""
        begin = np.array([float(g[1] * span_s) for g in held])
        start, p = (np.concatenate([g[k] for g in held]) for k in (3, 4))
        of = np.repeat(np.arange(len(held)), [len(g[3]) for g in held])
        if average:
            end = np.minimum(begin + span_s, np.ceil([g[2] for g in held]))
            stretch, a, b, first, last = pieces_of_many(of, np.floor(start), np.ceil(start + seg), begin, end)
            value = top = (reduced(np.add, p, first, last, 0.0) / np.maximum(last - first, 1)).astype(np.float32).astype(float)
        else:
            stretch, a, b, first, last = pieces_of_many(of, start, start + seg, begin, begin + span_s)
            value = reduced(np.maximum, p, first, last, -np.inf)
            duration = np.array([-np.inf if g[2] is None else g[2] for g in held])
            inside = (start < duration[of]) & (start + seg > 0)
            top = value if inside.all() else reduced(np.maximum, np.where(inside, p, -np.inf), first, last, -np.inf)
        which, first, last = nested_runs(stretch, value, sorted_)
        return stretch[first], which, a[first], b[last], range_maxima(top)(first, last + 1) if len(which) else np.zeros(0)

    def events(held: list[Group]) -> Iterator[pa.RecordBatch]:
        found = runs_of(held)
        keys, begins = pa.array([g[0][0] for g in held], arrow[0]), np.array([g[1] * span_s for g in held])
        for shape, near in gaps.items():
            stretch, which, a, b, top = joined(*found, near)
            if shape:  # what may still be joined over an edge stays
                begin = begins[stretch]
                keep = (b - a >= min_duration) | (a - begin < near) | (begin + span_s - b < near)
                stretch, which, a, b, top = (x[keep] for x in (stretch, which, a, b, top))
            if len(which):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(stretch)), pa.array(sorted_[which]), pa.array(np.full(len(which), shape)), pa.array(a), pa.array(b), pa.array(top)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in groups(batches, 1):
            if average and group[2] is None:
                continue
            held.append(group)
            n += len(group[3])
            if n > SWEEP_WINDOWS or len(held) > SWEEP_STRETCHES:
                yield from events(held)
                held, n = [], 0
        if held:
            yield from events(held)

    parts = dealt(windows, durations, seg, ["recording_id"], span_s, skip_policy).mapInArrow(run, f"recording_id {kind.simpleString()}, threshold double, shaped boolean, start_s double, stop_s double, prob double")
    key = ["recording_id", "threshold", "shaped"]
    # events that an edge between stretches cuts: neighbours of one threshold, nearer than the gap, are joined
    w = Window.partitionBy(*key).orderBy("start_s", "stop_s")
    near = F.when(F.col("shaped"), max(gap, TOUCH)).otherwise(TOUCH)
    new = F.coalesce(F.col("start_s") - F.lag("stop_s").over(w) >= near, F.lit(True))
    islands = parts.withColumn("_new", new).withColumn("_at", F.max(F.when(F.col("_new"), F.col("start_s"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy(*key, "_at").agg(F.min("start_s").alias("start_s"), F.max("stop_s").alias("stop_s"), F.max("prob").alias("prob"))
    d = durations.select("recording_id", F.col("duration_s").alias("_d"))
    long = ~F.col("shaped") | (F.col("stop_s") - F.col("start_s") >= min_duration)
    clamped = whole.where(long).join(d, "recording_id").withColumns({"start_s": F.greatest("start_s", F.lit(0.0)), "stop_s": F.least("stop_s", F.col("_d"))}).where("stop_s > start_s")
    return clamped.select(*names)
