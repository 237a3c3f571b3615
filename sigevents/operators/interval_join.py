"""Joins of intervals that meet, dealt by cells of time.

An interval has a class by its length: ``cell_s`` times FACTOR to the power of the class is the least such
length that holds it, so in cells of this length it lies in two at most. Two intervals are compared at the
greater one of their classes, in the cells they share there, and count in the first of these: every pair is
found once. The recording and the cell are the key, so a recording is dealt over as many tasks as it has
cells, and rows of any length go to few of them. Which classes the right side has is told to the left one as
one row, so that a side of short intervals makes one or two rows of each.

``cell_s`` is a parameter and no switch: None joins by the recording alone, with the same rows. A null key or
bound meets nothing; a reversed interval is taken as it stands in the comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_S, FACTOR, CLASSES = 3_600.0, 8, 7


def _class(a: Column, b: Column, cell_s: float) -> Column:
    """The class of an interval; the last one has all longer ones too."""
    long = F.abs(b - a)
    return reduce(lambda rest, k: F.when(long <= cell_s * FACTOR**k, k).otherwise(rest), reversed(range(CLASSES - 1)), F.lit(CLASSES - 1))


def _cells(df: DataFrame, levels: Column, a: str, b: str, cell_s: float) -> DataFrame:
    """Rows with _level and _cell, one for each cell that the interval [a, b] reaches at each level."""
    size = F.lit(cell_s) * F.pow(F.lit(float(FACTOR)), F.col("_level"))
    df = df.withColumn("_level", F.explode(levels))
    lo, hi = F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)
    return df.withColumn("_cell", F.explode(F.sequence(lo, hi)))


def meeting(left: DataFrame, right: DataFrame, by: Sequence[str] = ("recording_id",), until: Column | None = None, strict: bool = True, tol: float = 0.0, keep: Sequence[str] = (), cell_s: float | None = CELL_S) -> DataFrame:
    """Columns of ``left`` with _r0, _r1 (and ``keep``) of each interval of ``right`` that it meets.

    ``until``: the end of a left interval, if it has no stop_s. ``strict``: they overlap by more than a point;
    else they come within ``tol`` of each other, ends included.
    """
    by = list(by)
    r = right.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("start_s").cast("double").alias("_r0"), F.col("stop_s").cast("double").alias("_r1"), *keep)
    x = left.withColumns({"_l0": F.col("start_s").cast("double"), "_l1": (F.col("stop_s") if until is None else until).cast("double")})
    on = [F.col(c) == F.col(f"_by{i}") for i, c in enumerate(by)]
    on += [F.col("_l0") < F.col("_r1"), F.col("_l1") > F.col("_r0")] if strict else [F.col("_l0") <= F.col("_r1") + tol, F.col("_l1") >= F.col("_r0") - tol]
    gone = ["_l0", "_l1", *[f"_by{i}" for i in range(len(by))]]
    if cell_s is not None:
        r = r.where("_r0 is not null and _r1 is not null").withColumns({"_a": F.col("_r0") - tol, "_b": F.col("_r1") + tol})
        r = r.withColumn("_rc", _class(F.col("_a"), F.col("_b"), cell_s))
        x = x.where("_l0 is not null and _l1 is not null").withColumn("_lc", _class(F.col("_l0"), F.col("_l1"), cell_s))
        classes = r.agg(F.collect_set("_rc").alias("_classes"))  # CLASSES at most
        x = x.join(F.broadcast(classes))
        x = _cells(x, F.array_distinct(F.transform("_classes", lambda c: F.greatest(c, F.col("_lc")))), "_l0", "_l1", cell_s)
        r = _cells(r, F.sequence(F.col("_rc"), F.lit(CLASSES - 1)), "_a", "_b", cell_s).withColumnsRenamed({"_level": "_rlevel", "_cell": "_rcell"})
        size = F.lit(cell_s) * F.pow(F.lit(float(FACTOR)), F.col("_level"))
        first = F.floor(F.greatest(F.least("_l0", "_l1"), F.least("_a", "_b")) / size)
        on += [F.col("_level") == F.col("_rlevel"), F.col("_cell") == F.col("_rcell"), F.col("_level") == F.greatest("_lc", "_rc"), F.col("_cell") == first]
        gone += ["_a", "_b", "_rc", "_lc", "_classes", "_level", "_cell", "_rlevel", "_rcell"]
    return x.join(r, reduce(lambda p, q: p & q, on)).drop(*gone)
