"""Calibration error over quantile bins that are drawn anew with each resample of the clusters.

A draw's edges are linear quantiles of its own scores. Counts of each cluster and distinct score lie in
ranges of the score. A first pass over them gives each range's sums in every draw, and so which range
holds which of a draw's order statistics; a second one finds these in their ranges, and the sums of what
lies below them and of what does not lie above them. A bin's sums are differences of these. Both passes sum
strips of neighbouring rows for all draws at once; only the strip that holds an order statistic is looked
at by itself. What comes to the driver and goes to the tasks is a few numbers for each range or edge and draw.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.operators.metrics import in_ranges
from sigevents.operators.resampling import blocks, ranges_of, rows_of_range, with_ranks
from sigevents.sources.scratch import stored

#: Rows of a strip of neighbouring scores.
STRIP = 256
#: Sums below a found score, and up to it.
FOUND = ("n0", "p0", "y0", "n1", "p1", "y1")


def ece_draws(df: DataFrame, cluster: str, score: str, n_bins: int = 15, draws: int = 2000, seed: int = 0, label: str = "label", parts: int | None = None) -> DataFrame:
    """draw, value: expected calibration error over quantile bins of every resample; null for a draw of one class.

    Rows without a score, or with NaN, are left out; their clusters are not.
    """
    p = F.col(score).cast("double")
    rows, n = with_ranks(df, cluster, seed)
    counts = stored(rows.where(p.isNotNull() & ~F.isnan(p)).groupBy("rank", p.alias("p")).agg(F.count("*").cast("double").alias("n"), F.sum(label).cast("double").alias("y")), "counts")
    parts = parts or ranges_of(df.sparkSession, counts.count(), rows_of_range(n))
    found = counts.agg(F.percentile_approx("p", [k / parts for k in range(1, parts)], 100 * parts).alias("b")).first().b if parts > 1 else []
    ranged = in_ranges(counts, "p", found or [], "part").repartition(4 * parts, "part")

    def sorted_range(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, (rows, their scores, positives), own clusters and each row's place among them, in order of the score."""
        pdf = pdf.sort_values("p", kind="stable")
        p, size, y = (pdf[c].to_numpy() for c in ("p", "n", "y"))
        return p, np.stack([size, size * p, y]), *np.unique(pdf["rank"].to_numpy(), return_inverse=True)

    def strips(values: np.ndarray, where: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums (strip, value, draw) of strips of rows."""
        return np.stack([values[:, a : a + STRIP] @ w[where[a : a + STRIP]].astype(float) for a in range(0, len(where), STRIP)])

    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, own, where = sorted_range(pdf)
        made = np.concatenate([strips(values, where, w).sum(0) for _, w in blocks(own, n, draws, seed)], 1)
        return pd.DataFrame({"part": key[0], "draw": np.arange(draws), "n": made[0], "p": made[1], "y": made[2]})

    sums = ranged.groupBy("part").applyInPandas(weigh, "part int, draw long, n double, p double, y double").toPandas()  # ranges times draws
    names = np.sort(sums["part"].unique())
    table = np.zeros((3, len(names), draws))
    table[:, np.searchsorted(names, sums["part"]), sums["draw"]] = sums[["n", "p", "y"]].to_numpy().T
    ends, total = table.cumsum(1), table.sum(1)
    place = np.arange(n_bins + 1)[:, None] / n_bins * np.maximum(total[0] - 1, 0)
    wanted = np.stack([np.floor(place), np.ceil(place)])  # (2, edge, draw): places from 0
    held = np.stack([np.searchsorted(ends[0, :, d], wanted[:, :, d].ravel(), "right") for d in range(draws)]).reshape(draws, 2, n_bins + 1) if len(names) else np.zeros((draws, 2, n_bins + 1))
    sent = df.sparkSession.sparkContext.broadcast((names, ends[0] - table[0], wanted, held, total[0]))

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, before, wanted, held, total = sent.value
        me = int(np.searchsorted(names, key[0]))
        p, values, own, where = sorted_range(pdf)
        out = []

        def up_to(i: int, d: int, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """Sums of draw ``d``'s first ``i`` rows."""
            k = i // STRIP
            return starts[k, :, d] + values[:, k * STRIP : i] @ w[where[k * STRIP : i], d]

        for first, w in blocks(own, n, draws, seed):
            here = [d for d in range(w.shape[1]) if total[first + d] and (held[first + d] == me).any()]
            if not here:
                continue
            starts = np.concatenate([np.zeros((1, 3, w.shape[1])), strips(values, where, w).cumsum(0)])
            for d in here:
                for side, edge in zip(*np.nonzero(held[first + d] == me), strict=True):
                    at = wanted[side, edge, first + d] - before[me, first + d]
                    k = int(np.searchsorted(starts[1:, 0, d], at, "right"))
                    rows = slice(k * STRIP, (k + 1) * STRIP)
                    i = k * STRIP + int(np.searchsorted(np.cumsum(values[0, rows] * w[where[rows], d]) + starts[k, 0, d], at, "right"))
                    lo, hi = np.searchsorted(p, p[i], "left"), np.searchsorted(p, p[i], "right")
                    out.append((first + d, side, edge, p[i], *up_to(lo, d, w, starts), *up_to(hi, d, w, starts)))
        return pd.DataFrame(out, columns=["draw", "side", "edge", "value", *FOUND])

    stats = ranged.groupBy("part").applyInPandas(find, "draw long, side long, edge long, value double, " + ", ".join(f"{c} double" for c in FOUND)).toPandas()  # two rows an edge and draw
    at, below = np.zeros((2, n_bins + 1, draws)), np.zeros((2, 2, 3, n_bins + 1, draws))  # below: side, less than the value or up to it
    side, edge, draw = (stats[c].to_numpy() for c in ("side", "edge", "draw"))
    at[side, edge, draw] = stats["value"]
    if len(stats):
        earlier = (ends - table)[:, held[draw, side, edge].astype(int), draw].T
        for i, columns in enumerate((FOUND[:3], FOUND[3:])):
            below[side, i, :, edge, draw] = stats[list(columns)].to_numpy() + earlier
    quantiles = at[0] + (at[1] - at[0]) * (place - np.floor(place))
    # a score equal to an edge is in the bin above it
    under = np.where(quantiles == at[0], below[0, 0], np.where(quantiles == at[1], below[1, 0], below[0, 1]))
    found = []
    for d in range(draws):
        distinct, k = np.unique(quantiles[:, d], return_index=True)
        inner = under[:, k[1:-1], d] if len(distinct) > 1 else np.zeros((3, 0))  # the ends are 0 and just over 1
        own = np.diff(np.concatenate([np.zeros((3, 1)), inner, total[:, d, None]], 1))
        found.append((d, float(np.abs(own[1] - own[2]).sum() / total[0, d]) if 0 < total[2, d] < total[0, d] else None))
    return df.sparkSession.createDataFrame(found, "draw long, value double")


def ece_intervals(df: DataFrame, cluster: str, scores: Mapping[str, str], n_bins: int = 15, draws: int = 2000, seed: int = 0, label: str = "label") -> DataFrame:
    """method, other, mean, lo, hi, separable: the error's interval of each method (``other`` null), and of each two methods' difference from the same draws.

    ``scores``: method to column. ``separable``: the difference's interval does not hold 0. Draws of one class are left out.
    """
    table = stored(df.select(cluster, label, *scores.values()), "scores")
    found = {m: stored(ece_draws(table, cluster, c, n_bins, draws, seed, label).where("value is not null"), "draws") for m, c in scores.items()}
    parts = [d.select(F.lit(m).alias("method"), F.lit(None).cast("string").alias("other"), "value") for m, d in found.items()]
    for a, b in combinations(found, 2):
        both = found[a].join(found[b].withColumnRenamed("value", "_b"), "draw")
        parts.append(both.select(F.lit(a).alias("method"), F.lit(b).alias("other"), (F.col("_b") - F.col("value")).alias("value")))
    out = reduce(lambda x, y: x.unionByName(y), parts).groupBy("method", "other").agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"))
    return out.withColumn("separable", F.when(F.col("other").isNotNull(), (F.col("lo") > 0) | (F.col("hi") < 0)))
