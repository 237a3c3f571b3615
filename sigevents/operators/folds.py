"""Calibrators of all folds at once.

What a fold is fitted on is everything but its own rows, so each sum over its training part is the total
less the fold's own sum. Scores are counted once by fold and distinct score; then each step of the fit is
one pass over these counts, in which every task sums for every fold's present parameters, and the folds'
sums come to the driver, a few numbers a fold. So the number of Spark jobs is that of the steps, whatever
many folds there are, also with one group left out at a time.

*Isotonic.* Pooling adjacent violators gives the same blocks from any blocks that some of the pooling has
made already. Ranges of scores are pooled by themselves, for every fold, and the blocks that are left, far
fewer than scores, are pooled again over the ranges, each fold by one task. A range holds the counts between
two bounds of the score (about ``RANGE_ROWS`` distinct fold and score pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.operators.metrics import in_ranges

EPS = 1e-6
RANGE_ROWS = 200_000
Blocks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # positives, rows, least and greatest score


def counts(folds: DataFrame, score: str, label: str) -> DataFrame:
    """fold, p, y, n: positives and rows of each fold's distinct scores; missing and NaN scores are left out."""
    p = F.col(score).cast("double")
    return folds.where(p.isNotNull() & ~F.isnan(p)).groupBy("fold", p.alias("p")).agg(F.sum(label).cast("double").alias("y"), F.count("*").cast("double").alias("n"))


def training_sums(table: DataFrame, k: int, width: int, terms: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each fold, ``width`` sums over the rows of all others.

    ``terms``: of logits, positives, rows (each of ``m`` rows) and folds to be summed for, the terms (folds, width, m).
    Folds are taken a few at a time, so that a task holds a bounded number of terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, width))
        for batch in batches:
            fold, p, y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "p", "y", "n"))
            q = np.clip(p, EPS, 1 - EPS)
            z = np.log(q / (1 - q))
            step = max(1, 2_000_000 // max(1, width * len(z)))
            for b in range(0, k, step):
                some = np.arange(b, min(b + step, k))
                t = terms(z, y, n, some)
                t[(fold[None, :] == some[:, None])[:, None, :].repeat(width, 1)] = 0
                out[some] += t.sum(2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *[pa.array(out[:, i].copy()) for i in range(width)]], names=["fold", *[f"s{i}" for i in range(width)]])

    names = [f"s{i}" for i in range(width)]
    sums = table.mapInArrow(run, "fold long, " + ", ".join(f"{s} double" for s in names)).groupBy("fold").agg(*[F.sum(s).alias(s) for s in names]).toPandas()
    out = np.zeros((k, width))
    out[sums["fold"].to_numpy()] = sums[names].to_numpy()
    return out


def platt(table: DataFrame, k: int, c: float = 1e6, rounds: int = 25) -> np.ndarray:
    """Slope and intercept for each fold, by Newton's method on the logit; one pass a step."""
    at = np.tile([1.0, 0.0], (k, 1))
    going = np.ones(k, bool)
    for _ in range(rounds):
        now = at.copy()

        def terms(z, y, n, some, now=now):
            p = 1 / (1 + np.exp(-(z * now[some, :1] + now[some, 1:])))
            w, r = n * p * (1 - p), n * p - y
            return np.stack([r * z, r, w * z * z, w * z, w], 1)

        ga, gb, haa, hab, hbb = training_sums(table, k, 5, terms).T
        ga, haa = ga + at[:, 0] / c, haa + 1 / c
        det = haa * hbb - hab * hab
        going &= det > 0
        safe = np.where(det > 0, det, 1)
        step = np.stack([(hbb * ga - hab * gb) / safe, (haa * gb - hab * ga) / safe], 1)
        at[going] -= np.clip(step, -2, 2)[going]
        going &= np.abs(step).sum(1) >= 1e-9
        if not going.any():
            break
    return at


def temperature(table: DataFrame, k: int, rounds: int = 6, grid: int = 17) -> np.ndarray:
    """Temperature of least log loss for each fold, log T in [-4, 4]; each pass tries a grid for all folds."""
    lo, hi = np.full(k, -4.0), np.full(k, 4.0)
    for _ in range(rounds):
        logs = np.linspace(lo, hi, grid, axis=1)

        def terms(z, y, n, some, logs=logs):
            x = z / np.exp(logs[some])[:, :, None]
            return y * np.logaddexp(0, -x) + (n - y) * np.logaddexp(0, x)

        best = training_sums(table, k, grid, terms).argmin(1)
        lo, hi = logs[np.arange(k), np.maximum(best - 1, 0)], logs[np.arange(k), np.minimum(best + 1, grid - 1)]
    return np.exp((lo + hi) / 2)


def pooled(y: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Blocks:
    """Blocks of ascending mean from blocks in order of the score."""
    stack: list[list[float]] = []
    for block in zip(y.tolist(), n.tolist(), lo.tolist(), hi.tolist(), strict=True):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:  # the mean before is not less
            a, b, _, d = stack.pop()
            stack[-1][0] += a
            stack[-1][1] += b
            stack[-1][3] = d
    return tuple(np.array(c) for c in zip(*stack, strict=True)) if stack else (np.zeros(0),) * 4


def isotonic(table: DataFrame, k: int, parts: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each fold the edges of its blocks, their values, and how many rows it was fitted on."""
    rows = table.count()
    parts = parts or max(1, -(-rows // RANGE_ROWS))
    found = table.agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first().b if parts > 1 else []
    ranged = in_ranges(table, "p", found or [], "part")
    schema = "fold long, part int, y double, n double, lo double, hi double"

    def table_of(fold: int, part: int, blocks: Blocks) -> pd.DataFrame:
        y, n, lo, hi = blocks
        return pd.DataFrame({"fold": np.full(len(y), fold), "part": np.full(len(y), part), "y": y, "n": n, "lo": lo, "hi": hi})

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", kind="stable")
        p, y, n, fold = (pdf[c].to_numpy() for c in ("p", "y", "n", "fold"))
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        all_y, all_n, place = np.add.reduceat(y, starts), np.add.reduceat(n, starts), np.searchsorted(p[starts], p)
        out = []
        for f in range(k):
            mine = fold == f
            rest_y, rest_n = all_y - np.bincount(place[mine], y[mine], len(starts)), all_n - np.bincount(place[mine], n[mine], len(starts))
            some = rest_n > 0
            out.append(table_of(f, key[0], pooled(rest_y[some], rest_n[some], p[starts][some], p[starts][some])))
        return pd.concat(out)

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo", kind="stable")
        return table_of(key[0], 0, pooled(*(pdf[c].to_numpy() for c in ("y", "n", "lo", "hi"))))

    blocks = ranged.groupBy("part").applyInPandas(within, schema).groupBy("fold").applyInPandas(across, schema).toPandas()
    models = {}
    for f, b in blocks.sort_values(["fold", "lo"]).groupby("fold"):
        value, wide = (b["y"] / b["n"]).to_numpy(), (b["hi"] > b["lo"]).to_numpy()
        at, which = np.stack([b["lo"], b["hi"]], 1).ravel(), np.stack([np.ones(len(b), bool), wide], 1).ravel()
        models[int(f)] = (at[which], value.repeat(2)[which], float(b["n"].sum()))
    return models
