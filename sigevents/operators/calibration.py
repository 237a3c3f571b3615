"""Calibrators: temperature, Platt, isotonic; group folds; bootstrap over clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.operators import folds
from sigevents.operators.metrics import in_ranges, prefix_sums, roc_auc
from sigevents.operators.resampling import blocks, ranges_of, rows_of_range, with_ranks
from sigevents.sources.scratch import stored

EPS = 1e-6
METHODS = ("temperature", "platt", "isotonic")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p.cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit_temperature(df: DataFrame, score: str = "prob", label: str = "label", rounds: int = 6, grid: int = 17) -> float:
    """Temperature of least log loss, log T in [-4, 4]; each round tries a grid of values in one job."""
    lo, hi = -4.0, 4.0
    t = df.groupBy(F.col(score).cast("double").alias("p")).agg(F.sum(F.col(label)).cast("double").alias("y"), F.count("*").cast("double").alias("n")).select(logit(F.col("p")).alias("z"), "y", "n").persist()
    z, y, rest = F.col("z"), F.col("y"), F.col("n") - F.col("y")
    for _ in range(rounds):
        ts = np.linspace(lo, hi, grid)
        loss = [F.sum(y * F.log1p(F.exp(-z / float(np.exp(x)))) + rest * F.log1p(F.exp(z / float(np.exp(x))))).alias(f"t{i}") for i, x in enumerate(ts)]
        got = t.agg(*loss).first()
        if got[0] is None:
            return 1.0
        best = int(np.argmin(list(got)))
        lo, hi = ts[max(0, best - 1)], ts[min(grid - 1, best + 1)]
    t.unpersist()
    return float(np.exp((lo + hi) / 2))


def fit_platt(df: DataFrame, score: str = "prob", label: str = "label", c: float = 1e6, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the logit, by Newton's method; each step is one aggregate of five sums."""
    t = df.groupBy(F.col(score).cast("double").alias("p")).agg(F.sum(F.col(label)).cast("double").alias("y"), F.count("*").cast("double").alias("n"))
    t = t.select(logit(F.col("p")).alias("z"), "y", "n").persist()
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(F.col("z") * a + b)
        w = F.col("n") * p * (1 - p)
        r = F.col("n") * p - F.col("y")
        ga, gb, haa, hab, hbb = t.agg(F.sum(r * F.col("z")), F.sum(r), F.sum(w * F.col("z") * F.col("z")), F.sum(w * F.col("z")), F.sum(w)).first()
        ga, haa = ga + a / c, haa + 1 / c
        det = haa * hbb - hab * hab
        if not det > 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-2.0, min(2.0, da)), b - max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    t.unpersist()
    return a, b


def fit_isotonic(df: DataFrame, score: str = "prob", label: str = "label"):
    """MLlib's isotonic regression of the label on the score, from the mean label and weight of each distinct score; its boundaries and predictions."""
    rows = df.groupBy(F.col(score).cast("double").alias("features")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    m = IsotonicRegression(weightCol="weight").fit(rows)
    return list(m.boundaries), list(m.predictions), df.count()


def apply_isotonic(p: Column, model: tuple) -> Column:
    """Linear between the boundaries, clipped at them and to [1/2n, 1-1/2n]."""
    xs, ys, n = model

    @F.pandas_udf("double")  # the boundaries are as many as the fitted steps
    def value(q: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.interp(q, xs, ys), 0.5 / n, 1 - 0.5 / n))

    return value(p.cast("double"))


def group_folds(df: DataFrame, group: str, k: int, seed: str = "0") -> DataFrame:
    """``fold`` of each row: its group's place in the order of a hash, modulo k."""
    md5 = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(seed)))
    g = df.select(group).distinct().withColumns({"_h": F.conv(F.substring(md5, 1, 13), 16, 10).cast("double"), "_one": F.lit(1)})
    ranked = prefix_sums(g, "_h", ["_one"], descending=False)  # thirteen digits: no two groups share a place
    return df.join(ranked.select(group, ((F.col("cum__one") - 1) % k).cast("int").alias("fold")), group)


def _isotonic_values(models: Broadcast, fits: np.ndarray) -> Callable[[Column, Column], Column]:
    """A function of scores and folds: linear between the edges of the fold's blocks, clipped at them and to [1/2n, 1-1/2n]."""

    @F.pandas_udf("double")
    def value(q: pd.Series, f: pd.Series) -> pd.Series:
        out = q.to_numpy(float, copy=True)
        for i in np.unique(f):
            if fits[i]:
                xs, ys, n = models.value[int(i)]
                mine = ((f == i) & q.notna()).to_numpy()
                out[mine] = np.clip(np.interp(out[mine], xs, ys), 0.5 / n, 1 - 0.5 / n)
        return pd.Series(out)

    return value


def all_calibrated(df: DataFrame, group: str, k: int | None = 5, methods: Sequence[str] = METHODS, score: str = "prob", label: str = "label", rounds: int = 6) -> DataFrame:
    """Rows with ``fold`` and an out-of-fold calibrated score for each method, ``<method>``; all folds are fitted together (folds.py).

    A fold whose training part lacks a class passes scores through, and so do rows without a score. ``k``
    None leaves one group out at a time. The models, a few numbers a fold (for isotonic ones the edges of
    their steps), go to the tasks as one table. ``rounds``: passes of the search for the temperature, each eight times finer.
    """
    k = k or df.select(group).distinct().count()
    rows = stored(group_folds(df, group, k), "folds")
    table = stored(folds.counts(rows, score, label), "counts")
    own = table.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas().set_index("fold").reindex(range(k)).fillna(0.0)
    rest = own.sum() - own
    fits = ((rest.y > 0) & (rest.y < rest.n)).to_numpy()
    p, fold, spark = F.col(score).cast("double"), F.col("fold"), df.sparkSession
    for m in methods:
        if m == "isotonic":
            value = _isotonic_values(spark.sparkContext.broadcast(folds.isotonic(table, k) if fits.any() else {}), fits)
            rows = rows.withColumn(m, value(p, fold))
            continue
        if m == "temperature":
            params = np.stack([1 / folds.temperature(table, k, rounds), np.zeros(k)], 1)
        else:
            params = folds.platt(table, k)
        model = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(params) if fits[i]], "fold int, _a double, _b double")
        fitted = F.when(F.col("_a").isNull() | F.isnan(p), p).otherwise(sigmoid(logit(p) * F.col("_a") + F.col("_b")))
        rows = rows.join(F.broadcast(model), "fold", "left").withColumn(m, fitted).drop("_a", "_b")  # a row a fold
    return rows


def cross_validated(df: DataFrame, group: str, k: int | None = 5, method: str = "platt", score: str = "prob", label: str = "label") -> DataFrame:
    """Rows with ``fold`` and ``calibrated``, the out-of-fold score of one method."""
    return all_calibrated(df, group, k, (method,), score, label).withColumnRenamed(method, "calibrated")


def fold_auc_delta(validated: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Per fold: AUC of raw and of calibrated scores, and their difference."""
    validated = stored(validated.select("fold", score, "calibrated", label), "validated")
    raw, new = (roc_auc(validated, ["fold"], c, label).select("fold", F.col("auc").alias(n)) for c, n in ((score, "auc_raw"), ("calibrated", "auc_calibrated")))
    return raw.join(new, "fold").withColumn("delta", F.col("auc_calibrated") - F.col("auc_raw"))


#: Rows whose counts are summed at once.
STRIP = 1024


class _Ordered:
    """Rows of a range, scores descending and positives before negatives of the same score, cut into strips of whole scores; a score of more rows is a strip of its own."""

    def __init__(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray, where: np.ndarray):
        some = np.concatenate([np.flatnonzero(pos), np.flatnonzero(neg)])
        up = np.arange(len(some)) < np.count_nonzero(pos)
        order = np.lexsort([~up, -p[some]])
        p, self.up, self.value, self.where = p[some][order], up[order], np.where(up, pos[some], neg[some])[order], where[some][order]
        new = np.r_[True, p[1:] != p[:-1]][: len(p)]
        scores = np.r_[np.flatnonzero(new), len(p)]
        turn = np.r_[True, self.up[1:] != self.up[:-1]][: len(p)]
        tied = turn & ~new  # negatives that start below positives of their own score
        mixed = np.zeros(len(p), bool)
        mixed[tied] = True
        mixed = np.add.reduceat(mixed, scores[:-1]).astype(bool)[np.cumsum(new) - 1] if len(p) else mixed
        self.starts, self.tied = turn | new & (mixed | np.r_[False, mixed[:-1]][: len(p)]), tied
        self.strips = []
        a = 0
        while a < len(scores) - 1:
            b = max(a + 1, int(np.searchsorted(scores, scores[a] + STRIP, "right")) - 1)
            self.strips.append((scores[a], scores[b]))
            self.starts[scores[a]] = True
            a = b

    def weighted(self, a: int, b: int, w: np.ndarray) -> np.ndarray:
        g = np.take(w, self.where[a:b], axis=0).astype(float)
        if (self.value[a:b] != 1).any():
            g *= self.value[a:b, None]
        return g

    def pairs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per draw: positives, negatives and ordered pairs, ties by half; ``w``: counts (clusters, draws)."""
        above, below, pairs = np.zeros((3, w.shape[1]))
        for a, b in self.strips:
            if b - a > STRIP:
                cut = a + int(np.count_nonzero(self.up[a:b]))
                pos, neg = (sum((self.weighted(i, min(i + STRIP, z), w).sum(0) for i in range(y, z, STRIP)), np.zeros(w.shape[1])) for y, z in ((a, cut), (cut, b)))
                pairs += neg * (above + pos / 2)
            else:
                at = np.flatnonzero(self.starts[a:b])
                runs, up, tied = np.add.reduceat(self.weighted(a, b, w), at, 0), self.up[a:b][at], np.flatnonzero(self.tied[a:b][at])
                higher = np.cumsum(runs * up[:, None], 0)
                pairs += (runs[~up] * (higher[~up] + above)).sum(0) - (runs[tied] * runs[tied - 1]).sum(0) / 2
                pos, neg = higher[-1], runs[~up].sum(0)
            above += pos
            below += neg
        return above, below, pairs


def _auc_draws(df: DataFrame, cluster: str, draws: int, seed: int, scores: Sequence[str], label: str, parts: int | None, range_rows: int | None) -> DataFrame:
    """score (its place in ``scores``), draw, auc; see auc_draws. The k-th ranges of all scores are one task's, which makes the draws' counts once for them."""
    rows, n = with_ranks(df, cluster, seed)
    of_score = [F.struct(F.lit(i).alias("score"), F.col(s).cast("double").alias("p")) for i, s in enumerate(scores)]
    rows = rows.select("rank", F.col(label).alias("_label"), F.explode(F.array(*of_score)).alias("s")).select("rank", "_label", "s.*")
    counts = rows.where(F.col("p").isNotNull() & ~F.isnan("p")).groupBy("score", "rank", "p").agg(F.sum("_label").cast("double").alias("pos"), F.sum(1 - F.col("_label")).cast("double").alias("neg"))
    counts = stored(counts, "counts")
    range_rows = range_rows or rows_of_range(n)
    parts = parts or ranges_of(df.sparkSession, -(-counts.count() // len(scores)), range_rows)
    dealt = []
    for i in range(len(scores)):
        own = counts.where(F.col("score") == i)
        hot = {r.p: r.n for r in own.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > range_rows).collect()}  # no more than rows / range_rows
        found = own.agg(F.percentile_approx("p", [k / parts for k in range(1, parts)], 100 * parts).alias("b")).first().b if parts > 1 else []
        ranged = in_ranges(own, "p", [*(found or []), *hot, *(math.nextafter(x, math.inf) for x in hot)], "part")
        salt = F.lit(0)
        for x, rows_ in hot.items():
            salt = F.when(F.col("p") == x, F.col("rank") % (-(-rows_ // range_rows))).otherwise(salt)
        dealt.append(ranged.withColumns({"salt": salt.cast("int"), "tied": F.col("p").isin(*hot) if hot else F.lit(False)}))
    ranged = reduce(DataFrame.unionByName, dealt).repartition(4 * parts, "part", "salt")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, where = np.unique(pdf["rank"].to_numpy(), return_inverse=True)
        tables, made = [], []
        for i, t in pdf.assign(where=where).groupby("score"):
            tables.append((i, bool(t["tied"].iloc[0]), _Ordered(*(t[c].to_numpy() for c in ("p", "pos", "neg", "where")))))
        for first, w in blocks(own, n, draws, seed):
            for i, tied, ordered in tables:
                pos, neg, pairs = ordered.pairs(w)
                made.append(pd.DataFrame({"score": i, "part": key[0], "tied": tied, "draw": np.arange(first, first + len(pos), dtype=np.int32), "pos": pos, "neg": neg, "pairs": pairs}))
        return pd.concat(made)

    sums = ranged.groupBy("part", "salt").applyInPandas(run, "score int, part int, tied boolean, draw int, pos double, neg double, pairs double")
    sums = sums.groupBy("score", "part", "draw").agg(F.first("tied").alias("tied"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    sums = sums.withColumn("pairs", F.when(F.col("tied"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("pairs")))
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("score", "draw").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("pairs", F.col("pairs") + F.col("neg") * above)
    return sums.groupBy("score", "draw").agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_draws(df: DataFrame, cluster: str, draws: int, seed: int, score: str = "prob", label: str = "label", parts: int | None = None, range_rows: int | None = None) -> DataFrame:
    """draw, auc (null for one class) of all resamples of the clusters; rows without a score (or with NaN) are left out, their clusters are not.

    Counts of each cluster and distinct score are dealt over ranges of about ``range_rows`` of them. A range
    gives, for every draw, its weighted positives and negatives and the pairs it orders; the ranges of a draw
    are then added up from the highest one down. A score that more rows have is a range of its own, dealt by
    cluster: all its pairs are ties, for which sums are enough. A task holds DRAW_BLOCK draws of a range.
    """
    return _auc_draws(df, cluster, draws, seed, [score], label, parts, range_rows).drop("score")


def _interval(draws: DataFrame, target: float | None = None) -> DataFrame:
    got = draws.where("value is not null")
    beyond = F.avg((F.col("value") >= target).cast("double")) if target is not None else F.lit(None).cast("double")
    return got.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg("value").alias("mean"), F.count("*").alias("n"), beyond.alias("p_at_least"))


def cluster_bootstrap(df: DataFrame, cluster: str, draws: int = 2000, seed: int = 0, target: float | None = None, score: str = "prob", label: str = "label") -> DataFrame:
    """Interval of the AUC under resampling of clusters. One-class draws are left out."""
    got = auc_draws(df, cluster, draws, seed, score, label)
    return _interval(got.withColumnRenamed("auc", "value"), target)


#: Neighbouring ranks of a task: counts are made once for all their rows.
RUN = 4096


def summed_draws(sums: DataFrame, cluster: str, columns: Sequence[str], by: Sequence[str], draws: int, seed: int) -> DataFrame:
    """``by``, draw, and the resampled sums of ``columns`` of a table of one row for each cluster and ``by``."""
    by = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    table, n = with_ranks(sums, cluster, seed)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, where = np.unique(pdf["rank"].to_numpy(), return_inverse=True)
        keyed = [(k if isinstance(k, tuple) else (k,), t) for k, t in pdf.assign(_where=where).groupby(by)] if by else [((), pdf.assign(_where=where))]
        parts = [(key, t["_where"].to_numpy(), t[list(columns)].to_numpy(float).T) for key, t in keyed]
        made = []
        for first, w in blocks(own, n, draws, seed):
            for name, at, values in parts:
                got = values @ w[at].astype(float)
                made.append(pd.DataFrame({**dict(zip(by, name, strict=True)), "draw": np.arange(first, first + got.shape[1], dtype=np.int32), **dict(zip(columns, got, strict=True))}))
        return pd.concat(made)

    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + ["draw int"] + [f"{c} double" for c in columns])
    runs = table.select("rank", *by, *columns).withColumn("_run", F.expr(f"rank div {RUN}")).groupBy("_run")
    return runs.applyInPandas(run, schema).groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in columns])


def ece_bootstrap(df: DataFrame, cluster: str, n_bins: int = 10, draws: int = 2000, seed: int = 0, score: str = "prob", label: str = "label") -> DataFrame:
    """Interval of the expected calibration error over bins of equal width, filled anew in each draw."""
    p = F.col(score).cast("double")
    bin_ = F.least(F.floor(p * n_bins), F.lit(n_bins - 1)).cast("int")
    sums = df.groupBy(cluster, bin_.alias("bin")).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("p"), F.sum(label).cast("double").alias("y"))
    got = summed_draws(sums, cluster, ["n", "p", "y"], ["bin"], draws, seed)
    return _interval(got.groupBy("draw").agg(F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("value")))


def precision_bootstrap(df: DataFrame, thresholds: float | Sequence[float], cluster: str, draws: int = 2000, seed: int = 0, score: str = "prob", label: str = "label") -> DataFrame:
    """threshold, precision, n_hot, lo, hi: share of positives among scores at or above each threshold, their number, and the share's interval under one resampling of the clusters for all thresholds."""
    thresholds = [float(t) for t in ([thresholds] if isinstance(thresholds, (int, float)) else thresholds)]
    t = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hot = F.col(score).cast("double") >= F.col("threshold")
    sums = stored(t.groupBy(cluster, "threshold").agg(F.count_if(hot).cast("double").alias("n"), F.sum(F.when(hot, F.col(label)).otherwise(0)).cast("double").alias("y")), "sums")
    whole = sums.groupBy("threshold").agg(F.try_divide(F.sum("y"), F.sum("n")).alias("precision"), F.sum("n").cast("long").alias("n_hot"))
    got = summed_draws(sums, cluster, ["n", "y"], ["threshold"], draws, seed).select("threshold", F.try_divide("y", "n").alias("value")).where("value is not null")
    ends = got.groupBy("threshold").agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"))
    return whole.join(ends, "threshold", "left")


def paired_delta_bootstrap(pairs: DataFrame, cluster: str, draws: int = 10_000, seed: int = 0, a: str = "prob_a", b: str = "prob_b", label: str = "label") -> DataFrame:
    """Interval of AUC(b) - AUC(a), both from the same draw; share of draws in which b is worse."""
    both = _auc_draws(pairs, cluster, draws, seed, [a, b], label, None, None).groupBy("draw")
    x, y = (F.max(F.when(F.col("score") == i, F.col("auc"))) for i in (0, 1))
    got = both.agg((y - x).alias("value")).where("value is not null")
    out = got.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg("value").alias("delta"), F.avg((F.col("value") < 0).cast("double")).alias("p_worse"))
    return out.withColumn("crosses_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))
