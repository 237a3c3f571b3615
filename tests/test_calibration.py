"""Folds fitted together against fits of each alone; resampling counts and areas at any partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigevents.operators import binned_draws, calibration, folds, resampling


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(4)
    p = np.round(r.random(3000), 3)
    y = (r.random(3000) < p**2).astype(int)
    rows = [(float(a), int(b), int(g)) for a, b, g in zip(p, y, r.integers(0, 9, 3000))]
    return spark.createDataFrame(rows, "prob double, label int, g int").repartition(5).cache()


@pytest.mark.parametrize("k", [3, None])
def test_folds_together_are_folds_alone(scored, k):
    """Every method's out-of-fold scores equal those of a fit of each fold's training part by itself."""
    got = calibration.all_calibrated(scored, "g", k).toPandas()
    assert len(got) == 3000 and got.fold.nunique() == (k or 9)
    whole = calibration.group_folds(scored, "g", k or 9).cache()
    for f in (0, 2):
        train, mine = whole.where(F.col("fold") != f), got[got.fold == f]
        z = np.log(np.clip(mine.prob, 1e-6, 1 - 1e-6) / (1 - np.clip(mine.prob, 1e-6, 1 - 1e-6)))
        a, b = calibration.fit_platt(train)
        assert np.allclose(mine.platt, 1 / (1 + np.exp(-(z * a + b))), atol=1e-7)
        assert np.allclose(mine.temperature, 1 / (1 + np.exp(-z / calibration.fit_temperature(train))), atol=1e-7)
        xs, ys, n = calibration.fit_isotonic(train)
        assert np.allclose(mine.isotonic, np.clip(np.interp(mine.prob, xs, ys), 0.5 / n, 1 - 0.5 / n), atol=1e-9)


def test_passes_do_not_grow_with_folds(spark, scored):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds"))
    used = []
    for k in (2, 9):
        spark.sparkContext.setJobGroup("folds", "")
        before = jobs()
        table = folds.counts(calibration.group_folds(scored, "g", k), "prob", "label")
        folds.temperature(table, k)
        used.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[0] == used[1]


def plain_pooled(y, n):
    """Isotonic means by the greatest of least averages."""
    m = len(y)
    cy, cn = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(n)]
    low = np.array([[(cy[j + 1] - cy[i]) / (cn[j + 1] - cn[i]) if j >= i else np.inf for j in range(m)] for i in range(m)])
    return [max(low[i, k:].min() for i in range(k + 1)) for k in range(m)]


def test_isotonic_over_ranges(spark):
    """Blocks pooled in ranges and again across them, against the definition, and one fit of 300,000 distinct scores over ten ranges."""
    r = np.random.default_rng(5)
    p = np.sort(r.random(60))
    y, n = r.integers(0, 4, 60).astype(float), np.full(60, 4.0)
    table = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(p, y, n)] + [(0, 0.5, 1.0, 2.0)], "fold int, p double, y double, n double")
    want = plain_pooled(y, n)
    for parts in (1, 3, 20):
        xs, ys, total = folds.isotonic(table, 2, parts)[0]  # fold 0's training part is fold 1
        assert total == n.sum() and np.allclose(np.interp(p, xs, ys), want)
    m = 300_000
    p = r.random(m)
    y = (r.random(m) < p).astype(float)
    order = np.argsort(p)
    big = spark.createDataFrame(pd.DataFrame({"fold": np.ones(m, int), "p": p, "y": y, "n": np.ones(m)})).repartition(8)
    xs, ys, _ = folds.isotonic(big, 1, 10)[0]
    value, size, lo, hi = folds.pooled(y[order], np.ones(m), p[order], p[order])
    assert np.allclose(np.interp(p[order], xs, ys), (value / size).repeat(size.astype(int)))


def test_no_class_to_learn_from(spark):
    """A fold whose training part has one class passes scores through; rows without a score stay."""
    df = spark.createDataFrame([(0.2, 0, "a"), (0.7, 0, "a"), (0.9, 1, "b"), (None, 0, "b"), (float("nan"), 0, "b")], "prob double, label int, g string")
    got = calibration.all_calibrated(df, "g", None).toPandas()
    assert len(got) == 5 and got[got.g == "b"].query("prob == 0.9")[list(calibration.METHODS)].to_numpy().tolist() == [[0.9] * 3]
    assert got[got.prob.isna()][list(calibration.METHODS)].isna().all(None)


def test_drawn_counts():
    for n in (1, 2, 37, 5_000):
        whole = resampling.drawn(np.arange(n), n, 0, 200, 7)
        assert (whole.sum(1) == n).all() and (whole >= 0).all()
        some = np.unique(np.random.default_rng(n).integers(0, n, 20))
        assert (resampling.drawn(some, n, 0, 200, 7) == whole[:, some]).all()
        assert (resampling.drawn(some, n, 0, 60, 7) == whole[:60, some]).all()
    assert (resampling.drawn(np.arange(n), n, resampling.DRAW_BLOCK, 200, 7) != whole).any()
    # counts are those of drawing with replacement: mean 1, variance 1 - 1/n, and pairs of them -1/n
    c = np.concatenate([resampling.drawn(np.arange(4), 4, k * resampling.DRAW_BLOCK, resampling.DRAW_BLOCK, 1) for k in range(40)])
    assert np.allclose(c.mean(0), 1, atol=0.03) and np.allclose(np.cov(c.T), np.eye(4) - 0.25, atol=0.04)


def test_draws_at_any_partitioning(spark):
    """Scores that very many rows have, missing and NaN ones, few and many ranges: the same areas."""
    r = np.random.default_rng(6)
    n = 4000
    p = np.where(r.random(n) < 0.6, 0.0, np.round(r.random(n), 2))
    df = spark.createDataFrame(pd.DataFrame({"prob": p, "label": (r.random(n) < 0.3).astype(int), "g": r.integers(0, 800, n).astype(str)}))
    more = df.union(spark.createDataFrame([(None, 1, "5"), (float("nan"), 1, "6")], df.schema))
    found = [calibration.auc_draws(t, "g", 300, 2, parts=parts, range_rows=rows).orderBy("draw").toPandas().auc.to_numpy() for t, parts, rows in ((df, 1, 10**6), (more.repartition(7), 5, 100), (more, 40, 300))]
    assert len(found[0]) == 300 and all(np.allclose(x, found[0], atol=1e-12) for x in found)
    several = calibration.precision_bootstrap(df, [0.1, 0.9, 2.0], "g", 100).orderBy("threshold").collect()
    assert [r.n_hot for r in several] == [int((p >= t).sum()) for t in (0.1, 0.9, 2.0)] and several[2].precision is None
    assert several[0].lo < several[0].precision < several[0].hi


def test_quantile_bins_of_every_draw(spark):
    """Errors over bins drawn anew equal those of plain resamples; the difference of two methods is of the same draws."""
    r = np.random.default_rng(9)
    n, k = 700, 25
    pdf = pd.DataFrame({"prob": np.round(r.random(n), 2), "label": (r.random(n) < 0.2).astype(int), "g": r.integers(0, k, n)})
    pdf["other"] = pdf.prob**2
    df = spark.createDataFrame(pdf).repartition(4)
    order = {x.g: x["rank"] for x in resampling.ranked(df, "g", 5)[0].collect()}
    w = resampling.drawn(np.arange(k), k, 0, 40, 5)

    def plain(score, draw):
        at = np.repeat(np.arange(n), w[draw][pdf.g.map(order)])
        p, y = pdf[score].to_numpy()[at], pdf.label.to_numpy()[at]
        e = np.unique(np.quantile(p, np.linspace(0, 1, 16)))
        e[0], e[-1] = 0, 1 + 1e-9
        b = np.searchsorted(e, p, "right") - 1
        return sum(abs(p[b == i].sum() - y[b == i].sum()) for i in set(b)) / len(p)

    for parts in (1, 6):
        got = binned_draws.ece_draws(df, "g", "prob", 15, 40, 5, parts=parts).orderBy("draw").toPandas()
        assert np.allclose(got.value, [plain("prob", d) for d in range(40)], atol=1e-9)
    found = {(x.method, x.other): x for x in binned_draws.ece_intervals(df, "g", {"raw": "prob", "square": "other"}, 15, 40, 5).collect()}
    delta = np.array([plain("other", d) - plain("prob", d) for d in range(40)])
    assert found[("raw", "square")].mean == pytest.approx(delta.mean()) and found[("raw", "square")].lo == pytest.approx(np.quantile(delta, 0.025))
    assert found[("raw", "square")].separable == bool((np.quantile(delta, [0.025, 0.975]) > 0).all() or (np.quantile(delta, [0.025, 0.975]) < 0).all()) and len(found) == 3
    one = df.withColumn("label", F.lit(0))
    assert binned_draws.ece_draws(one, "g", "prob", 15, 10).where("value is not null").count() == 0
