"""Resampling at size: few random streams a draw, ordered pairs by runs, draws of two scores together."""

import numpy as np
import pandas as pd
import pytest

from sigevents.operators import calibration, resampling


def test_streams_do_not_grow_with_clusters(monkeypatch):
    """A block of draws seeds a random stream for a run of clusters, not for each of them."""
    made, seeded = [], np.random.SeedSequence
    monkeypatch.setattr(np.random, "SeedSequence", lambda key: made.append(key) or seeded(key))
    counts = resampling.drawn(np.arange(50_000), 50_000, 0, 10, 3)
    assert (counts.sum(1) == 50_000).all() and len(made) < 50_000 / 50


@pytest.mark.parametrize(("rows", "digits", "most"), [(5, 1, 2), (3000, 1, 2), (3000, 2, 3), (5000, 0, 2), (9000, -1, 2), (20_000, 3, 2), (20_000, 9, 2), (1, 2, 2)])
def test_ordered_pairs(rows, digits, most):
    """Strips and runs give every draw's ordered pairs, also where scores and runs are longer than a strip."""
    r = np.random.default_rng(rows)
    p = np.round(r.random(rows), digits)
    pos = r.integers(0, most, rows) * (p > 0.4 if digits == 9 else 1.0)
    neg, where, w = np.where(r.random(rows) < 0.8, 1.0 - (pos > 0), pos), r.integers(0, 50, rows), r.poisson(1, (50, 7)).astype(np.uint8)
    above, below, pairs = calibration._Ordered(p, pos, neg, where).pairs(w)
    q, i = np.unique(p, return_inverse=True)
    for d in range(7):
        x, y = (np.bincount(i, v * w[where, d], len(q)) for v in (pos, neg))
        assert above[d] == x.sum() and below[d] == y.sum() and pairs[d] == (y * (x.sum() - np.cumsum(x) + x / 2)).sum()


def test_two_scores_of_a_draw(spark):
    """Both scores' areas, found in one pass, are those of each alone."""
    r = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": r.random(2000), "b": np.round(r.random(2000), 1), "label": r.integers(0, 2, 2000), "g": r.integers(0, 60, 2000)}))
    both = calibration._auc_draws(df, "g", 30, 1, ["a", "b"], "label", 3, 400).toPandas()
    for i, c in enumerate("ab"):
        alone = calibration.auc_draws(df, "g", 30, 1, c).toPandas().sort_values("draw").auc
        assert np.allclose(both[both.score == i].sort_values("draw").auc, alone, atol=1e-12)


def test_sums_of_draws(spark):
    """Sums over runs of clusters are those of plain resamples."""
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.arange(5000).repeat(2), "bin": np.tile([0, 1], 5000), "n": r.integers(1, 9, 10_000).astype(float)})
    df = spark.createDataFrame(pdf)
    got = calibration.summed_draws(df, "g", ["n"], ["bin"], 20, 4).toPandas().set_index(["bin", "draw"]).n
    order = resampling.ranked(df, "g", 4)[0].toPandas().set_index("g")["rank"]
    w = resampling.drawn(np.arange(5000), 5000, 0, 20, 4)[:, order.loc[pdf.g]]
    assert all(got[b, d] == (w[d] * pdf.n)[pdf.bin == b].sum() for b in (0, 1) for d in range(20))
