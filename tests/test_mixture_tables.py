"""Fits as aggregations and starts as rows against the fit of one window in memory."""

from dataclasses import replace

import numpy as np
import pytest

from tidemark.operators import mixture, mixture_tables


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(1)
    return np.r_[rng.normal(0, 1, (300, 3)), rng.normal([3, 0, -3], 2, (200, 3))] + [100.0, 0, 0]


@pytest.fixture(scope="module")
def days(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t int, x array<double>").repartition(5)


@pytest.mark.parametrize("cfg", [mixture.HEADLINE, replace(mixture.HEADLINE, regularise=False, max_iter=7, order="weight"), replace(mixture.HEADLINE, max_iter=1, kappa=0.5)])
def test_rounds_are_those_of_one_task(days, x, cfg):
    start = mixture.from_labels(x, (np.arange(len(x)) % 7 > 3).astype(int) + (x[:, 0] > 102), 3)
    want, got = mixture.fit_em(x, start, cfg), mixture_tables.fit_em_table(days, start, cfg)
    assert got.n_iter == want.n_iter and got.converged == want.converged and np.allclose(got.history, want.history, atol=1e-9)
    assert np.allclose(got.means, want.means, atol=1e-7) and np.allclose(got.covs, want.covs, atol=1e-7) and np.allclose(got.weights, want.weights, atol=1e-9)


@pytest.mark.parametrize("init", ["kmeans", "random"])
def test_starts_side_by_side_choose_as_one_by_one(days, x, init):
    cfg = replace(mixture.HEADLINE, max_iter=15)
    best, grid = mixture.select_by_bic(x, (2, 3), cfg, 3, init)
    fits = mixture_tables.fit_starts(days, (2, 3, 900), cfg, 3, init)
    rows = {r["k"]: r for r in mixture_tables.best_of_starts(fits).collect()}
    assert fits.count() == 6 and {k: r["bic"] for k, r in rows.items()} == pytest.approx(grid)
    chosen = [r for r in rows.values() if r["selected"]]
    assert len(chosen) == 1 and np.allclose(chosen[0]["means"], best.means, atol=1e-8) and np.allclose(chosen[0]["covs"], best.covs, atol=1e-8)
