"""Exact likelihoods of autoregressions against the dense covariance of the whole history."""

import numpy as np
import pytest

from tidemark.operators import forecasting as f


def series(n, phi, seed=3):
    rng = np.random.default_rng(seed)
    y = np.zeros(n + 200)
    for t in range(len(phi), len(y)):
        y[t] = 0.4 + np.dot(phi, y[t - len(phi) : t][::-1]) + rng.normal()
    return y[200:]


def dense(y, mean, phi, variance):
    """Log density of the history from its covariance matrix, whose entries come from the moving-average weights."""
    psi = np.zeros(4000)
    psi[0] = 1
    for j in range(1, len(psi)):
        psi[j] = sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
    n = len(y)
    cov = variance * np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
    matrix = cov[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    z = y - mean
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(matrix)[1] + z @ np.linalg.solve(matrix, z))


@pytest.mark.parametrize("phi", [(0.9,), (0.5, 0.3), (0.6, -0.4, 0.2)])
def test_likelihood_is_that_of_the_dense_covariance_and_the_greatest(phi):
    y = series(120, phi)
    mean, found, variance, level = f.ExactAR(f.ExpandingAR(y, len(phi)), len(phi)).fit(119)
    assert abs(dense(y, mean, found, variance) - level) < 1e-6
    rng = np.random.default_rng(1)
    for _ in range(30):
        other = found + rng.normal(scale=0.02, size=len(found)), mean + rng.normal(scale=0.05), variance * np.exp(rng.normal(scale=0.05))
        assert dense(y, other[1], other[0], other[2]) <= level + 1e-7


def test_partial_autocorrelations_go_back_and_forth():
    r = np.array([0.7, -0.3, 0.5, 0.1])
    assert np.allclose(f.partial_of(f.of_partial(r)), r)


def test_a_warm_search_ends_where_a_cold_one_ends():
    y = series(300, (0.8,))
    warm = f.ExactAR(f.ExpandingAR(y, 1), 1)
    for t in (99, 199, 299):
        at = warm.fit(t)
    cold = f.ExactAR(f.ExpandingAR(y, 1), 1).fit(299)
    assert np.allclose(at[1], cold[1], atol=1e-5) and abs(at[3] - cold[3]) < 1e-8


def test_forecasts_revert_to_the_mean():
    y = series(400, (0.5, 0.3))
    ar = f.ExactAR(f.ExpandingAR(y, 2), 2)
    mean, phi, _, _ = ar.fit(399)
    ahead = ar.forecast(399, 200)
    assert np.isclose(ahead[0], mean + phi @ (y[[399, 398]] - mean)) and np.isclose(ahead[-1], mean, atol=1e-3)


def test_frames(spark):
    import datetime

    start = datetime.date(2020, 1, 1)
    p = f.inv_logit(series(300, (0.9,)))
    rows = [("a", start + datetime.timedelta(i), float(x)) for i, x in enumerate(p)] + [("flat", start + datetime.timedelta(i), 0.5) for i in range(60)] + [("short", start, 0.25)]
    probs = spark.createDataFrame(rows, "series string, dt date, p_1 double")
    fits = {r["series"]: r for r in f.fit_logit(probs).collect()}
    assert abs(fits["a"]["coefficients"][0] - 0.9) < 0.1 and "short" not in fits
    ahead = {(r["series"], r["h"]): r["p_hat"] for r in f.logit_forecast(probs, 3).collect()}
    assert ahead["short", 3] == 0.25 and abs(ahead["flat", 2] - 0.5) < 1e-9 and 0 < ahead["a", 1] < 1
    exact = f.snail_trail(probs.filter("series = 'a'"), 3, 20, 250, exact=True).collect()
    plain = {(r["origin_dt"], r["h"]): r["p_hat"] for r in f.snail_trail(probs.filter("series = 'a'"), 3, 20, 250).collect()}
    assert len(exact) == 9 and all(abs(plain[r["origin_dt"], r["h"]] - r["p_hat"]) < 0.05 for r in exact)
