"""Moving averages, differences and means against the dense covariance of the whole history, and the frames on them."""

import datetime

import numpy as np
import pytest

from tidemark.functions.arma import ARIMA, innovations, least_of_each, of_partial, partial_of
from tidemark.operators import arima
from tidemark.operators import forecasting as f


def weights(phi, theta, m=4000):
    """The first moving-average weights of a process."""
    psi = np.zeros(m)
    for k in range(m):
        psi[k] = (1 if k == 0 else theta[k - 1] if k <= len(theta) else 0) + sum(phi[i] * psi[k - 1 - i] for i in range(min(len(phi), k)))
    return psi


def dense(z, phi, theta, has_mean):
    """(mean, variance, log likelihood) from the covariance matrix of all days."""
    psi, n = weights(phi, theta), len(z)
    matrix = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    one = np.ones(n)
    mean = one @ np.linalg.solve(matrix, z) / (one @ np.linalg.solve(matrix, one)) if has_mean else 0.0
    x = z - mean
    variance = x @ np.linalg.solve(matrix, x) / n
    return mean, variance, -n / 2 * (np.log(2 * np.pi * variance) + 1) - np.linalg.slogdet(matrix)[1] / 2


def simulated(phi, theta, n, seed=1, mean=0.0):
    e = np.random.default_rng(seed).normal(size=n + 300)
    z = np.zeros(n + 300)
    for t in range(5, len(z)):
        z[t] = e[t] + sum(a * z[t - 1 - i] for i, a in enumerate(phi)) + sum(b * e[t - 1 - i] for i, b in enumerate(theta))
    return mean + z[300:]


ORDERS = [(1, 0, 0), (2, 0, 1), (0, 0, 2), (1, 1, 1), (0, 1, 1), (3, 0, 0), (0, 0, 0), (1, 2, 2), (2, 1, 3)]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("n", [25, 150])
def test_likelihood_is_that_of_the_dense_covariance(order, n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n) + 3
    for _ in range(order[1]):
        y = np.cumsum(y)
    m = ARIMA(y, *order)
    u = rng.normal(size=(4, order[0] + order[2])) * 0.7
    phi, theta = m.coefficients(u)
    for a, b, *got in zip(phi, theta, *m.profile(phi, theta)):
        assert np.allclose(got, dense(m.z, a, b, order[1] == 0), rtol=1e-9, atol=1e-8)


def test_settled_recursion_is_the_whole_one():
    z = simulated((0.7,), (0.4, 0.2), 400)[:, None]
    for phi, theta in (((0.7,), (0.4, 0.2)), ((0.99,), (-0.95,)), ((), (0.999,))):
        short = innovations(z, np.array([phi]), np.array([theta]))
        whole = innovations(z, np.array([phi]), np.array([theta]), to_end=True)
        assert np.allclose(short[0], whole[0], atol=1e-9) and np.allclose(short[1], whole[1], atol=1e-12)


@pytest.mark.parametrize("order, phi, theta", [((1, 0, 1), (0.8,), (0.5,)), ((0, 1, 1), (), (-0.6,)), ((2, 0, 0), (0.5, 0.3), ()), ((1, 1, 1), (0.5,), (0.4,))])
def test_fit_is_the_greatest_and_near_the_truth(order, phi, theta):
    y = simulated(phi, theta, 1500, mean=2.0)
    for _ in range(order[1]):
        y = np.cumsum(y - 2.0)
    m = ARIMA(y, *order).fit()
    assert np.allclose(m.phi, phi, atol=0.08) and np.allclose(m.theta, theta, atol=0.08) and abs(m.variance - 1) < 0.1
    rng = np.random.default_rng(2)
    others = m.profile(*m.coefficients(m.u + rng.normal(scale=0.02, size=(40, len(m.u)))))[2]
    assert (others <= m.level + 1e-7).all()


def test_forecast_is_the_conditional_mean():
    y = simulated((0.6,), (0.5,), 60, mean=1.5)
    m = ARIMA(y, 1, 0, 1).fit()
    psi = weights(m.phi, m.theta)
    g = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(70)])
    matrix = g[np.abs(np.subtract.outer(np.arange(60), np.arange(60)))]
    want = [m.mean + g[60 + h - np.arange(60)] @ np.linalg.solve(matrix, y - m.mean) for h in range(3)]
    assert np.allclose(m.forecast(3), want, atol=1e-9)
    walk = ARIMA(np.cumsum(y), 1, 1, 1)
    walk.fit()
    step = ARIMA(y[1:], 1, 0, 1)
    step.mean, step.phi, step.theta = 0.0, walk.phi, walk.theta
    assert np.allclose(walk.forecast(4), np.cumsum(y)[-1] + np.cumsum(step.forecast(4)))


def test_flat_and_short_series_raise():
    for y in (np.ones(50), np.arange(3.0)):
        with pytest.raises(np.linalg.LinAlgError):
            ARIMA(y, 1, 0, 1)


def test_partial_autocorrelations_of_rows():
    r = np.array([[0.7, -0.3, 0.5], [0.1, 0.2, -0.9]])
    assert np.allclose([partial_of(x) for x in of_partial(r)], r)


def test_minima_side_by_side():
    at = np.array([[1.0, 2.0], [-3.0, 0.5], [0.0, 0.0]])
    f_ = lambda which, x: ((x - at[which, None]) ** 2 * np.array([1.0, 30.0])).sum(-1) + ((x - at[which, None]) ** 4).sum(-1)
    assert np.allclose(least_of_each(f_, np.zeros((3, 2))), at, atol=1e-6)


@pytest.mark.parametrize("p", [1, 2, 4])
def test_many_histories_are_fitted_as_one_by_one(p):
    y = np.cumsum(simulated((0.5,), (), 500)) * 0.1
    sums = f.ExpandingAR(y, p)
    many = f.ExactARs(sums, p, np.array([60, 200, 499]))
    for i, t in enumerate((60, 200, 499)):
        one = f.ExactAR(sums, p)
        mean, phi, variance, level = one.fit(t)
        assert np.allclose(many.phi[i], phi, atol=1e-5) and np.isclose(many.level[i], level, atol=1e-7) and np.isclose(many.variance[i], variance, rtol=1e-5)
        assert np.allclose(many.forecast(4)[i], one.forecast(t, 4), atol=1e-4)
    flat = f.ExactARs(f.ExpandingAR(np.full(100, 0.3), p), p, np.array([50, 60]))
    assert not flat.good.any() and (flat.forecast(2) == 0.3).all()


@pytest.fixture(scope="module")
def probs(spark):
    start = datetime.date(2020, 1, 1)
    p = f.inv_logit(simulated((0.9,), (), 330, 7, 0.3))
    rows = [("a", start + datetime.timedelta(i), float(x)) for i, x in enumerate(p)] + [("flat", start + datetime.timedelta(i), 0.25) for i in range(290)] + [("short", start, 0.25)]
    return spark.createDataFrame(rows, "series string, dt date, p_1 double").repartition(3)


def test_frames_of_fits(probs):
    fits = arima.fit_arima(probs, ((1, 0, 0), (0, 1, 1), (2, 0, 1), (0, 0, 0)))
    rows = {(r["p"], r["d"], r["q"]): r for r in fits.collect()}
    assert len(rows) == 4 and {r["series"] for r in rows.values()} == {"a"}
    assert all(np.isclose(r["bic"] - r["aic"], (np.log(r["n"]) - 2) * (r["p"] + r["q"] + 1 + (r["d"] == 0))) for r in rows.values())
    one = f.fit_logit(probs.filter("series = 'a'")).first()
    assert np.isclose(rows[1, 0, 0]["log_likelihood"], one["log_likelihood"], atol=1e-6) and np.isclose(rows[1, 0, 0]["bic"], one["bic"], atol=1e-5)
    assert arima.best_arima(fits).first()["bic"] == min(r["bic"] for r in rows.values())
    ahead = {(r["series"], r["h"]): r["p_hat"] for r in arima.arima_forecast(probs, (0, 1, 1), 3).collect()}
    assert ahead["short", 2] == ahead["flat", 3] == 0.25 and ahead["a", 1] == ahead["a", 3]


def test_walk_forward_does_not_depend_on_stretches(probs):
    for max_lag in (None, 3):
        a, b = ({(r["series"], r["date_t"]): r for r in arima.walk_forward(probs, max_lag, stretches=k).collect()} for k in (1, 5))
        assert a.keys() == b.keys() and len(a) == 79 + 39
        assert all(a[k]["ar_order"] == b[k]["ar_order"] and np.isclose(a[k]["p_ar_t1"], b[k]["p_ar_t1"], atol=1e-6) for k in a)
        assert all(r["p_ar_t1"] == 0.25 for (s, _), r in a.items() if s == "flat")
    few = arima.walk_forward(probs.filter("series = 'a'"), None, (0, 1, 1), min_train=326).collect()
    y = f.logit(np.array([r["p_1"] for r in sorted(probs.filter("series = 'a'").collect(), key=lambda r: r["dt"])]))
    assert np.isclose(min(few, key=lambda r: r["date_t"])["p_ar_t1"], f.inv_logit(ARIMA(y[:327], 0, 1, 1).fit().forecast(1)[0]), atol=1e-9)
    details, means = arima.against_random_walk(probs.filter("series = 'a'"))
    assert means.first()["n_forecasts"] == details.count() == 79


def test_regime_aware_goes_on_from_each_states_last_day(probs):
    a = probs.filter("series = 'a'")
    rows = sorted(a.collect(), key=lambda r: r["dt"])
    p = np.array([r["p_1"] for r in rows])
    y, normal = f.logit(p), p > 0.5 if p.mean() > 0.5 else p <= 0.5
    got = {(r["origin_dt"], r["h"]): r for r in arima.regime_aware(a, 5, 20, 250).collect()}
    t = 270
    each = []
    for days in (normal, ~normal):
        z = y[: t + 1][days[: t + 1]]
        each.append(f.ExactAR(f.ExpandingAR(z, 1), 1).forecast(len(z) - 1, 5))
    share = p[t] if p.mean() > 0.5 else 1 - p[t]
    for h in range(5):
        r = got[rows[t]["dt"], h + 1]
        assert np.isclose(r["p_hat"], f.inv_logit(share * each[0][h] + (1 - share) * each[1][h]), atol=1e-5) and r["forecast_dt"] == rows[t + h + 1]["dt"]
    switched = {(r["origin_dt"], r["h"]): r for r in arima.regime_aware(a, 5, 20, 250, blend=False).collect()}
    r = switched[rows[t]["dt"], 2]
    assert np.isclose(r["p_hat"], f.inv_logit(each[0 if share >= 0.5 else 1][1]), atol=1e-5) and r["method"] == r["current_regime"] + "_ar"
    assert {r["method"] for r in arima.compare_methods(a, 5).collect()} == {"standard", "regime_blend", "regime_switch"}
    assert {r["p_hat"] for r in arima.regime_aware(probs.filter("series = 'flat'"), 5).collect()} == {0.25}
