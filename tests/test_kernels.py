"""Kernels against closed forms, plain loops, optimality conditions and the one-sided contract."""

import itertools
import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import assignment, quadratic, tails
from tidemark.operators import backtest, bootstrap, forecasting, inference, mixture, panel, portfolios, regimes, studies


def two_states(n=700, d=3, seed=0):
    rng = np.random.default_rng(seed)
    z = (np.arange(n) // 50) % 2
    return rng.normal(size=(n, d)) * np.where(z, 2.0, 0.5)[:, None] * 0.01, z


CFG = replace(mixture.HEADLINE, k_candidates=(2, 3), window=250, step=100)


@pytest.fixture(scope="module")
def days(spark):
    x, _ = two_states()
    dates = pd.date_range("2010-01-01", periods=len(x)).date
    return spark.createDataFrame([(i, dt, v.tolist()) for i, (dt, v) in enumerate(zip(dates, x))], "t long, dt date, x array<double>").persist()


@pytest.fixture(scope="module")
def fits(days):
    return mixture.fit_rolling(days, [CFG]).persist()


@pytest.fixture(scope="module")
def long_returns(spark):
    x, z = two_states()
    dates = pd.date_range("2010-01-01", periods=len(x)).date
    rows = [(dt, f"a{j}", float(v[j])) for dt, v in zip(dates, x) for j in range(3)]
    labels = [(dt, int(k)) for dt, k in zip(dates, z)]
    return spark.createDataFrame(rows, "dt date, asset string, r double").persist(), spark.createDataFrame(labels, "dt date, regime int").persist()


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (6, 4), (1, 1)])
def test_matching_is_least(shape):
    cost = np.random.default_rng(sum(shape)).random(shape)
    got = assignment.match(cost)
    small, large = min(shape), max(shape)
    c = cost if shape[0] <= shape[1] else cost.T
    assert np.isclose(sum(cost[a, b] for a, b in got), min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)))


def test_ward_finds_clusters_and_least_increase():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 0.1, (40, 2)) for m in (0, 5, 10)])
    labels = assignment.ward(x, 3)
    assert sorted(set(map(tuple, labels.reshape(3, 40).tolist()))) == sorted({(labels[i * 40],) * 40 for i in range(3)}) and len(set(labels)) == 3
    few = rng.normal(size=(9, 2))
    sets = [{i} for i in range(9)]
    while len(sets) > 4:
        def rise(a, b):
            return len(a) * len(b) / (len(a) + len(b)) * ((few[list(a)].mean(0) - few[list(b)].mean(0)) ** 2).sum()
        a, b = min(itertools.combinations(sets, 2), key=lambda p: rise(*p))
        sets = [s for s in sets if s not in (a, b)] + [a | b]
    got = assignment.ward(few, 4)
    assert sorted(map(sorted, sets)) == sorted(np.flatnonzero(got == k).tolist() for k in range(4))


def test_em_raises_the_posterior_and_orders_states():
    x, z = two_states()
    f = mixture.fit_em(x, mixture.from_labels(x, assignment.kmeans(x, 2), 2), replace(CFG, regularise=False))
    assert all(b >= a - 1e-4 for a, b in zip(f.history, f.history[1:]))
    assert np.trace(f.covs[0]) < np.trace(f.covs[1]) and np.isclose(f.weights.sum(), 1)
    assert ((f.resp[:, 1] > 0.5) == z).mean() > 0.85
    best, grid = mixture.select_by_bic(x, (1, 2, 3), replace(CFG, kappa=0.01), n_starts=2)
    assert len(best.weights) == 2 == max(grid, key=grid.get)


def test_folds(spark, days, fits):
    rows = fits.orderBy("w").collect()
    assert [(r["s"], r["e"]) for r in rows] == [(a, a + 249) for a in range(0, 451, 100)]
    assert rows[0]["prior_coverage"] == 0 and rows[1]["prior_coverage"] > 0 and rows[-1]["max_age"] > 1
    free = replace(CFG, target="grand_mean", ewma_decay=None, config_id="free")
    assert free.independent and mixture.fit_rolling(days, [free, replace(CFG, window=2000, config_id="long")]).select("config_id").distinct().collect()[0][0] == "free"


def test_one_sided_serving_has_no_look_ahead(spark, days, fits):
    p = mixture.filtered_probabilities(days, fits)
    got = p.groupBy("t", "dt").agg(F.sum("p").alias("s"), F.count_distinct("w").alias("n"), F.first("w").alias("w")).orderBy("t").collect()
    ends = [r["e"] for r in fits.orderBy("w").collect()]
    assert [r["t"] for r in got] == list(range(ends[0] + 1, 700))
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == 1 and r["w"] == max(i for i, e in enumerate(ends) if e < r["t"]) for r in got)
    cut = days.filter("t < 520")  # truncation: earlier days keep their values
    before = {(r["t"], r["k"]): r["p"] for r in p.filter("t < 520").collect()}
    after = {(r["t"], r["k"]): r["p"] for r in mixture.filtered_probabilities(cut, mixture.fit_rolling(cut, [CFG])).collect()}
    assert before.keys() == after.keys() and max(abs(before[k] - after[k]) for k in before) < 1e-12
    noisy = days.withColumn("x", F.when(F.col("t") >= 520, F.transform("x", lambda v: v * 10 + 0.1)).otherwise(F.col("x")))  # corruption of the future
    other = {(r["t"], r["k"]): r["p"] for r in mixture.filtered_probabilities(noisy, mixture.fit_rolling(noisy, [CFG])).filter("t < 520").collect()}
    assert max(abs(before[k] - other[k]) for k in before) < 1e-12
    names = {r["w"]: sorted(r["names"]) for r in mixture.aligned_names(fits).collect()}
    assert all(v == list(range(len(v))) for v in names.values())


def test_panel_shorter_than_a_window_or_as_long(days):
    short = days.filter("t < 250")
    fits = mixture.fit_rolling(short, [CFG])
    assert fits.count() == 1 and mixture.filtered_probabilities(short, fits).count() == 0
    assert regimes.estimation_windows(days.filter("t < 100"), 250, 63).count() == 0


def test_retrospective_sums_to_one(days, fits):
    r = regimes.retrospective(mixture.window_probabilities(days, fits)).groupBy("t").agg(F.sum("p").alias("s"))
    assert r.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0 and mixture.covariance_diagnostics(fits).first()["min_eigenvalue"] > 0


@pytest.mark.parametrize("seed", range(6))
def test_quadratic_programmes(seed):
    rng = np.random.default_rng(seed)
    n = 5
    a = rng.normal(size=(n, n))
    cov, mu = a @ a.T / n + 0.05 * np.eye(n), rng.normal(0.05, 0.05, n)
    high = 0.4
    w = quadratic.minimise(cov, high=high)
    grid = rng.dirichlet(np.ones(n), 20_000)
    grid = grid[(grid <= high).all(1)]
    assert np.isclose(w.sum(), 1) and (w >= -1e-9).all() and (w <= high + 1e-9).all()
    assert w @ cov @ w <= np.einsum("ij,jk,ik->i", grid, cov, grid).min() + 1e-9
    s = quadratic.max_sharpe(mu, cov, high=high)
    ratio = lambda v: v @ mu / np.sqrt(np.einsum("...i,ij,...j->...", v, cov, v))
    assert ratio(s) >= ratio(grid).max() - 1e-6 and np.isclose(s.sum(), 1)
    vol = float(np.sqrt(w @ cov @ w)) * 1.2
    t = quadratic.target_volatility(mu, cov, vol, high=high)
    ok = grid[np.sqrt(np.einsum("ij,jk,ik->i", grid, cov, grid)) <= vol]
    assert np.sqrt(t @ cov @ t) <= vol + 1e-9 and t @ mu >= (ok @ mu).max() - 1e-6
    assert quadratic.minimise(cov, high=0.1) is None and len(quadratic.frontier(mu, cov, 5)) == 5
    assert np.isclose(quadratic.live_max_sharpe(mu, cov).sum(), 1) and quadratic.live_max_sharpe(mu, cov).max() <= 0.4 + 1e-9


def test_tails_at_known_points():
    assert np.allclose(tails.betainc(5.0, 1.0, 0.3), 0.3**5) and np.allclose(tails.betainc(2.0, 3.0, 0.4), 0.5248)
    assert np.allclose(tails.gammaincc(1.0, np.array([0.5, 7.0])), np.exp([-0.5, -7.0])) and np.allclose(tails.gammaincc(0.5, 1.920729), 0.05, atol=1e-6)
    assert np.allclose(tails.kolmogorov_sf(np.array([1.3581, 0.05])), [0.05, 1.0], atol=1e-4)
    t = 2.228139  # two-sided 5 per cent at 10 degrees of freedom
    assert np.allclose(tails.betainc(5.0, 0.5, 10 / (10 + t * t)), 0.05, atol=1e-6)


def test_ar_equals_least_squares():
    rng = np.random.default_rng(2)
    y = np.zeros(200)
    for t in range(2, 200):
        y[t] = 0.1 + 0.5 * y[t - 1] + 0.2 * y[t - 2] + rng.normal()
    ar = forecasting.ExpandingAR(y, 4)
    for t, p in ((60, 1), (199, 3)):
        x = np.column_stack([np.ones(t + 1 - p), *(y[p - j : t + 1 - j] for j in range(1, p + 1))])
        want = np.linalg.lstsq(x, y[p : t + 1], rcond=None)[0]
        beta, rss, n = ar.fit(t, p)
        assert np.allclose(beta, want) and n == t + 1 - p and np.isclose(rss, ((y[p : t + 1] - x @ want) ** 2).sum())
    f = ar.forecast(199, 2, 3)
    b = ar.fit(199, 2)[0]
    assert np.isclose(f[1], b[0] + b[1] * f[0] + b[2] * y[199]) and ar.order(199) in (1, 2, 3)


def test_multi_horizon_forecasts_of_a_flat_series_fall_back(spark):
    dates = pd.date_range("2020-01-01", periods=120).date
    flat = spark.createDataFrame([(d, 0.3) for d in dates], "dt date, p_1 double")
    rows = forecasting.multi_horizon(flat, (1, 5), min_train=50).collect()
    assert len(rows) == (120 - 5 - 50) * 2 and all(abs(r["p_change_th"] - 0.3) < 1e-9 and abs(r["p_baseline_th"] - 0.3) < 1e-9 for r in rows)


def test_backtest_equals_a_daily_loop(long_returns):
    returns, labels = long_returns
    got = backtest.static_backtest(returns).orderBy("dt").collect()
    wide = returns.toPandas().pivot(index="dt", columns="asset", values="r").sort_index()
    month_ends = set(wide.groupby([pd.to_datetime(wide.index).year, pd.to_datetime(wide.index).month]).apply(lambda g: g.index[-1]))
    w = np.full(3, 1 / 3)
    for r, (dt, x) in zip(got, wide.iterrows()):
        v = w * np.exp(x.to_numpy())
        assert np.isclose(r["gross"], np.log(v.sum()), atol=1e-12)
        v /= v.sum()
        turnover = np.abs(1 / 3 - v).sum() / 2 if dt in month_ends else 0.0
        assert np.isclose(r["turnover"], turnover, atol=1e-12)
        w = np.full(3, 1 / 3) if dt in month_ends else v


def test_drawdown_starts_at_the_first_wealth(spark):
    dates = pd.date_range("2020-01-01", periods=4).date
    path = spark.createDataFrame([(d, r) for d, r in zip(dates, (-0.5, 0.1, -0.2, 0.05))], "dt date, net double")
    dd = backtest.drawdowns(path).orderBy("dt").collect()
    assert dd[0]["drawdown"] == 0 and backtest.longest_drawdown(backtest.drawdowns(path)).first()[0] == 2


def test_expanding_backtests(long_returns):
    returns, labels = long_returns
    two = labels.select("dt", F.posexplode(F.array(1 - F.col("regime"), "regime")).alias("k", "p")).withColumn("p", F.col("p").cast("double"))
    signal = labels.select("dt", F.col("regime").cast("double").alias("p_1"))
    for path in (portfolios.backtest_unconditional(returns, 100), portfolios.backtest_regimes(returns, two, signal, 100)):
        rows = path.collect()
        assert len(rows) == 700 and sum(r["turnover"] > 0 for r in rows) >= 15 and all(np.isclose(r["net"], r["gross"] - 0.0005 * r["turnover"]) for r in rows)
    out = portfolios.backtest_out_of_sample(returns, two, 200).groupBy("strategy").agg(F.count("*").alias("n"), F.max("turnover").alias("m")).collect()
    assert {(r["strategy"], r["n"]) for r in out} == {(s, 500) for s in ("strategic", "unconditional", "regime_aware")}
    w = portfolios.state_portfolios(regimes.labelled(returns, labels)).groupBy("k").agg(F.sum("w").alias("s")).collect()
    assert len(w) == 2 and all(abs(r["s"] - 1) < 1e-9 for r in w)


def test_bootstraps(spark, long_returns):
    returns, labels = long_returns
    rng = np.random.default_rng(0)
    at = bootstrap.stationary_indices(1000, 20, rng)
    assert at.shape == (1000,) and at.max() < 1000 and 0.9 < (np.diff(at) % 1000 == 1).mean() < 0.99
    s = regimes.labelled(returns, labels)
    a = bootstrap.correlation_differences(s, 0, 1, b=100).orderBy("name").collect()
    b = bootstrap.correlation_differences(s.repartition(7), 0, 1, b=100).orderBy("name").collect()
    assert a == b and len(a) == 4 and all(0 <= r["p_value"] <= 1 for r in a)
    q = bootstrap.quantile_equality(s, (0.05,), 200).collect()
    assert len(q) == 3 and all(r["p_value"] < 0.05 for r in q)  # the states differ in volatility
    paths = returns.select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net"))
    for kind in ("sharpe", "drawdown", "cvar"):
        r = bootstrap.path_difference(paths, "a0", "a1", kind, 200).first()
        assert np.isclose(r["diff"], r["value_a"] - r["value_b"]) and 0 <= r["p_value"] <= 1
    assert all(r["p_approx"] == 0.001 for r in bootstrap.anderson_darling(s).collect())


def test_tests_reject_different_variances_only(long_returns):
    returns, labels = long_returns
    s = regimes.labelled(returns, labels)
    assert all(r["p_value"] < 1e-6 for r in inference.brown_forsythe(s).collect())
    assert all(r["p_value"] > 1e-4 for r in inference.anova(s).collect())
    assert all(r["p_value"] < 1e-6 for r in inference.kolmogorov(s).collect()) and inference.pair_brown_forsythe(s).count() == 3
    few = s.filter("regime = 0 or dt < '2010-03-01'")
    assert inference.kruskal(few).count() == 0  # one state has too few days


def test_adjusted_p_values(spark):
    # Published p of fifteen tests, and the adjusted values of the third and fourth.
    p = [0.0, 0.0014, 0.008, 0.0088, 0.019, 0.118, 0.1384, 0.1872, 0.249, 0.3128, 0.356, 0.4014, 0.508, 0.9416, 0.9514]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "id int, p_value double")
    q = {r["id"]: r["q_value"] for r in inference.benjamini_hochberg(rows).collect()}
    assert np.allclose([q[i] for i in range(4)], [0.0, 0.0105, 0.033, 0.033]) and 15 not in q
    assert np.allclose([q[i] for i in range(15)], [min(1, min(p[j] * 15 / (j + 1) for j in range(i, 15))) for i in range(15)])


def test_many_adjusted_p_values(spark):
    # Work in proportion to the rows (a frame up to the last row is read anew for every row), of all sizes, with ties and keys.
    n = 100_000
    value = F.when(F.col("id") % 50 == 0, 0.0).when(F.col("id") % 50 == 1, 1.0).otherwise(F.pow((F.col("id") * 7919 % 99_991 + 1) / 99_991.0, F.lit(3)))
    rows = spark.range(n).select("id", F.when(F.col("id") >= 100, F.lit("a")).alias("g"), value.alias("p_value"))
    since = time.monotonic()
    got = inference.benjamini_hochberg(rows, keep=("g",)).toPandas()
    assert time.monotonic() - since < 60 and list(got.columns) == ["id", "g", "p_value", "q_value"] and sorted(got["id"]) == list(range(n))
    for _, mine in got.groupby("g", dropna=False):
        mine = mine.sort_values("p_value")
        x = mine["p_value"].to_numpy() * len(mine) / np.arange(1, len(mine) + 1)
        assert (mine["q_value"].to_numpy() == np.minimum(np.minimum.accumulate(x[::-1])[::-1], 1)).all()


def test_synchronous_days(spark):
    rows = [("2020-01-01", "x", 0.1), ("2020-01-01", "cash", 0.0), ("2020-01-02", "x", 0.0), ("2020-01-02", "cash", 0.1), ("2020-01-03", "x", float("nan")), ("2020-01-03", "cash", 0.1)]
    r = spark.createDataFrame(rows, "dt string, asset string, r double").withColumn("dt", F.to_date("dt"))
    assert [str(x["dt"]) for x in panel.synchronous(r).select("dt").distinct().collect()] == ["2020-01-01"]
    with pytest.raises(Exception, match="exempt"):
        panel.synchronous(r.filter("asset = 'cash'")).collect()


def test_wide_prices(spark):
    raw = spark.createDataFrame([("2020-01-01", "1.5", "x", "9"), ("bad", "2", "3", "9"), ("2020-01-02", None, "4", "9")], "date string, T1 string, T2 string, `Unnamed: 3` string")
    master = spark.createDataFrame([("T1", "one"), ("T2", "two"), ("T3", "three")], "bbg_ticker string, name string")
    got = sorted((str(r["dt"]), r["asset"], r["px"]) for r in panel.clean_wide(raw, master).collect())
    assert got == [("2020-01-01", "one", 1.5), ("2020-01-01", "two", None), ("2020-01-02", "one", None), ("2020-01-02", "two", 4.0)] or len(got) == 4


def test_tiers(spark, days, fits):
    p = mixture.window_probabilities(days, fits)
    k = fits.select("w", "end_dt", F.col("K").alias("k_selected"))
    same = studies.compare_tiers(p, p, k, k).first()
    assert same["k_match_rate"] == 1 and same["n_common_windows"] == 5 and same["unstable_windows"] == 0 and abs(same["mean_corr"] - 1) < 1e-9
    none = studies.compare_tiers(p, p, k, k.withColumn("end_dt", F.date_add("end_dt", 5000))).first()
    assert none["n_common_windows"] == 0 and none["k_match_rate"] is None


def test_mixture_queries_run_the_whole_specifications(spark):
    from tidemark.plans import kernels

    sf = "/root/testdata/sf0.01"
    n = len(mixture.window_bounds(kernels._days(spark, sf).count(), 1250, 63))
    bic = [tuple(r) for r in kernels.bic_grid(spark, sf).select("config_id", "w", "k").collect()]
    assert sorted(bic) == sorted([("headline", w, k) for w in range(n) for k in range(2, 8)] + [("forecast", w, 2) for w in range(n)])
    for query in (kernels.filtered_probabilities, kernels.retrospective_probabilities):
        assert {r["config_id"] for r in query(spark, sf).select("config_id").distinct().collect()} == {"headline", "forecast"}
    summary = {r["config_id"]: r["n_windows"] for r in kernels.config_summary(spark, sf).collect()}
    assert set(summary) == {c.config_id for c in (*kernels.GRID, *mixture.ROBUSTNESS, *mixture.SHRINKAGE)} and summary["headline"] == n


def test_bootstrap_queries_take_the_default_replicates(spark, monkeypatch):
    import inspect

    from tidemark.plans import kernels

    taken = []
    for name, count in (("correlation_differences", "b"), ("path_difference", "n_bootstrap")):
        signature = inspect.signature(getattr(bootstrap, name))

        def record(*args, signature=signature, count=count, **named):
            bound = signature.bind(*args, **named)
            bound.apply_defaults()
            taken.append(bound.arguments[count])

        monkeypatch.setattr(bootstrap, name, record)
    monkeypatch.setattr(kernels, "sample", lambda s, d: None)
    monkeypatch.setattr(kernels, "returns", lambda s, d: _Frame())
    for name in ("bootstrap_corr", "bootstrap_sharpe", "bootstrap_drawdown", "bootstrap_cvar"):
        kernels.QUERIES[name](None, "")
    assert taken == [10_000] * 4


class _Frame:
    def select(self, *columns):
        return self
