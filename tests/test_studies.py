"""Studies, reports and out-of-sample paths against published rows and daily loops."""

import numpy as np
import pandas as pd
import pytest
from dataclasses import replace
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, forecasting, mixture, portfolios, regimes, studies
from tidemark.plans import kernels, relational, reports

from .test_kernels import CFG, days, fits, long_returns  # noqa: F401

# The published summary of ten tiers, and its breaking points.
SUMMARY = [
    (0, 6, "core", 215.35728542844544, None, None, None, 0), (1, 7, "us_equities", 202.49574353518895, 0.0, None, None, 0), (2, 8, "eu_equities", 202.56568552523612, 0.0, None, None, 0),
    (3, 9, "em_equities", 218.34005188411732, 0.8301886792452831, 0.9535742994807003, 0.8681217802317892, 9), (4, 10, "gov_long", 215.35773635231376, 0.0, None, None, 0), (5, 11, "gov_short", 218.7921375600312, 1.0, 0.9939428309852669, 0.9939428309852669, 0),
    (6, 12, "inflation_linked", 204.1938508025136, 0.96, 0.9753774236035676, 0.6719003125346276, 3), (7, 13, "em_debt", 165.25724188452944, 1.0, 0.9764573939212842, 0.9753298908700028, 0), (8, 14, "real_estate", 188.83865588328592, 0.88, 0.896741422582256, 0.7933086796918101, 6),
    (9, 15, "energy", 186.85437611844478, 0.82, 0.9141275976614301, 0.8262724782752744, 9),
]
BREAKING = {1: "K_match=0%", 2: "K_match=0%", 3: "unstable_wins=9", 4: "K_match=0%", 6: "low_corr=0.67, unstable_wins=3", 8: "unstable_wins=6", 9: "unstable_wins=9"}


def test_published_breaking_points(spark):
    t = spark.createDataFrame(SUMMARY, "tier int, n_assets int, added_asset string, Neff_min_mean double, K_match_rate double, prob_corr_mean double, prob_corr_min double, n_unstable_windows int")
    got = studies.breaking_points(t)
    assert got.columns == ["tier", "added_asset", "n_assets", "reasons", "K_match_rate", "prob_corr_mean", "n_unstable_windows"]
    assert {r["tier"]: r["reasons"] for r in got.collect()} == BREAKING


def test_growing_universe(spark, long_returns):  # noqa: F811
    returns, _ = long_returns
    assert studies.tier_assets(("a",), ("b", "zz", "a", "c"), ("a", "b", "c")) == [(0, ("a",)), (1, ("a", "b")), (4, ("a", "b", "c"))]
    got = studies.run_tiers(returns, ("a0", "a1"), ("absent", "a1", "a2"), replace(CFG, k_candidates=(2,)))
    assert {r["config_id"] for r in got.select("config_id").distinct().collect()} == {"tier_0", "tier_3"}
    assert {r["d"] for r in got.filter("config_id = 'tier_3'").select(F.size(F.col("means")[0]).alias("d")).collect()} == {3}


def test_configurations_do_not_mix(days):  # noqa: F811
    two = [replace(CFG, k_candidates=(2,), config_id="x"), replace(CFG, k_candidates=(2,), config_id="y", window=300)]
    both = mixture.fit_rolling(days, two).persist()
    rows = {(r["config_id"], r["t"], r["k"]): r["p"] for r in mixture.filtered_probabilities(days, both).collect()}
    drift = {r["config_id"]: r["mean_drift"] for r in mixture.mean_drift(both).collect()}
    named = {r["config_id"]: r["n"] for r in mixture.aligned_names(both).groupBy("config_id").agg(F.count("*").alias("n")).collect()}
    back = {(r["config_id"], r["t"], r["k"]): r["p"] for r in regimes.retrospective(mixture.window_probabilities(days, both)).collect()}
    for c in two:
        own = mixture.fit_rolling(days, [c])
        want = {(c.config_id, r["t"], r["k"]): r["p"] for r in mixture.filtered_probabilities(days, own).collect()}
        mean = {(c.config_id, r["t"], r["k"]): r["p"] for r in regimes.retrospective(mixture.window_probabilities(days, own)).collect()}
        for got, other in ((rows, want), (back, mean)):
            mine = {k: v for k, v in got.items() if k[0] == c.config_id}
            assert mine.keys() == other.keys() and all(abs(mine[k] - other[k]) < 1e-12 for k in mine)
        assert abs(drift[c.config_id] - mixture.mean_drift(own).first()["mean_drift"]) < 1e-12 and named[c.config_id] == own.count()
    assert mixture.covariance_diagnostics(both).count() == 2
    both.unpersist()


def test_pooled_and_implied_moments(spark, days, fits):  # noqa: F811
    rows = fits.orderBy("w").collect()
    last = rows[-1]["K"]
    got = {(r["k"], r["i"], r["j"]): r for r in mixture.pooled_fits(fits).collect()}
    assert {k for k, _, _ in got} == set(range(last))
    weight = [sum(r["weights"][k] for r in rows if r["K"] > k) for k in range(last)]
    for (k, i, j), r in got.items():
        assert np.isclose(r["cov"], sum(x["covs"][k][i][j] for x in rows if x["K"] > k) / len(rows)) and np.isclose(r["mean_i"], sum(x["means"][k][i] for x in rows if x["K"] > k) / len(rows)) and np.isclose(r["long_run"], weight[k] / sum(weight))
    m = mixture.implied_moments(fits, ["a", "b", "c"]).filter("w = 0 and asset = 'b'").collect()
    assert all(np.isclose(r["mean"], rows[0]["means"][r["regime"]][1]) and np.isclose(r["vol"] ** 2, rows[0]["covs"][r["regime"]][1][1]) and np.isclose(r["weight"], rows[0]["neff"][r["regime"]] / 250) for r in m) and len(m) == rows[0]["K"]


@pytest.mark.parametrize("blend", [True, False])
def test_out_of_sample_equals_a_daily_loop(spark, long_returns, blend):  # noqa: F811
    returns, labels = long_returns
    p1 = labels.select("dt", (0.2 + 0.6 * F.col("regime") + 0.1 * (F.dayofmonth("dt") % 2)).alias("p_1")).filter("dayofmonth(dt) <> 17")
    probs = p1.select("dt", F.posexplode(F.array(1 - F.col("p_1"), "p_1")).alias("k", "p"))
    x = returns.toPandas().pivot(index="dt", columns="asset", values="r").sort_index()
    p = p1.toPandas().set_index("dt")["p_1"]
    first, every = 300, 50
    held = {n: np.full(3, 1 / 3) for n in ("unconditional", "regime_aware", "strategic")}
    before = {}
    want = {}
    for t in range(first, len(x)):
        dt = x.index[t]
        if (t - first) % every == 0:
            past = x.iloc[:t].to_numpy()
            held["unconditional"] = portfolios.solve(past.mean(0) * 248.48, np.cov(past.T) * 248.48)
            seen = p[p.index < dt]
            rows = x.loc[seen.index].to_numpy()
            weights = [1 - seen.to_numpy(), seen.to_numpy()]
            states = [portfolios.solve(np.average(rows, axis=0, weights=w) * 248.48, np.cov(rows.T, aweights=w) * 248.48) for w in weights]
            states = [np.full(3, 1 / 3) if s is None else s for s in states]
            mix = sum(w.mean() * s for w, s in zip(weights, states))
            held["strategic"] = mix / mix.sum()
        if dt in p.index:
            q = (1 - p[dt], p[dt]) if blend else ((1, 0) if 1 - p[dt] >= p[dt] else (0, 1))
            held["regime_aware"] = q[0] * states[0] + q[1] * states[1]
        for n, w in held.items():
            gross = np.log(w @ np.exp(x.iloc[t].to_numpy()) / w.sum())
            want[n, dt] = gross, np.abs(w - before.get(n, w)).sum()
            before[n] = w
    got = portfolios.backtest_out_of_sample(returns, probs, first, every, blend=blend).collect()
    assert len(got) == len(want)
    for r in got:
        gross, turnover = want[r["strategy"], r["dt"]]
        assert abs(r["gross"] - gross) < 1e-6 and abs(r["turnover"] - turnover) < 1e-4 and np.isclose(r["net"], r["gross"] - 0.0005 * r["turnover"])


def test_blocks_of_the_stationary_bootstrap():
    rng = np.random.default_rng(0)
    for n, block in ((1, 3), (50, 1), (2000, 20), (30, 500)):
        at = bootstrap.stationary_indices(n, block, rng)
        assert at.shape == (n,) and at.min() >= 0 and at.max() < n
    at = bootstrap.stationary_indices(200_000, 20, rng)
    assert abs((np.diff(at) % 200_000 != 1).mean() - 1 / 20) < 0.003 and abs(np.bincount(at // 2000, minlength=100).std() / 2000) < 0.2
    assert len(bootstrap.block_indices(103, 10, rng)) == 100 and bootstrap.block_indices(103, 10, rng).max() < 103


def test_tables_without_bootstraps_collect_no_series(spark, long_returns, monkeypatch):  # noqa: F811
    s = regimes.labelled(*long_returns).persist()
    whole = studies.paper_tables(s, b=2)
    want = {k: sorted(map(str, whole[k].collect())) for k in ("paper_omnibus_fmt", "paper_profiles_raw")}
    monkeypatch.setattr(bootstrap, "_labelled", lambda sample: pytest.fail("a series came to the driver"))
    for module in (kernels, reports):
        monkeypatch.setattr(module, "sample", lambda spark, folder: s)
    assert sorted(map(str, kernels.QUERIES["paper_omnibus_fmt"](spark, "").collect())) == want["paper_omnibus_fmt"]
    low, high = regimes.select_pair(s).first()
    assert sorted(map(str, studies.paper_profiles(s, low, high)[0].collect())) == want["paper_profiles_raw"]
    assert relational.QUERIES["paper_profiles_raw"](spark, "").count() == 3 and relational.QUERIES["paper_comparison_deltas"](spark, "").count() == 3


def test_reports(spark, long_returns):  # noqa: F811
    returns, labels = long_returns
    s = regimes.labelled(returns, labels)
    t = studies.all_tests(s, "realised_vol", b=50)
    assert t["meta_selected_pair"].first()["regime_high"] == 1 and {r["asset"] for r in t["paper_profiles_fmt"].collect()} == {"a0", "a1", "a2"}
    row = t["paper_comparison_fmt"].filter("asset = 'a1'").first()
    assert row["KS_p_value"] == "<0.001" and float(row["delta_vol_R1-R0"]) > 0 and row["Q5_p"] in ("<0.001", "0.000")
    assert t["paper_omnibus_raw"].filter("BF_p_value < 1e-6").count() == 3
    few = s.filter("regime = 0 or asset = 'a0'")
    assert {r["asset"]: r["R1_n"] for r in studies.paper_tables(few, b=10)["paper_profiles_fmt"].collect()}["a1"] == ""
    paths = returns.select(F.when(F.col("asset") == "a0", "Unconditional").otherwise(F.col("asset")).alias("strategy"), "dt", F.col("r").alias("net"))
    report = portfolios.risk_report(paths, 50)
    assert {r["comparison"] for r in report["cvar_tests"].collect()} == {"a1 vs Unconditional", "a2 vs Unconditional"} and "Best Sharpe ratio" in report["summary"]


def test_walk_forward_against_the_last_value(spark):
    rng = np.random.default_rng(3)
    y = np.zeros(420)
    for i in range(1, 420):
        y[i] = 0.5 * y[i - 1] + rng.normal()
    dates = pd.date_range("2015-01-01", periods=420).date
    probs = spark.createDataFrame([(d, float(1 / (1 + np.exp(-v)))) for d, v in zip(dates, y)], "dt date, p_1 double")
    details, summary = forecasting.against_random_walk(probs, min_train=200)
    rows, s = details.collect(), summary.first()
    assert s["n_forecasts"] == len(rows) == 219 and np.isclose(s["brier_ar"], np.mean([r["brier_ar"] for r in rows])) and s["modal_ar_order"] in range(1, 6)
    assert np.isclose(s["brier_skill_vs_rw"], 1 - s["brier_ar"] / s["brier_rw"]) and np.isclose(np.sign(s["dm_stat_squared"]), np.sign(np.mean([r["error_ar"] ** 2 - r["error_rw"] ** 2 for r in rows])))
