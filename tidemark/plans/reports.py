"""Queries on reports, studies and small operators that DuckDB can check, beside those of :mod:`.relational`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import backtest, bootstrap, forecast_eval, panel, portfolios, regimes, studies
from ..sources.tables import table
from .relational import _BT, _COVER, _FC, _RET, _ST, _WM, _moments, _one_step, _r, path, query, returns, sample, states

_NAMES = {"A_F": "Alpha", "R_F": "Romeo", "N_O": "November"}
_SHOWN = "CASE {0} WHEN 'A_F' THEN 'Alpha' WHEN 'R_F' THEN 'Romeo' WHEN 'N_O' THEN 'November' ELSE {0} END"


@query("breaking_points", """WITH t AS (SELECT s_suppkey AS tier, 'a' || s_suppkey AS added_asset, s_suppkey + 5 AS n_assets, (s_suppkey % 10) / 10.0 AS km, 0.5 + (s_suppkey % 8) / 16.0 AS mean_corr, (s_suppkey % 7) / 8.0 AS min_corr, s_suppkey % 5 AS unstable, CAST(s_suppkey % 90 AS DOUBLE) AS neff FROM supplier),
r AS (SELECT tier, added_asset, n_assets, concat_ws(', ', CASE WHEN km < 0.8 THEN 'K_match=' || CAST(round(km * 100) AS BIGINT) || '%' END, CASE WHEN min_corr < 0.7 THEN 'low_corr=' || printf('%.2f', min_corr + 1e-9) END, CASE WHEN unstable > 2 THEN 'unstable_wins=' || unstable END, CASE WHEN neff < 50 THEN 'low_Neff=' || CAST(neff AS BIGINT) END) AS reasons,
km AS K_match_rate, mean_corr AS prob_corr_mean, unstable AS n_unstable_windows FROM t WHERE tier > (SELECT min(tier) FROM t)) SELECT tier, added_asset, n_assets, reasons, round(K_match_rate, 9) AS K_match_rate, round(prob_corr_mean, 9) AS prob_corr_mean, n_unstable_windows FROM r WHERE reasons <> ''""")
def _(s, d):
    k = F.col("s_suppkey")
    t = table(s, d, "supplier").select(k.alias("tier"), F.concat(F.lit("a"), k).alias("added_asset"), (k + 5).alias("n_assets"), (k % 10 / 10.0).alias("K_match_rate"), (0.5 + k % 8 / 16.0).alias("prob_corr_mean"), (k % 7 / 8.0).alias("prob_corr_min"), (k % 5).alias("n_unstable_windows"), (k % 90).cast("double").alias("Neff_min_mean"))
    return studies.breaking_points(t)


@query("difference_p_rules", """WITH b AS (SELECT c_nationkey AS g, c_acctbal - 4500 AS v FROM customer), d AS (SELECT *, CAST(g * 150 - 1500 AS DOUBLE) AS diff FROM b)
SELECT g, round(least(2 * CASE WHEN max(diff) >= 0 THEN avg(CAST(v <= 0 AS DOUBLE)) ELSE avg(CAST(v >= 0 AS DOUBLE)) END, 1.0), 9) AS p_sharpe, round(least(2 * least(avg(CAST(v >= abs(diff) AS DOUBLE)), avg(CAST(v <= -abs(diff) AS DOUBLE))), 1.0), 9) AS p_drawdown FROM d GROUP BY g""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") - 4500).alias("v"), (F.col("c_nationkey") * 150.0 - 1500).alias("diff"))
    groups = c.groupBy("g", "diff")  # one difference in a group
    return groups.agg(bootstrap.difference_p(F.col("v"), F.col("diff"), "sharpe").alias("p_sharpe"), bootstrap.difference_p(F.col("v"), F.col("diff"), "drawdown").alias("p_drawdown")).drop("diff")


@query("select_pair_ordered", f"WITH {_ST} SELECT min(regime) AS regime_low, max(regime) AS regime_high FROM smp")
def _(s, d):
    return regimes.select_pair(sample(s, d))


@query("select_pair_realised", f"WITH {_ST}, v AS (SELECT regime, avg(sd) AS v FROM (SELECT regime, asset, stddev_samp(r) AS sd, count(*) AS n FROM smp GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 50) SELECT arg_min(regime, v) AS regime_low, arg_max(regime, v) AS regime_high FROM v")
def _(s, d):
    return regimes.select_pair(sample(s, d), "realised_vol")


_PROF = """, lh AS (SELECT min(regime) AS lo, max(regime) AS hi FROM smp), pq AS (SELECT regime, asset, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS vol, quantile_cont(r, 0.05) AS q5, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.25) AS q25 FROM smp GROUP BY 1, 2 HAVING count(*) >= 50),
pe AS (SELECT pq.*, (SELECT avg(r) FROM smp WHERE smp.regime = pq.regime AND smp.asset = pq.asset AND r <= q5 + 1e-15) AS es FROM pq),
pf AS (SELECT coalesce(a.asset, b.asset) AS asset, {cells} FROM (SELECT * FROM pe WHERE regime = (SELECT lo FROM lh)) a FULL JOIN (SELECT * FROM pe WHERE regime = (SELECT hi FROM lh)) b ON a.asset = b.asset)"""
_CELLS = (("n", "n"), ("mean", "mean"), ("vol", "vol"), ("VaR5", "q5"), ("ES5", "es"), ("Q5", "q5"), ("Q10", "q10"), ("Q25", "q25"))
_RAW = _PROF.format(cells=", ".join(f"{t}.{c} AS R{k}_{n}" for t, k in (("a", 0), ("b", 2)) for n, c in _CELLS))


@query("paper_profiles_raw", f"WITH {_ST}{_RAW} SELECT asset, " + ", ".join(f"R{k}_n" if n == "n" else f"round(R{k}_{n}, 9) AS R{k}_{n}" for k in (0, 2) for n, _ in _CELLS) + " FROM pf")
def _(s, d):
    x = sample(s, d)
    return studies.paper_profiles(x, *regimes.select_pair(x).first())[0]


@query("paper_comparison_deltas", f"WITH {_ST}{_RAW} SELECT asset, " + ", ".join(f'round(R2_{n} - R0_{n}, 9) AS "delta_{n}_R2-R0"' for n, _ in _CELLS[1:]) + " FROM pf")
def _(s, d):
    x = sample(s, d)
    t = studies.paper_profiles(x, *regimes.select_pair(x).first())[1]
    return t.select("asset", *(c for c in t.columns if c.startswith("delta_")))


@query("compare_portfolios", f"""WITH {_BT}, s AS (SELECT unnest(['full', 'half']) AS strategy, unnest([1.0, 0.5]) AS f), x AS (SELECT strategy, dt, net * f AS r, turnover * f AS turnover, cost * f AS cost FROM bt, s)
SELECT strategy, round(power(exp(sum(r)), 248.48 / count(r)) - 1, 9) AS ann_return, round(stddev_samp(r) * power(248.48, 0.5), 9) AS ann_volatility, count(r) AS n_days, round(avg(turnover), 9) AS avg_turnover, round(sum(turnover), 9) AS total_turnover, round(sum(cost), 9) AS total_tc FROM x GROUP BY 1""")
def _(s, d):
    return backtest.compare_portfolios(_two_paths(s, d)).select("strategy", "ann_return", "ann_volatility", "n_days", "avg_turnover", "total_turnover", "total_tc")


@query("compare_out_of_sample", f"""WITH {_BT}, s AS (SELECT unnest(['full', 'half']) AS strategy, unnest([1.0, 0.5]) AS f), x AS (SELECT strategy, dt, net * f AS r, turnover * f AS turnover, cost * f AS cost FROM bt, s),
y AS (SELECT *, exp(sum(r) OVER (PARTITION BY strategy ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS we FROM x), z AS (SELECT *, we / max(we) OVER (PARTITION BY strategy ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM y),
q AS (SELECT strategy, quantile_cont(r, 0.05) AS q FROM x GROUP BY 1), t AS (SELECT x.strategy, -avg(r) AS cvar FROM x JOIN q ON x.strategy = q.strategy AND r <= q + 1e-15 GROUP BY 1),
a AS (SELECT strategy, avg(r) * 252 AS m, stddev_samp(r) * sqrt(252) AS v, -min(d) AS mdd, sqrt(avg(power(least(r, 0), 2))) * sqrt(252) AS dn, avg(turnover) AS tu, sum(cost) AS tc FROM z GROUP BY 1)
SELECT a.strategy, round(m, 6) AS ann_return, round(v, 6) AS ann_volatility, round(m / v, 6) AS sharpe_ratio, round(mdd, 6) AS max_drawdown, round(m / mdd, 6) AS calmar_ratio, round(cvar, 6) AS cvar_95, round(m / dn, 6) AS sortino_ratio, round(tu, 6) AS avg_turnover, round(tc, 6) AS total_tc FROM a JOIN t ON a.strategy = t.strategy""", 6)
def _(s, d):
    return backtest.compare_out_of_sample(_two_paths(s, d))


def _two_paths(s, d):
    f = F.col("x.f")
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(v).alias("f")) for n, v in (("full", 1.0), ("half", 0.5)))))
    return path(s, d).withColumn("x", kinds).select("x.strategy", "dt", *((F.col(c) * f).alias(c) for c in ("net", "turnover", "cost")))


@query("moments_table", f"""WITH {_ST}, mo AS (SELECT asset, regime, avg(r) AS mean, stddev_samp(r) AS vol, quantile_cont(r, 0.05) AS q5, quantile_cont(r, 0.25) AS q25 FROM smp GROUP BY 1, 2)
SELECT CASE asset WHEN 'A_F' THEN 1 WHEN 'R_F' THEN 2 WHEN 'N_O' THEN 3 ELSE 4 END AS place, {_SHOWN.format('asset')} AS "Asset", regime, round(ln(1e4 + mean * 248.48 * 100), 6) AS mean_pct, round(ln(vol * power(248.48, 0.5) * 100), 6) AS vol_pct, round(ln(1e4 + q25 * 100), 6) AS q25_pct FROM mo""", 6)
def _(s, d):
    m = sample(s, d).groupBy("asset", "regime").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), F.percentile("r", 0.05).alias("es5"), F.percentile("r", 0.25).alias("q25"))
    t = studies.moments_table(m, _NAMES, digits=None)
    return t.select("place", "Asset", "regime", F.ln(1e4 + F.col("mean_pct")).alias("mean_pct"), F.ln("vol_pct").alias("vol_pct"), F.ln(1e4 + F.col("q25_pct")).alias("q25_pct"))


@query("correlation_table", f"""WITH t AS (SELECT r_name AS a, n_name AS b, (n_nationkey % 8 - 4) / 8.0 AS lo, (n_nationkey % 5 - 2) / 4.0 AS hi, n_nationkey * n_nationkey / 640.0 AS p, n_nationkey / 25.0 AS q FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT row_number() OVER (ORDER BY p, a, b) AS place, a || ' / ' || b AS pair, printf('%.3f', lo) AS rho_low, printf('%.3f', hi) AS rho_high, printf('%.3f', hi - lo) AS diff, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p + 1e-9) END AS p, CASE WHEN q < 0.001 THEN '<0.001' ELSE printf('%.3f', q + 1e-9) END AS q, CASE WHEN q < 0.01 THEN '***' WHEN q < 0.05 THEN '**' WHEN q < 0.1 THEN '*' ELSE '-' END AS stars FROM t""")
def _(s, d):
    n = F.col("n_nationkey")
    t = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("asset_i"), F.col("n_name").alias("asset_j"), ((n % 8 - 4) / 8.0).alias("rho_low"), ((n % 5 - 2) / 4.0).alias("rho_high"), (n * n / 640.0).alias("p_value"), (n / 25.0).alias("q_value"))
    return studies.correlation_table(t.withColumn("diff", F.col("rho_high") - F.col("rho_low")), {})


@query("tier_summary", """WITH t AS (SELECT n_regionkey AS tier, n_regionkey + 6 AS n_assets, 'a' || n_regionkey AS added_asset, n_nationkey AS w, 2 + n_nationkey % 3 AS k, n_nationkey * 1.5 AS bic, 40.0 + n_nationkey AS neff FROM nation),
m AS (SELECT tier, min(k) AS mode FROM (SELECT tier, k, count(*) AS c, max(count(*)) OVER (PARTITION BY tier) AS best FROM t GROUP BY 1, 2) WHERE c = best GROUP BY 1)
SELECT t.tier, n_assets, added_asset, count(*) AS n_windows, max(mode) AS K_mode, min(k) AS K_min, max(k) AS K_max, round(avg(bic), 9) AS bic_mean, round(avg(neff), 9) AS Neff_min_mean, max(CASE WHEN t.tier > 0 THEN t.tier / 8.0 END) AS K_match_rate, max(CASE WHEN t.tier > 0 THEN 0.5 END) AS prob_corr_mean, max(CASE WHEN t.tier > 0 THEN 0.25 END) AS prob_corr_min, max(CASE WHEN t.tier > 0 THEN t.tier ELSE 0 END) AS n_unstable_windows FROM t JOIN m ON t.tier = m.tier GROUP BY 1, 2, 3""")
def _(s, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    t = table(s, d, "nation").select(r.alias("tier"), (r + 6).alias("n_assets"), F.concat(F.lit("a"), r).alias("added_asset"), n.alias("w"), (2 + n % 3).alias("k_selected"), (n * 1.5).alias("bic"), (40.0 + n).alias("neff_min"))
    c = t.select("tier").distinct().filter("tier > 0").select("tier", (F.col("tier") / 8.0).alias("k_match_rate"), F.lit(0.5).alias("mean_corr"), F.lit(0.25).alias("min_corr"), F.col("tier").alias("unstable_windows"))
    return studies.tier_summary(t, c)


@query("against_baseline", f"""WITH {_ST}, a AS (SELECT dt, 0 AS k, 1 - p_1 AS p FROM st UNION ALL SELECT dt, 1, p_1 FROM st), b AS (SELECT dt, 0 AS k, 1 - p_1 * p_1 AS p FROM st UNION ALL SELECT dt, 1, p_1 * p_1 FROM st)
SELECT count(DISTINCT a.dt) AS n, round(covar_samp(a.p, b.p) / (stddev_samp(a.p) * stddev_samp(b.p)), 9) AS corr, round(avg(abs(a.p - b.p)), 9) AS mae FROM a JOIN b ON a.dt = b.dt AND a.k = b.k""")
def _(s, d):
    p = F.col("p_1")
    long = lambda x: states(s, d).select("dt", F.posexplode(F.array(1 - x, x)).alias("k", "p"))
    return studies.against_baseline(long(p), long(p * p))


@query("with_total", "WITH t AS (SELECT c_mktsegment AS seg, count(*) AS n, max(c_nationkey) AS top FROM customer GROUP BY 1) SELECT seg, n, top FROM t UNION ALL SELECT '_summary_', sum(n), max(top) FROM t")
def _(s, d):
    t = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"), F.max("c_nationkey").alias("top"))
    return studies.with_total(t, "seg", ["n"], ["top"])


@query("normalised_probabilities", "WITH x AS (SELECT c_nationkey AS dt, c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE abs(c_acctbal) END AS p FROM customer) SELECT dt, k, round(CASE WHEN sum(p) OVER (PARTITION BY dt) = 0 THEN 0 ELSE p / sum(p) OVER (PARTITION BY dt) END, 9) AS p FROM x")
def _(s, d):
    n = F.col("c_nationkey")
    return regimes.normalised(table(s, d, "customer").select(n.alias("dt"), F.col("c_custkey").alias("k"), F.when(n == 3, 0.0).otherwise(F.abs("c_acctbal")).alias("p")))


@query("pooled_equal_moments", f"WITH {_WM}, n AS (SELECT CAST(count(DISTINCT w) AS DOUBLE) AS n FROM wm) SELECT k, asset, round(sum(mean) / max(n), 9) AS mean, round(sum(vol) / max(n), 9) AS vol FROM wm, n WHERE k < 1 GROUP BY 1, 2")
def _(s, d):
    m = _moments(s, d)
    return regimes.pooled_equal(m, m.agg(F.count_distinct("w")).first()[0], 1)


@query("brier_skill", f"""WITH {_FC}, x AS (SELECT unnest(['ar', 'rw']) AS method, unnest([p_ar_t1, p_rw_t1]) AS p, z_t1 AS z FROM fc), b AS (SELECT method, avg((p - z) * (p - z)) AS brier FROM x GROUP BY 1)
SELECT method, round(1 - brier / (SELECT brier FROM b WHERE method = 'rw'), 6) AS skill FROM b""", 6)
def _(s, d):
    return forecast_eval.skill(forecast_eval.scores(forecast_eval.long_methods(_one_step(s, d)), ("method",)), "rw").select("method", "skill")


@query("thinned_origins", f"WITH {_ST}, o AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM st) SELECT st.dt AS origin_dt, h, round(p_1, 9) AS p_hat FROM st JOIN o ON o.dt = st.dt, (SELECT unnest([1, 5]) AS h) WHERE i % 20 = 0")
def _(s, d):
    return forecast_eval.thinned(states(s, d).select(F.col("dt").alias("origin_dt"), F.explode(F.array(F.lit(1), F.lit(5))).alias("h"), F.col("p_1").alias("p_hat")), 20)


@query("blended_targets", f"""WITH {_BT.replace(_RET, _ST)}, pf AS (SELECT k, asset, CASE WHEN k = 0 THEN 0.25 WHEN asset = 'A_F' THEN 0.7 ELSE 0.1 END AS w FROM (SELECT DISTINCT asset FROM ret WHERE asset IN ('A_F', 'N_F', 'N_O', 'R_F')), (SELECT unnest([0, 1]) AS k)),
x AS (SELECT st.dt, asset, sum(w * CASE WHEN k = 0 THEN 1 - p_1 ELSE p_1 END) AS w FROM reb JOIN st ON st.dt = reb.dt, pf GROUP BY 1, 2) SELECT dt, asset, round(w / sum(w) OVER (PARTITION BY dt), 9) AS w FROM x""")
def _(s, d):
    r = returns(s, d)
    pf = s.createDataFrame([(k, a, 0.25 if k == 0 else 0.7 if a == "A_F" else 0.1) for k in (0, 1) for a in ("A_F", "N_F", "N_O", "R_F")], "k int, asset string, w double")
    probs = regimes.proxy_states(r).select("dt", F.posexplode(F.array(1 - F.col("p_1"), "p_1")).alias("k", "p"))
    return backtest.blended_targets(r, probs, pf)


@query("prior_weights", "SELECT c_custkey AS id, round(568.0 * (c_custkey % 99) / 100 / (1 - (c_custkey % 99) / 100.0), 6) AS kappa, CAST(CASE WHEN c_acctbal > 0.5 THEN 1 ELSE 0 END AS INT) AS high FROM customer", 6)
def _(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), scalar.kappa_from_prior_weight(F.col("c_custkey") % 99 / 100).alias("kappa"), scalar.high_label(F.col("c_acctbal")).alias("high"))


@query("model_parameters", """WITH m AS (SELECT unnest(['EII', 'VII', 'EEI', 'VEI', 'EVI', 'VVI', 'EEE', 'EEV', 'VEV', 'VVV']) AS model), x AS (SELECT model, k, dd FROM m, (SELECT unnest([1.0, 2, 5]) AS k), (SELECT unnest([2.0, 6]) AS dd))
SELECT model, k, dd, k - 1 + k * dd + CASE model WHEN 'EII' THEN 1 WHEN 'VII' THEN k WHEN 'EEI' THEN dd WHEN 'VEI' THEN k + dd - 1 WHEN 'EVI' THEN 1 + k * (dd - 1) WHEN 'VVI' THEN k * dd WHEN 'EEE' THEN dd * (dd + 1) / 2 WHEN 'EEV' THEN dd + k * dd * (dd - 1) / 2 WHEN 'VEV' THEN k + dd - 1 + k * dd * (dd - 1) / 2 ELSE k * dd * (dd + 1) / 2 END AS n FROM x""")
def _(s, d):
    kinds = ("EII", "VII", "EEI", "VEI", "EVI", "VVI", "EEE", "EEV", "VEV", "VVV")
    x = s.createDataFrame([(m, float(k), float(dd)) for m in kinds for k in (1, 2, 5) for dd in (2, 6)], "model string, k double, dd double")
    return x.withColumn("n", scalar.num_params(F.col("model"), F.col("k"), F.col("dd")))


@query("array_labels", f"WITH {_ST} SELECT dt, CAST(CASE WHEN p_1 > 1 - p_1 THEN 1 ELSE 0 END AS INT) AS regime FROM st")
def _(s, d):
    return regimes.hard_labels_of_array(states(s, d).select("dt", F.array(1 - F.col("p_1"), "p_1").alias("p")))


@query("added_assets", "SELECT DISTINCT n_name AS asset FROM nation WHERE n_regionkey >= 3")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("asset"), "n_regionkey")
    return studies.added_assets(n.filter("n_regionkey < 3"), n)


@query("expanding_covariances", f"""WITH {_BT}, c AS (SELECT x.dt, x.asset AS a, y.asset AS b, covar_samp(x.r, y.r) OVER w AS cov, avg(x.r) OVER w AS ma, count(*) OVER w - 1 AS t FROM ret x JOIN ret y ON x.dt = y.dt AND x.asset <= y.asset WINDOW w AS (PARTITION BY x.asset, y.asset ORDER BY x.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c.dt, t, a, b, round(cov, 9) AS cov, round(ma, 9) AS ma FROM c JOIN reb ON c.dt = reb.dt WHERE t > 0""")
def _(s, d):
    r = returns(s, d)
    m = portfolios.expanding_moments(r, panel.rebalance_dates(r.select("dt"))).filter("t > 0")
    return m.select("dt", "t", F.inline("cells")).select("dt", "t", "a", "b", "cov", "ma")


@query("weighted_covariances", f"""WITH {_BT.replace(_RET, _ST)}, c AS (SELECT st.dt, x.asset AS a, y.asset AS b, sum(p_1) OVER w AS n, sum(p_1 * p_1) OVER w AS n2, sum(p_1 * x.r) OVER w AS sa, sum(p_1 * y.r) OVER w AS sb, sum(p_1 * x.r * y.r) OVER w AS sab, count(*) OVER w - 1 AS t
  FROM ret x JOIN ret y ON x.dt = y.dt AND x.asset <= y.asset JOIN st ON st.dt = x.dt WINDOW w AS (PARTITION BY x.asset, y.asset ORDER BY x.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c.dt, t, a, b, round((sab - sa * sb / n) / (n - n2 / n), 9) AS cov, round(sa / n, 9) AS ma FROM c JOIN reb ON c.dt = reb.dt WHERE t > 0""")
def _(s, d):
    r = returns(s, d)
    p = regimes.proxy_states(r).select("dt", F.lit(1).alias("k"), F.col("p_1").alias("p"))
    m = portfolios.weighted_expanding(r, p, panel.rebalance_dates(r.select("dt")), unbiased=True).filter("t > 0")
    return m.select("dt", "t", F.inline("cells")).select("dt", "t", "a", "b", "cov", "ma")


@query("calendar_windows", f"WITH {_COVER} SELECT w, count(DISTINCT dt) AS n FROM (SELECT pr.w, pr.dt, win2.end_dt FROM pr JOIN (SELECT win.w, days.dt AS end_dt FROM win JOIN days ON days.t = win.e) win2 ON pr.w = win2.w) WHERE date_diff('day', dt, end_dt) BETWEEN 0 AND 150 GROUP BY 1")
def _(s, d):
    from .relational import _window_probs

    probs = _window_probs(s, d)
    ends = probs.groupBy("w").agg(F.max("dt").alias("end_dt"))
    return studies.within_calendar(probs, ends, 100).groupBy("w").agg(F.count_distinct("dt").alias("n"))
