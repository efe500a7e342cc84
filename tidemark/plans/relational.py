"""Queries that DuckDB can check: Spark plans and the SQL that gives the same rows, side by side.

Panels: lineitem prices by day and (returnflag, linestatus). States: rolling volatility of the mean return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import backtest, forecast_eval, inference, panel, regimes
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PX = """px AS (SELECT CAST(l_shipdate AS DATE) AS dt, l_returnflag || '_' || l_linestatus AS asset, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS px
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
g AS (SELECT d.dt, a.asset FROM (SELECT DISTINCT dt FROM px) d, (SELECT DISTINCT asset FROM px) a),
f AS (SELECT g.dt, g.asset, last_value(px.px IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM g LEFT JOIN px ON g.dt = px.dt AND g.asset = px.asset)"""
_RET = f"""{_PX},
r0 AS (SELECT dt, asset, ln(px) - lag(ln(px)) OVER (PARTITION BY asset ORDER BY dt) AS r FROM f),
ok AS (SELECT dt FROM r0 GROUP BY dt HAVING count(r) = count(*) AND bool_and(r <> 0)),
ret AS (SELECT dt, asset, r FROM r0 WHERE dt IN (SELECT dt FROM ok))"""
_ST = f"""{_RET},
m AS (SELECT dt, avg(r) AS m FROM ret GROUP BY dt),
v0 AS (SELECT dt, stddev_samp(m) OVER w AS v, count(m) OVER w AS n FROM m WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
v1 AS (SELECT dt, v FROM v0 WHERE n = 21),
cut AS (SELECT quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.34) AS qa, quantile_cont(v, 0.67) AS qb, avg(v) AS mu, stddev_samp(v) AS sd FROM v1),
st AS (SELECT dt, v, 1 / (1 + exp(-((v - mu) / sd))) AS p_1, CAST(v > q2 AS INT) AS regime2, CAST(v > qa AS INT) + CAST(v > qb AS INT) AS regime3 FROM v1, cut),
smp AS (SELECT ret.dt, asset, r, regime3 AS regime FROM ret JOIN st ON ret.dt = st.dt)"""
_BT = f"""{_RET},
reb AS (SELECT max(dt) AS dt FROM (SELECT DISTINCT dt FROM ret) GROUP BY date_trunc('month', dt)),
seg AS (SELECT dt, flag, coalesce(sum(flag) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM (SELECT d.dt, CASE WHEN reb.dt IS NULL THEN 0 ELSE 1 END AS flag FROM (SELECT DISTINCT dt FROM ret) d LEFT JOIN reb ON d.dt = reb.dt)),
wt AS (SELECT 1.0 / count(DISTINCT asset) AS w FROM ret),
vv AS (SELECT ret.dt, asset, seg, flag, w, w * exp(sum(r) OVER (PARTITION BY seg, asset ORDER BY ret.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM ret JOIN seg ON ret.dt = seg.dt, wt),
dd AS (SELECT dt, seg, flag, sum(v) AS tot, sum(w) AS w0 FROM vv GROUP BY 1, 2, 3),
gr AS (SELECT dt, seg, flag, tot, ln(tot) - coalesce(lag(ln(tot)) OVER (PARTITION BY seg ORDER BY dt), ln(w0)) AS gross FROM dd),
tu AS (SELECT vv.dt, sum(abs(vv.w - vv.v / dd.tot)) / 2 AS turnover FROM vv JOIN dd ON vv.dt = dd.dt WHERE vv.flag = 1 GROUP BY 1),
bt AS (SELECT gr.dt, gross, coalesce(turnover, 0) AS turnover, coalesce(turnover, 0) * 0.001 AS cost, gross - coalesce(turnover, 0) * 0.001 AS net FROM gr LEFT JOIN tu ON gr.dt = tu.dt)"""
_DD = f"""{_BT},
we AS (SELECT dt, net AS r, exp(sum(net) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS wealth FROM bt),
dr AS (SELECT dt, r, wealth, max(wealth) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM we)"""
_SKEW = "skewness({0})"
_KURT = "kurtosis({0})"


def returns(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_quantity")
    px = panel.price_panel(lines)
    return panel.synchronous(panel.log_returns(panel.ffill(px)))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return panel.price_panel(table(spark, sf, "lineitem"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.proxy_states(returns(spark, sf))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf)
    return regimes.labelled(r, regimes.proxy_states(r).withColumnRenamed("regime3", "regime"))


def path(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.static_backtest(returns(spark, sf))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _log(px: DataFrame) -> DataFrame:
    """Logarithms of prices: quotients of decimals often end on a rounding boundary, logarithms never do."""
    return px.select("dt", "asset", F.ln("px").alias("log_px"))


def query(name: str, sql: str, digits: int = 9):
    """Registers a plan, with its doubles rounded as the SQL rounds them."""

    def add(f):
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        SQL[name] = sql
        return f

    return add


def _r(*names: str, digits: int = 9) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("price_panel", f"WITH {_PX} SELECT dt, asset, round(ln(px), 9) AS log_px FROM px")
def _(s, d):
    return _log(prices(s, d))


@query("ffill_prices", f"WITH {_PX} SELECT dt, asset, round(ln(px), 9) AS log_px FROM f")
def _(s, d):
    return _log(panel.ffill(prices(s, d)))


@query("range_then_fill", f"""WITH {_PX.replace("WHERE l_shipdate IS NOT NULL", "WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")} SELECT dt, asset, round(ln(px), 9) AS log_px FROM f""")
def _(s, d):
    return _log(panel.ffill(panel.date_range(prices(s, d), "1994-01-01", "1995-12-31")))


@query("weekly_resample", f"""WITH {_PX},
b AS (SELECT dt + CAST((12 - dayofweek(dt)) % 7 AS INT) AS wk, asset, max_by(px, dt) AS px FROM px GROUP BY 1, 2),
sp AS (SELECT w.wk, a.asset FROM (SELECT CAST(unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS DATE) AS wk FROM b) w, (SELECT DISTINCT asset FROM px) a),
x AS (SELECT sp.wk AS dt, sp.asset, last_value(b.px IGNORE NULLS) OVER (PARTITION BY sp.asset ORDER BY sp.wk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM sp LEFT JOIN b ON sp.wk = b.wk AND sp.asset = b.asset)
SELECT dt, asset, round(ln(px), 9) AS log_px FROM x""")
def _(s, d):
    return _log(panel.resample(prices(s, d), "weekly"))


@query("monthly_resample", f"""WITH {_PX},
b AS (SELECT last_day(dt) AS mo, asset, max_by(px, dt) AS px FROM px GROUP BY 1, 2),
sp AS (SELECT w.mo, a.asset FROM (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(mo)), date_trunc('month', max(mo)), INTERVAL 1 MONTH)) AS DATE)) AS mo FROM b) w, (SELECT DISTINCT asset FROM px) a),
x AS (SELECT sp.mo AS dt, sp.asset, last_value(b.px IGNORE NULLS) OVER (PARTITION BY sp.asset ORDER BY sp.mo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM sp LEFT JOIN b ON sp.mo = b.mo AND sp.asset = b.asset)
SELECT dt, asset, round(ln(px), 9) AS log_px FROM x""")
def _(s, d):
    return _log(panel.resample(prices(s, d), "monthly"))


@query("log_returns", f"WITH {_RET}, h AS (SELECT dt FROM r0 GROUP BY dt HAVING count(r) > 0) SELECT dt, asset, {_r('r')} FROM r0 WHERE dt IN (SELECT dt FROM h)")
def _(s, d):
    return panel.log_returns(panel.ffill(prices(s, d)))


@query("complete_cases", f"WITH {_RET}, h AS (SELECT dt FROM r0 GROUP BY dt HAVING count(r) = 6) SELECT dt, asset, {_r('r')} FROM r0 WHERE dt IN (SELECT dt FROM h)")
def _(s, d):
    return panel.complete_cases(panel.log_returns(panel.ffill(prices(s, d))), 6)


@query("sync_filter", f"WITH {_RET} SELECT dt, asset, {_r('r')} FROM ret")
def _(s, d):
    return returns(s, d)


@query("asset_summary", f"""WITH {_RET} SELECT asset, (SELECT min(dt) FROM ret) AS start_date, (SELECT max(dt) FROM ret) AS end_date, count(r) AS n_obs, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS vol, round(min(r), 9) AS min, round(max(r), 9) AS max FROM ret GROUP BY asset""")
def _(s, d):
    return panel.summarise(returns(s, d))


@query("wide_pivot", f"WITH {_RET} SELECT dt, " + ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN r END), 9) AS {a}" for a in ("A_F", "N_F", "N_O", "R_F")) + " FROM ret GROUP BY dt")
def _(s, d):
    return panel.wide(returns(s, d), "r", ["A_F", "N_F", "N_O", "R_F"])


@query("proxy_states", f"WITH {_ST} SELECT dt, {_r('v', 'p_1')}, regime2, regime3 FROM st")
def _(s, d):
    return states(s, d)


@query("hard_labels", f"""WITH {_ST}, pr AS (SELECT dt, 0 AS k, 1 - p_1 AS p FROM st UNION ALL SELECT dt, 1, p_1 FROM st) SELECT dt, CAST(CASE WHEN p_1 > 1 - p_1 THEN 1 ELSE 0 END AS INT) AS regime FROM st""")
def _(s, d):
    st = states(s, d)
    return regimes.hard_labels(st.select("dt", F.posexplode(F.array(1 - F.col("p_1"), "p_1")).alias("k", "p")))


@query("split_counts", f"WITH {_ST} SELECT count(*) FILTER (WHERE NOT p_1 > 0.5) AS n_low, count(*) FILTER (WHERE p_1 > 0.5) AS n_high FROM st")
def _(s, d):
    return regimes.split_counts(states(s, d))


@query("regime_moments", f"""WITH {_ST} SELECT regime, asset, count(*) AS n, round(avg(r), 9) AS mean, round(var_samp(r), 9) AS var, round(stddev_samp(r), 9) AS vol, round(skewness(r), 9) AS skew, round(kurtosis(r), 9) AS kurt FROM smp GROUP BY 1, 2 HAVING count(*) >= 50""")
def _(s, d):
    return regimes.moments(sample(s, d), 50)


_Q3 = "VALUES (0.05), (0.1), (0.25)"


@query("regime_quantiles", f"""WITH {_ST}, q AS (SELECT regime, asset, count(*) AS n, quantile_cont(r, [0.05, 0.1, 0.25]) AS q FROM smp GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT regime, asset, n, unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS level, round(unnest(q), 9) AS q FROM q""")
def _(s, d):
    return regimes.quantiles(sample(s, d))


@query("regime_var_es", f"""WITH {_ST}, q AS (SELECT regime, asset, count(*) AS n, unnest([0.05, 0.1]::DOUBLE[]) AS level, unnest(quantile_cont(r, [0.05, 0.1])) AS q FROM smp GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT q.regime, q.asset, n, level, round(q, 9) AS var, round(avg(r), 9) AS es, count(r) AS n_tail FROM q JOIN smp ON q.regime = smp.regime AND q.asset = smp.asset AND r <= q GROUP BY 1, 2, 3, 4, 5""")
def _(s, d):
    return regimes.var_es(sample(s, d))


_CORR = """SELECT {keep}x.asset AS a, y.asset AS b, count(*) AS n, round(covar_samp(x.r, y.r), 9) AS cov, round(covar_samp(x.r, y.r) / (stddev_samp(x.r) * stddev_samp(y.r)), 9) AS corr FROM {t} x JOIN {t} y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY ALL"""


@query("corr_matrix", f"WITH {_RET} " + _CORR.format(keep="", t="ret"))
def _(s, d):
    return regimes.correlation_matrix(returns(s, d))


@query("regime_corr", f"WITH {_ST} " + _CORR.format(keep="x.regime, ", t="smp"))
def _(s, d):
    return regimes.correlation_matrix(sample(s, d), ("regime",))


@query("mean_abs_corr", f"WITH {_ST}, c AS ({_CORR.format(keep='x.regime, ', t='smp').replace('round(covar_samp(x.r, y.r) / (stddev_samp(x.r) * stddev_samp(y.r)), 9)', 'covar_samp(x.r, y.r) / (stddev_samp(x.r) * stddev_samp(y.r))')}) SELECT regime, round(avg(abs(corr)), 9) AS mean_abs_corr FROM c WHERE a < b GROUP BY 1")
def _(s, d):
    return regimes.mean_abs_correlation(sample(s, d), ("regime",))


_RUNS = f"""{_ST}, c AS (SELECT dt, regime3 AS l, CASE WHEN regime3 = lag(regime3) OVER (ORDER BY dt) THEN 0 ELSE 1 END AS c FROM st),
rr AS (SELECT dt, l, sum(c) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c),
runs AS (SELECT CAST(run AS BIGINT) AS run, l AS label, count(*) AS n, min(dt) AS first, max(dt) AS last FROM rr GROUP BY 1, 2)"""


@query("run_lengths", f"WITH {_RUNS} SELECT * FROM runs")
def _(s, d):
    return regimes.run_lengths(states(s, d), "regime3")


@query("turnover_stats", f"WITH {_RUNS} SELECT round((count(*) - 1) / CAST(sum(n) - 1 AS DOUBLE), 9) AS turnover_rate, round(avg(n), 9) AS avg_run_length, round(quantile_cont(n, 0.5), 9) AS med_run_length FROM runs")
def _(s, d):
    return regimes.turnover_stats(states(s, d), "regime3")


@query("observations_per_year", f"WITH {_RET}, d AS (SELECT DISTINCT dt FROM ret), y AS (SELECT unnest(generate_series(min(year(dt)), max(year(dt)))) AS y FROM d) SELECT CAST(y.y AS INT) AS year, count(d.dt) AS n FROM y LEFT JOIN d ON year(d.dt) = y.y GROUP BY 1")
def _(s, d):
    days = returns(s, d).select("dt").distinct()
    spine = days.agg(F.min(F.year("dt")).alias("a"), F.max(F.year("dt")).alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    return spine.join(days.groupBy(F.year("dt").alias("year")).agg(F.count(F.lit(1)).alias("n")), "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_WIN = f"""{_RET}, days AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS t, dt FROM (SELECT DISTINCT dt FROM ret)),
tt AS (SELECT max(t) AS n FROM days), win AS (SELECT CAST(s / 63 AS INT) AS w, s, s + 249 AS e FROM (SELECT unnest(generate_series(0, (SELECT n + 1 - 250 FROM tt), 63)) AS s))"""


def _days(s, d):
    return panel.vectors(returns(s, d)).select("t", "dt")


@query("estimation_windows", f"WITH {_WIN} SELECT w, s, e, dt AS end_dt FROM win JOIN days ON days.t = win.e")
def _(s, d):
    return regimes.estimation_windows(_days(s, d), 250, 63)


@query("one_sided_serving", f"WITH {_WIN} SELECT t, dt, max(w) AS w FROM days JOIN win ON win.e < days.t GROUP BY 1, 2")
def _(s, d):
    days = _days(s, d)
    return regimes.one_sided_serving(days, regimes.estimation_windows(days, 250, 63))


_COVER = f"""{_WIN.replace(_RET, _ST)}, cov AS (SELECT w, days.t, days.dt, p_1 FROM days JOIN win ON days.t BETWEEN s AND e JOIN st ON st.dt = days.dt),
pr AS (SELECT w, t, dt, 0 AS k, 1 - p_1 * (1 + w) / (1 + (SELECT max(w) FROM win)) AS p FROM cov UNION ALL SELECT w, t, dt, 1, p_1 * (1 + w) / (1 + (SELECT max(w) FROM win)) FROM cov)"""


def _window_probs(s, d):
    """Window probabilities that differ by window: the day's p_1 scaled by the window's number."""
    r = returns(s, d)
    days = panel.vectors(r).select("t", "dt")
    win = regimes.estimation_windows(days, 250, 63)
    share = (F.col("w") + 1) / (F.max("w").over(Window.partitionBy()) + 1)
    scaled = win.withColumn("share", share)
    cov = regimes.covering(days, win).join(regimes.proxy_states(r).select("dt", "p_1"), "dt").join(scaled.select("w", "share"), "w")
    p = F.col("p_1") * F.col("share")
    return cov.select("w", "t", "dt", F.posexplode(F.array(1 - p, p)).alias("k", "p"))


@query("retro_average", f"WITH {_COVER} SELECT t, dt, k, round(avg(p), 9) AS p FROM pr GROUP BY 1, 2, 3")
def _(s, d):
    return regimes.retrospective(_window_probs(s, d))


@query("window_means", f"WITH {_COVER} SELECT w, k, round(avg(p), 9) AS p FROM pr GROUP BY 1, 2")
def _(s, d):
    return regimes.window_means(_window_probs(s, d))


@query("effective_sizes", f"WITH {_COVER}, n AS (SELECT w, k, sum(p) AS neff FROM pr GROUP BY 1, 2) SELECT w, k, round(neff, 6) AS neff, round(min(neff) OVER (PARTITION BY w), 6) AS min_neff FROM n", 6)
def _(s, d):
    return regimes.effective_sizes(_window_probs(s, d))


_WM = f"""{_COVER}, wm0 AS (SELECT w, k, asset, sum(p) + 1e-15 AS s0, sum(p * r) AS s1, sum(p * r * r) AS s2, avg(p) AS weight FROM pr JOIN ret ON pr.dt = ret.dt GROUP BY 1, 2, 3),
wm AS (SELECT w, k, asset, s1 / s0 AS mean, sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 0)) AS vol, weight FROM wm0)"""


def _moments(s, d):
    return regimes.weighted_moments(_window_probs(s, d), returns(s, d))


@query("weighted_moments", f"WITH {_WM} SELECT w, k, asset, {_r('mean', 'vol', 'weight')} FROM wm")
def _(s, d):
    return _moments(s, d)


@query("pooled_moments", f"WITH {_WM} SELECT k, asset, round(sum(mean * weight) / sum(weight), 9) AS mean_wavg, round(sum(vol * weight) / sum(weight), 9) AS vol_wavg, round(avg(weight), 9) AS avg_regime_weight, count(DISTINCT w) AS n_windows FROM wm GROUP BY 1, 2")
def _(s, d):
    return regimes.pooled(_moments(s, d))


@query("last_window_moments", f"WITH {_WM} SELECT w, k, asset, {_r('mean', 'vol', 'weight')} FROM wm WHERE w = (SELECT max(w) FROM wm)")
def _(s, d):
    return regimes.last_window(_moments(s, d))


@query("spearman_by_window", f"""WITH {_COVER}, j AS (SELECT a.w, a.k, a.p AS x, b.p AS y FROM pr a JOIN pr b ON a.w = b.w AND a.dt = b.dt AND a.k + b.k = 1),
rk AS (SELECT w, k, rank() OVER (PARTITION BY w, k ORDER BY x) + (count(*) OVER (PARTITION BY w, k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY w, k ORDER BY y) + (count(*) OVER (PARTITION BY w, k, y) - 1) / 2.0 AS ry FROM j)
SELECT w, k, count(*) AS n, round(covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)), 9) AS rho FROM rk GROUP BY 1, 2 HAVING count(*) >= 6""")
def _(s, d):
    p = _window_probs(s, d)
    return inference.spearman_by_window(p, p.withColumn("k", 1 - F.col("k")))


@query("k_stability", f"WITH {_WIN}, k AS (SELECT w, w % 3 AS k FROM win) SELECT round(avg(CAST(k = l AS DOUBLE)), 9) AS k_stability FROM (SELECT k, lag(k) OVER (ORDER BY w) AS l FROM k)")
def _(s, d):
    return regimes.k_stability(regimes.estimation_windows(_days(s, d), 250, 63).select("w", (F.col("w") % 3).alias("k_selected")))


@query("dominant_autocorrelation", f"WITH {_ST}, t AS (SELECT dt, greatest(p_1, 1 - p_1) AS p FROM st), l AS (SELECT p, lag(p) OVER (ORDER BY dt) AS q FROM t) SELECT round(covar_samp(p, q) / (stddev_samp(p) * stddev_samp(q)), 9) AS autocorr FROM l WHERE q IS NOT NULL")
def _(s, d):
    return regimes.dominant_autocorrelation(states(s, d).select("dt", F.posexplode(F.array(1 - F.col("p_1"), "p_1")).alias("k", "p")))


@query("flip_dates", f"""WITH {_ST}, b AS (SELECT dt, avg(p_1) OVER (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, p_1 AS a FROM st)
SELECT count(*) AS n_common, round(avg(abs(a - b)), 9) AS mean_abs_diff, round(max(abs(a - b)), 9) AS max_abs_diff, round(covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)), 9) AS corr, count(*) FILTER (WHERE (a > 0.5) <> (b > 0.5)) AS n_flips,
coalesce((SELECT string_agg(CAST(dt AS VARCHAR), ',' ORDER BY dt) FROM (SELECT dt FROM b WHERE (a > 0.5) <> (b > 0.5) ORDER BY dt LIMIT 10)), '') AS first_flips FROM b""")
def _(s, d):
    st = states(s, d).select("dt", "p_1")
    smooth = st.select("dt", F.avg("p_1").over(Window.orderBy("dt").rowsBetween(-4, 0)).alias("p_1"))
    return regimes.label_changes(st, smooth)


@query("first_wins", f"""WITH {_RET} SELECT dt, asset, round(CASE WHEN asset IN ('A_F', 'R_F') THEN r ELSE 2 * r END, 9) AS r FROM ret""")
def _(s, d):
    r = returns(s, d)
    return regimes.first_wins(r.filter(F.col("asset").isin("A_F", "R_F")), r.withColumn("r", 2 * F.col("r")))


# ---- backtests ------------------------------------------------------------------------------------------


@query("static_backtest", f"WITH {_BT} SELECT dt, {_r('gross', 'turnover', 'cost', 'net')} FROM bt")
def _(s, d):
    return path(s, d)


@query("rebalance_dates", f"WITH {_BT} SELECT dt FROM reb")
def _(s, d):
    return panel.rebalance_dates(returns(s, d).select("dt"))


@query("drawdown_series", f"WITH {_DD} SELECT dt, {_r('r')}, round(ln(wealth), 9) AS log_wealth, round(ln(peak), 9) AS log_peak, round(wealth / peak - 1, 9) AS drawdown FROM dr")
def _(s, d):
    dd = backtest.drawdowns(path(s, d))
    return dd.select("dt", "r", F.ln("wealth").alias("log_wealth"), F.ln("peak").alias("log_peak"), "drawdown")


@query("drawdown_duration", f"""WITH {_DD}, i AS (SELECT *, row_number() OVER (ORDER BY dt) AS i FROM dr), u AS (SELECT i - row_number() OVER (ORDER BY dt) AS run FROM i WHERE wealth < peak)
SELECT coalesce(max(n), 0) AS max_dd_duration FROM (SELECT count(*) AS n FROM u GROUP BY run)""")
def _(s, d):
    return backtest.longest_drawdown(backtest.drawdowns(path(s, d)))


@query("performance_metrics", f"""WITH {_DD}, a AS (SELECT exp(sum(r)) - 1 AS total_return, power(exp(sum(r)), 248.48 / count(r)) - 1 AS ann_return, stddev_samp(r) * power(248.48, 0.5) AS vol, stddev_samp(r) FILTER (WHERE r < 0) * power(248.48, 0.5) AS dn,
min(wealth / peak - 1) AS mdd, skewness(r) AS skewness, kurtosis(r) AS kurtosis, quantile_cont(r, 0.05) AS var_5pct, count(r) AS n_days FROM dr)
SELECT round(ln(1 + total_return), 6) AS log_total, round(ann_return, 6) AS ann_return, round(vol, 6) AS ann_volatility, round(ann_return / vol, 6) AS sharpe_ratio, round(ann_return / dn, 6) AS sortino_ratio, round(mdd, 6) AS max_drawdown, round(ann_return / abs(mdd), 6) AS calmar_ratio,
round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(var_5pct, 6) AS var_5pct, n_days FROM a""", 6)
def _(s, d):
    out = backtest.performance(path(s, d))
    return out.select(F.round(F.ln(1 + F.col("total_return")), 9).alias("log_total"), *out.columns[1:])


@query("drawdown_metrics", f"""WITH {_DD}, x AS (SELECT *, wealth / peak - 1 AS d, row_number() OVER (ORDER BY dt) AS i FROM dr), u AS (SELECT i - row_number() OVER (ORDER BY dt) AS run FROM x WHERE wealth < peak),
l AS (SELECT coalesce(max(n), 0) AS m FROM (SELECT count(*) AS n FROM u GROUP BY run)),
a AS (SELECT -min(d) AS max_drawdown, -avg(d) FILTER (WHERE d < 0) AS avg_drawdown, sqrt(avg(d * d)) AS ulcer_index, avg(abs(d)) AS pain_index, avg(r) * 252 AS ann_mean, stddev_samp(r) * power(252, 0.5) AS ann_vol, sqrt(avg(power(least(r, 0), 2))) * power(252, 0.5) AS downside_dev, count(r) AS n FROM x)
SELECT {_r('max_drawdown', 'avg_drawdown', 'ulcer_index', 'pain_index', 'ann_mean', 'ann_vol', 'downside_dev')}, n, round(ann_mean / max_drawdown, 9) AS calmar_ratio, (SELECT m FROM l) AS max_dd_duration FROM a""")
def _(s, d):
    return backtest.drawdown_risk(path(s, d))


@query("tail_risk", f"""WITH {_DD}, q AS (SELECT unnest([0.95, 0.99]::DOUBLE[]) AS level, unnest(quantile_cont(r, [0.05, 0.01])) AS q FROM dr) SELECT level, round(-q, 9) AS var, round(-avg(r), 9) AS cvar FROM q JOIN dr ON r <= q + 1e-15 GROUP BY level, q""")
def _(s, d):
    return backtest.tail_risk(path(s, d))


@query("rolling_sharpe", f"WITH {_BT} SELECT dt, CASE WHEN count(net) OVER w = 252 THEN round(avg(net) OVER w / stddev_samp(net) OVER w * sqrt(252), 6) END AS rolling_sharpe FROM bt WINDOW w AS (ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", 6)
def _(s, d):
    return backtest.rolling_sharpe(path(s, d))


@query("monthly_turnover", f"WITH {_BT} SELECT last_day(dt) AS month, round(sum(turnover), 9) AS turnover FROM bt GROUP BY 1")
def _(s, d):
    return backtest.monthly_turnover(path(s, d))


@query("risk_contributions", f"""WITH {_RET}, c AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.r, y.r) AS cov FROM ret x JOIN ret y ON x.dt = y.dt GROUP BY 1, 2), n AS (SELECT 1.0 / count(DISTINCT asset) AS w FROM ret),
p AS (SELECT a AS asset, max(w) AS w, max(w) * sum(cov * w) AS part FROM c, n GROUP BY 1) SELECT asset, round(w, 9) AS w, round(part / sqrt(sum(part) OVER ()), 9) AS contribution, round(part / sum(part) OVER (), 9) AS share FROM p""")
def _(s, d):
    r = returns(s, d)
    w = r.select("asset").distinct().withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))
    return backtest.risk_contributions(w, regimes.correlation_matrix(r))


@query("rolling_risk_shares", f"""WITH {_RET}, c AS (SELECT x.dt, x.asset AS a, y.asset AS b, covar_samp(x.r, y.r) OVER w AS cov, count(*) OVER w AS n FROM ret x JOIN ret y ON x.dt = y.dt WINDOW w AS (PARTITION BY x.asset, y.asset ORDER BY x.dt ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
p AS (SELECT dt, a AS asset, sum(cov) AS part FROM c WHERE n = 63 GROUP BY 1, 2) SELECT dt, asset, round(part / sum(part) OVER (PARTITION BY dt), 6) AS share FROM p""", 6)
def _(s, d):
    r = returns(s, d)
    w = r.select("asset").distinct().withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))
    return backtest.rolling_risk_shares(r, w)


@query("cost_sensitivity", f"""WITH {_BT}, n AS (SELECT unnest(generate_series(1, 10)) AS b), x AS (SELECT b, dt, gross - turnover * (b / 10000.0) AS r FROM bt, n)
SELECT CAST(b AS DOUBLE) AS tc_bps, round(power(exp(sum(r)), 252.0 / count(r)) - 1, 9) AS ann_return, round(stddev_samp(r) * sqrt(252), 9) AS ann_volatility, count(r) AS n_days FROM x GROUP BY b""")
def _(s, d):
    return backtest.cost_sensitivity(returns(s, d)).select(F.round("tc_bps", 6).alias("tc_bps"), "ann_return", "ann_volatility", "n_days")


@query("conditional_backtest", f"""WITH {_BT.replace(_RET, _ST)}, pf AS (SELECT k, asset, CASE WHEN k = 0 THEN 1.0 / 4 WHEN asset = 'A_F' THEN 0.7 ELSE 0.1 END AS w FROM (SELECT DISTINCT asset FROM ret WHERE asset IN ('A_F', 'N_F', 'N_O', 'R_F')), (SELECT unnest([0, 1]) AS k)),
tg AS (SELECT reb.dt, asset, w FROM reb JOIN st ON st.dt = reb.dt JOIN pf ON pf.k = st.regime2),
sg AS (SELECT dt, flag, coalesce(sum(flag) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM (SELECT d.dt, CASE WHEN t.dt IS NULL THEN 0 ELSE 1 END AS flag FROM (SELECT DISTINCT dt FROM ret) d LEFT JOIN (SELECT DISTINCT dt FROM tg) t ON d.dt = t.dt)),
ws AS (SELECT 0 AS seg, asset, w FROM pf WHERE k = 0 UNION ALL SELECT sg.seg + 1, asset, w FROM tg JOIN sg ON tg.dt = sg.dt),
v2 AS (SELECT ret.dt, ret.asset, sg.seg, flag, w, w * exp(sum(r) OVER (PARTITION BY sg.seg, ret.asset ORDER BY ret.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM ret JOIN sg ON ret.dt = sg.dt JOIN ws ON ws.seg = sg.seg AND ws.asset = ret.asset),
d2 AS (SELECT dt, seg, flag, sum(v) AS tot, sum(w) AS w0 FROM v2 GROUP BY 1, 2, 3),
g2 AS (SELECT dt, ln(tot) - coalesce(lag(ln(tot)) OVER (PARTITION BY seg ORDER BY dt), ln(w0)) AS gross FROM d2),
t2 AS (SELECT v2.dt, sum(abs(ws.w - v2.v / d2.tot)) / 2 AS turnover FROM v2 JOIN d2 ON v2.dt = d2.dt JOIN ws ON ws.seg = v2.seg + 1 AND ws.asset = v2.asset WHERE v2.flag = 1 GROUP BY 1)
SELECT g2.dt, round(gross, 9) AS gross, round(coalesce(turnover, 0), 9) AS turnover, round(coalesce(turnover, 0) * 0.0005, 9) AS cost, round(gross - coalesce(turnover, 0) * 0.0005, 9) AS net FROM g2 LEFT JOIN t2 ON g2.dt = t2.dt""")
def _(s, d):
    r = returns(s, d)
    names = ("A_F", "N_F", "N_O", "R_F")
    pf = s.createDataFrame([(k, a, 0.25 if k == 0 else 0.7 if a == "A_F" else 0.1) for k in (0, 1) for a in names], "k int, asset string, w double")
    targets = backtest.labelled_targets(r, regimes.proxy_states(r).withColumnRenamed("regime2", "regime"), pf)
    return backtest.drifted(r, pf.filter("k = 0").select("asset", "w"), targets)


@query("strategic_blend", """SELECT asset, round(w / sum(w) OVER (), 9) AS w FROM (SELECT asset, sum(p * w) AS w FROM (VALUES (0, 'x', 0.7), (0, 'y', 0.3), (1, 'x', 0.2), (1, 'y', 0.8)) t(k, asset, w) JOIN (VALUES (0, 0.85), (1, 0.15)) s(k, p) ON t.k = s.k GROUP BY asset)""")
def _(s, d):
    pf = s.createDataFrame([(0, "x", 0.7), (0, "y", 0.3), (1, "x", 0.2), (1, "y", 0.8)], "k int, asset string, w double")
    return backtest.strategic(pf, s.createDataFrame([(0, 0.85), (1, 0.15)], "k int, p double"))


_STRAT = f"""{_RET}, x AS (SELECT asset AS strategy, dt, r, exp(sum(r) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS we FROM ret),
y AS (SELECT strategy, dt, r, we / max(we) OVER (PARTITION BY strategy ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM x),
a AS (SELECT strategy, -min(d) AS mdd, sqrt(avg(d * d)) AS ulcer, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) AS sh, -quantile_cont(r, 0.05) AS v95 FROM y GROUP BY 1)"""


@query("strategy_ranks", f"WITH {_STRAT} SELECT strategy, round(mdd, 6) AS max_drawdown, round(ulcer, 6) AS ulcer_index, round(v95, 6) AS var_95, CAST(rank() OVER (ORDER BY mdd) AS DOUBLE) AS max_drawdown_rank, CAST(rank() OVER (ORDER BY ulcer) AS DOUBLE) AS ulcer_index_rank, CAST(rank() OVER (ORDER BY v95) AS DOUBLE) AS var_95_rank, CAST(rank() OVER (ORDER BY sh DESC) AS DOUBLE) AS sharpe_ratio_rank FROM a", 6)
def _(s, d):
    paths = returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net"))
    return backtest.strategy_profiles(paths).select("strategy", "max_drawdown", "ulcer_index", "var_95", "max_drawdown_rank", "ulcer_index_rank", "var_95_rank", "sharpe_ratio_rank")


# ---- inference ------------------------------------------------------------------------------------------

_F = """, gm AS (SELECT asset, regime, count(*) AS n, avg({c}) AS m, var_samp({c}) AS v FROM {t} GROUP BY 1, 2 HAVING count(*) >= 30),
gg AS (SELECT *, sum(n * m) OVER (PARTITION BY asset) / sum(n) OVER (PARTITION BY asset) AS grand FROM gm),
ff AS (SELECT asset, count(*) AS k, sum(n) AS total, min(n) AS min_group_n, sum(n * (m - grand) * (m - grand)) AS be, sum((n - 1) * v) AS wi FROM gg GROUP BY 1 HAVING count(*) >= 2)
SELECT asset, round((be / (k - 1)) / (wi / (total - k)), 6) AS statistic, k - 1 AS df1, CAST(total - k AS BIGINT) AS df2, k AS regimes_tested, min_group_n FROM ff"""


@query("anova_f", f"WITH {_ST}" + _F.format(c="r", t="smp"), 6)
def _(s, d):
    return inference.anova(sample(s, d)).drop("p_value")


@query("brown_forsythe_w", f"WITH {_ST}, md AS (SELECT asset, regime, quantile_cont(r, 0.5) AS med FROM smp GROUP BY 1, 2), z AS (SELECT smp.asset, smp.regime, abs(r - med) AS z FROM smp JOIN md ON smp.asset = md.asset AND smp.regime = md.regime)" + _F.format(c="z", t="z"), 6)
def _(s, d):
    return inference.brown_forsythe(sample(s, d)).drop("p_value")


@query("welch_t", f"""WITH {_ST}, gm AS (SELECT asset, regime, count(*) AS n, avg(r) AS m, var_samp(r) AS v FROM smp GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT a.asset, a.regime AS regime1, b.regime AS regime2, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 6) AS df, a.n AS n1, b.n AS n2 FROM gm a JOIN gm b ON a.asset = b.asset AND a.regime < b.regime""", 6)
def _(s, d):
    return inference.welch(sample(s, d)).select("asset", "regime1", "regime2", "t", "df", "n1", "n2")


@query("kruskal_h", f"""WITH {_ST}, x AS (SELECT asset, regime, r, rank() OVER (PARTITION BY asset ORDER BY r) + (count(*) OVER (PARTITION BY asset, r) - 1) / 2.0 AS rk FROM smp),
n AS (SELECT asset, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT regime) AS k FROM x GROUP BY 1), t AS (SELECT asset, sum(power(c, 3) - c) AS ties FROM (SELECT asset, r, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT asset, sum(s * s / g) AS q FROM (SELECT asset, regime, CAST(sum(rk) AS DOUBLE) AS s, count(*) AS g FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT n.asset, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS statistic, k - 1 AS df FROM n JOIN t ON n.asset = t.asset JOIN q ON n.asset = q.asset""", 6)
def _(s, d):
    return inference.kruskal(sample(s, d)).drop("p_value")


@query("ks_stat", f"""WITH {_ST}, z AS (SELECT asset, regime, count(*) AS n FROM smp GROUP BY 1, 2), p AS (SELECT a.asset, a.regime AS regime1, b.regime AS regime2, a.n AS n1, b.n AS n2 FROM z a JOIN z b ON a.asset = b.asset AND a.regime < b.regime),
c AS (SELECT p.asset, regime1, regime2, n1, n2, r, count(*) FILTER (WHERE regime = regime1) AS c1, count(*) FILTER (WHERE regime = regime2) AS c2 FROM p JOIN smp ON smp.asset = p.asset AND regime IN (regime1, regime2) GROUP BY ALL),
d AS (SELECT *, abs(CAST(sum(c1) OVER w AS DOUBLE) / n1 - CAST(sum(c2) OVER w AS DOUBLE) / n2) AS d FROM c WINDOW w AS (PARTITION BY asset, regime1, regime2 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT asset, regime1, regime2, n1, n2, round(max(d), 9) AS statistic FROM d GROUP BY ALL""")
def _(s, d):
    return inference.kolmogorov(sample(s, d)).drop("p_value")


@query("jarque_bera", f"""WITH {_RET}, a AS (SELECT asset, CAST(count(*) AS DOUBLE) AS n, avg(r) AS m, stddev_samp(r) AS sd, skewness(r) AS sk, kurtosis(r) AS ku FROM ret GROUP BY 1),
b AS (SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) AS g1, (ku * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM a) SELECT asset, round(n / 6 * (g1 * g1 + g2 * g2 / 4), 6) AS statistic, round(m, 6) AS mean, round(sd, 6) AS std, round(sk, 6) AS skew, round(ku + 3, 6) AS kurtosis FROM b""", 6)
def _(s, d):
    return inference.jarque_bera(returns(s, d)).drop("p_value")


@query("bh_adjust", f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE AS p_value FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM p)
SELECT id, round(p_value, 9) AS p_value, round(least(min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS q_value FROM r""")
def _(s, d):
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 10007 / F.lit(10007.0)).alias("p_value"))
    return inference.benjamini_hochberg(p)


# ---- forecasts ------------------------------------------------------------------------------------------

_FC = f"""{_ST}, y AS (SELECT dt, p_1, ln(least(greatest(p_1, 1e-8), 1 - 1e-8) / (1 - least(greatest(p_1, 1e-8), 1 - 1e-8))) AS y, row_number() OVER (ORDER BY dt) - 1 AS t FROM st),
l AS (SELECT *, lag(y) OVER (ORDER BY t) AS ly, lead(p_1) OVER (ORDER BY t) AS p_next, lead(dt) OVER (ORDER BY t) AS dt_next FROM y),
ab AS (SELECT *, regr_slope(y, ly) OVER w AS b, regr_intercept(y, ly) OVER w AS a FROM l WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fc AS (SELECT dt AS date_t, dt_next AS date_t1, 1 / (1 + exp(-(a + b * y))) AS p_ar_t1, p_1 AS p_rw_t1, CAST(p_next > 0.5 AS INT) AS z_t1 FROM ab WHERE t >= 250 AND p_next IS NOT NULL)"""


def _one_step(s, d):
    return forecast_eval.one_step_ar1(states(s, d))


@query("ar1_expanding", f"WITH {_FC} SELECT date_t, date_t1, {_r('p_ar_t1', 'p_rw_t1', digits=6)}, z_t1 FROM fc", 6)
def _(s, d):
    return _one_step(s, d)


@query("brier_logloss", f"""WITH {_FC}, x AS (SELECT unnest(['ar', 'rw']) AS method, unnest([p_ar_t1, p_rw_t1]) AS p, z_t1 AS z FROM fc)
SELECT method, count(*) AS n, round(avg((p - z) * (p - z)), 6) AS brier, round(avg(-(z * ln(least(greatest(p, 1e-8), 1 - 1e-8)) + (1 - z) * ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)))), 6) AS log_loss, round(avg(CAST((p >= 0.5) = (z = 1) AS DOUBLE)), 6) AS hit_rate, round(avg(CAST(z = 0 AS DOUBLE)), 6) AS always_calm FROM x GROUP BY 1""", 6)
def _(s, d):
    return forecast_eval.scores(forecast_eval.long_methods(_one_step(s, d)), ("method",))


@query("auc", f"""WITH {_FC}, x AS (SELECT p_rw_t1 AS p, z_t1 AS z, rank() OVER (ORDER BY p_rw_t1) + (count(*) OVER (PARTITION BY p_rw_t1) - 1) / 2.0 AS rk FROM fc), a AS (SELECT CAST(sum(rk) FILTER (WHERE z = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE z = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE z = 0) AS DOUBLE) AS n0 FROM x)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auc FROM a""")
def _(s, d):
    return inference.auc(_one_step(s, d).select(F.col("p_rw_t1").alias("p"), F.col("z_t1").alias("z")))


@query("dm_stat", f"""WITH {_FC}, x AS (SELECT date_t AS dt, power(p_ar_t1 - z_t1, 2) - power(p_rw_t1 - z_t1, 2) AS d FROM fc), lg AS (SELECT d, lag(d, 1) OVER (ORDER BY dt) AS l1, lag(d, 2) OVER (ORDER BY dt) AS l2, lag(d, 3) OVER (ORDER BY dt) AS l3, lag(d, 4) OVER (ORDER BY dt) AS l4 FROM x),
gd AS (SELECT count(*) AS n, avg(d) AS m, var_samp(d) AS g0, 2 * (covar_samp(d, l1) + covar_samp(d, l2) + covar_samp(d, l3) + covar_samp(d, l4)) AS gs FROM lg)
SELECT n, round(m, 6) AS mean_diff, round(m / sqrt(CASE WHEN g0 + gs > 0 THEN g0 + gs ELSE g0 END / n), 4) AS statistic FROM gd""", 6)
def _(s, d):
    f = _one_step(s, d).select(F.col("date_t").alias("dt"), ((F.col("p_ar_t1") - F.col("z_t1")) ** 2 - (F.col("p_rw_t1") - F.col("z_t1")) ** 2).alias("d"))
    return inference.diebold_mariano(f, 5).select("n", "mean_diff", F.round("statistic", 4).alias("statistic"))


@query("rolling_hit_rate", f"""WITH {_FC}, x AS (SELECT date_t1 AS dt, CAST((p_ar_t1 >= 0.5) = (z_t1 = 1) AS DOUBLE) AS h FROM fc) SELECT dt, CASE WHEN count(*) OVER w = 252 THEN round(avg(h) OVER w, 9) END AS hit_rate FROM x WINDOW w AS (ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return forecast_eval.rolling_hits(_one_step(s, d), 252)


@query("calibration_bins", f"""WITH {_FC}, e AS (SELECT min(p_rw_t1) AS lo, max(p_rw_t1) AS hi FROM fc), b AS (SELECT p_rw_t1 AS p, z_t1 AS z, CAST(greatest(ceil((p_rw_t1 - lo) / ((hi - lo) / 10)), 1) AS INT) AS bin FROM fc, e)
SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(z), 6) AS mean_z FROM b GROUP BY 1""", 6)
def _(s, d):
    return forecast_eval.calibration(_one_step(s, d).select(F.col("p_rw_t1").alias("p"), F.col("z_t1").alias("z")))


@query("forward_average", f"WITH {_ST} SELECT dt, round(avg(p_1) OVER (ORDER BY dt ROWS BETWEEN 21 FOLLOWING AND 41 FOLLOWING), 9) AS p_1_oracle_fwd FROM st")
def _(s, d):
    return forecast_eval.forward_average(states(s, d), 21)


@query("error_by_horizon", f"""WITH {_ST}, x AS (SELECT unnest([1, 5, 21]) AS h, p_1 AS p, unnest([lead(p_1, 1) OVER w, lead(p_1, 5) OVER w, lead(p_1, 21) OVER w]) AS a FROM st WINDOW w AS (ORDER BY dt))
SELECT h, count(*) AS n, round(avg(abs(p - a)), 9) AS mae, round(avg((p - a) * (p - a)), 9) AS mse, round(sqrt(avg((p - a) * (p - a))), 9) AS rmse, round(covar_samp(p, a) / (stddev_samp(p) * stddev_samp(a)), 9) AS corr FROM x WHERE a IS NOT NULL GROUP BY 1""")
def _(s, d):
    return forecast_eval.error_by_horizon(forecast_eval.persistence(states(s, d), (1, 5, 21)))


@query("fan_quantiles", f"""WITH {_ST}, x AS (SELECT dt, date_trunc('month', dt) AS mo, p_1 FROM st) SELECT CAST(mo AS DATE) AS forecast_dt, round(quantile_cont(p_1, 0.1), 9) AS q10, round(quantile_cont(p_1, 0.5), 9) AS q50, round(quantile_cont(p_1, 0.9), 9) AS q90 FROM x GROUP BY 1""")
def _(s, d):
    x = states(s, d).select(F.trunc("dt", "month").alias("forecast_dt"), F.col("p_1").alias("p_hat"))
    return forecast_eval.fan(x)


# ---- reports --------------------------------------------------------------------------------------------


@query("pivot_mode_kappa", """SELECT o_orderpriority AS mode, """ + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{k}'), 4) AS {k}" for k in "FOP") + " FROM orders GROUP BY 1", 4)
def _(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("mode")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))


@query("pivot_min_p", """SELECT c_mktsegment AS asset, """ + ", ".join(f"min(round(c_acctbal, 6)) FILTER (WHERE c_nationkey % 3 = {k}) AS q{k}" for k in range(3)) + " FROM customer GROUP BY 1", 6)
def _(s, d):
    c = table(s, d, "customer").withColumn("label", F.concat(F.lit("q"), F.col("c_nationkey") % 3))
    return c.groupBy(F.col("c_mktsegment").alias("asset")).pivot("label", ["q0", "q1", "q2"]).agg(F.min("c_acctbal"))


@query("formatting", """SELECT c_custkey AS id, printf('%.1f%%', CAST(c_custkey % 1000 AS DOUBLE) / 1000 * 100) AS pct, CASE WHEN c_custkey % 200 < 2 THEN '***' WHEN c_custkey % 200 < 10 THEN '**' WHEN c_custkey % 200 < 20 THEN '*' ELSE '-' END AS stars FROM customer""")
def _(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), scalar.format_pct(F.col("c_custkey") % 1000 / 1000).alias("pct"), scalar.stars(F.col("c_custkey") % 200 / 200).alias("stars"))
