"""Queries on p-values, order-one forecasts, mixtures of given parameters and points of bootstraps, with their SQL.

Tails that have no closed form are integrals in the SQL (Simpson's rule on 4,000 pieces), so they check the continued
fractions of :mod:`..functions.tails` by another way.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.arma import ARIMA
from ..operators import arima, backtest, bootstrap, forecasting, inference, mixture, mixture_tables, portfolios
from ..streaming.scoring import score_days
from .kernels import MAIN, _days
from .relational import _FC, _RET, _ST, SQL, _one_step, path, query, returns, sample, states

# ---- p-values -------------------------------------------------------------------------------------------

#: Both tails of Student's law at t with n degrees, by the angle atan(t / sqrt n); {k} names a row of {src}.
_T_TAIL = """, an AS (SELECT *, atan(abs({t}) / sqrt({n})) AS th FROM {src}), si AS (SELECT unnest(range(0, 4001)) AS i),
tl AS (SELECT {k}, 1 - 2 * max(exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0)) / sqrt(pi()) * th) / 12000 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos(th * i / 4000.0), {n} - 1)) AS p_value FROM an, si GROUP BY {k})"""


def _cte(name: str, keep: str = "") -> str:
    """The SQL of a query as one more table ``s`` of its WITH clause."""
    head, _, last = SQL[name].rpartition("\nSELECT " if "\nSELECT " in SQL[name] else " SELECT ")
    return f"{head}, s AS (SELECT {last})"


@query("anova_p", _cte("anova_f") + " SELECT *, CASE WHEN df1 = 2 THEN round(power(1 + 2 * statistic / df2, -df2 / 2.0), 4) END AS p_value FROM s", 6)
def _(s, d):
    return inference.anova(sample(s, d)).withColumn("p_value", F.round("p_value", 4))  # the SQL's tail has a closed form for three states


@query("welch_p", _cte("welch_t") + _T_TAIL.format(t="t", n="df", src="s", k="asset, regime1, regime2") + " SELECT s.*, round(p_value, 4) AS p_value FROM s JOIN tl USING (asset, regime1, regime2)", 6)
def _(s, d):
    return inference.welch(sample(s, d)).select("asset", "regime1", "regime2", "t", "df", "n1", "n2", F.round("p_value", 4).alias("p_value"))


_PAIR_F = f"""WITH {_ST}, md AS (SELECT asset, regime, quantile_cont(r, 0.5) AS med FROM smp GROUP BY 1, 2 HAVING count(*) >= 30), z AS (SELECT smp.asset, smp.regime, abs(r - med) AS z FROM smp JOIN md ON smp.asset = md.asset AND smp.regime = md.regime),
gm AS (SELECT asset, regime, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1, 2),
s AS (SELECT a.asset, a.regime AS regime1, b.regime AS regime2, CAST(a.n + b.n - 2 AS BIGINT) AS df2, least(a.n, b.n) AS min_group_n, power(a.m - b.m, 2) * a.n * b.n / (a.n + b.n) / (((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS f FROM gm a JOIN gm b ON a.asset = b.asset AND a.regime < b.regime)"""


@query("pair_brown_forsythe_p", _PAIR_F + _T_TAIL.format(t="sqrt(f)", n="df2", src="s", k="asset, regime1, regime2") + " SELECT asset, regime1, regime2, 1 AS df1, df2, 2 AS regimes_tested, min_group_n, round(f, 6) AS statistic, round(p_value, 6) AS p_value FROM s JOIN tl USING (asset, regime1, regime2)", 6)
def _(s, d):
    return inference.pair_brown_forsythe(sample(s, d))


@query("kruskal_p", _cte("kruskal_h") + " SELECT *, CASE WHEN df = 2 THEN round(exp(-statistic / 2), 4) END AS p_value FROM s", 6)
def _(s, d):
    return inference.kruskal(sample(s, d)).withColumn("p_value", F.round("p_value", 4))


@query("ks_p", _cte("ks_stat") + """, la AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * statistic AS lam FROM s),
v AS (SELECT la.* EXCLUDE (lam), CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest(2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * lam * lam)) FROM (SELECT unnest(range(1, 101)) AS i)), 0), 1) END AS p FROM la),
q AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM v), w AS (SELECT *, least(min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM q)
SELECT asset, regime1, regime2, n1, n2, round(statistic, 6) AS statistic, round(p, 6) AS p_value, round(q, 6) AS q_value, CASE WHEN q < 0.01 THEN '***' WHEN q < 0.05 THEN '**' WHEN q < 0.1 THEN '*' ELSE '-' END AS stars FROM w""", 6)
def _(s, d):
    return inference.starred(inference.kolmogorov(sample(s, d), exact=0))


@query("jarque_bera_p", _cte("jarque_bera") + " SELECT asset, statistic, round(exp(-statistic / 2), 4) AS p_value FROM s", 6)
def _(s, d):
    return inference.jarque_bera(returns(s, d)).select("asset", "statistic", F.round("p_value", 4).alias("p_value"))


#: Small samples: two series' days of a month. Lattice paths in the SQL are counted diagonal by diagonal, for each pair of sizes and gap.
_KS_EXACT = f"""WITH RECURSIVE {_RET}, x AS (SELECT strftime(dt, '%Y-%m') AS asset, CASE asset WHEN 'A_F' THEN 0 ELSE 1 END AS regime, r FROM ret WHERE asset IN ('A_F', 'R_F')),
sz AS (SELECT asset, count(*) FILTER (WHERE regime = 0) AS n1, count(*) FILTER (WHERE regime = 1) AS n2 FROM x GROUP BY 1 HAVING n1 >= 5 AND n2 >= 5),
gp AS (SELECT x.asset, n1, n2, max(abs(c1 * n2 - c2 * n1)) // greatest_common_divisor(n1, n2) AS gap FROM (SELECT asset, sum(CAST(regime = 0 AS INT)) OVER w AS c1, sum(CAST(regime = 1 AS INT)) OVER w AS c2 FROM x WINDOW w AS (PARTITION BY asset ORDER BY r)) x JOIN sz USING (asset) GROUP BY 1, 2, 3),
ks AS (SELECT DISTINCT n1, n2, gap, greatest_common_divisor(n1, n2) AS g FROM gp),
pt AS (SELECT n1, n2, gap, g, 0::BIGINT AS s, 0::BIGINT AS i, 0.0::DOUBLE AS o FROM ks
  UNION ALL SELECT n1, n2, gap, g, s + 1, i + d, CASE WHEN max(abs((i + d) * (n2 // g) - (s + 1 - i - d) * (n1 // g))) >= gap THEN 1 ELSE sum(o * CASE d WHEN 1 THEN i + d ELSE s + 1 - i - d END / (s + 1)) END
  FROM pt, (SELECT unnest([0, 1]::BIGINT[]) AS d) WHERE s < n1 + n2 AND i + d <= n1 AND s + 1 - i - d <= n2 GROUP BY n1, n2, gap, g, s, i + d)
SELECT gp.asset AS month, CAST(gp.n1 AS BIGINT) AS n1, CAST(gp.n2 AS BIGINT) AS n2, round(gp.gap * greatest_common_divisor(gp.n1, gp.n2) / (gp.n1 * gp.n2), 6) AS statistic, round(o, 6) AS p_value FROM gp JOIN pt ON gp.n1 = pt.n1 AND gp.n2 = pt.n2 AND gp.gap = pt.gap AND pt.s = gp.n1 + gp.n2"""


@query("ks_exact_p", _KS_EXACT, 6)
def _(s, d):
    two = returns(s, d).filter("asset in ('A_F', 'R_F')").select(F.date_format("dt", "yyyy-MM").alias("asset"), (F.col("asset") == "R_F").cast("int").alias("regime"), "r")
    return inference.kolmogorov(two, 5).select(F.col("asset").alias("month"), "n1", "n2", "statistic", "p_value")


_K2 = f"""WITH {_RET}, m AS (SELECT asset, CAST(count(*) AS DOUBLE) AS n, avg(r) AS mu FROM ret GROUP BY 1),
c AS (SELECT asset, max(n) AS n, avg(power(r - mu, 3)) / power(avg(power(r - mu, 2)), 1.5) AS g1, avg(power(r - mu, 4)) / power(avg(power(r - mu, 2)), 2) AS b2 FROM ret JOIN m USING (asset) GROUP BY 1),
k AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (power(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM c),
a AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM k),
z AS (SELECT asset, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM a)
SELECT asset, CAST(n AS BIGINT) AS n, round(z1, 6) AS z_skew, round(z2, 6) AS z_kurtosis, round(z1 * z1 + z2 * z2, 6) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z"""


@query("dagostino_k2", _K2, 6)
def _(s, d):
    return inference.dagostino(returns(s, d))


#: Both tails of the normal law at z, by the integral of its density over 0 to |z|.
_N_TAIL = "1 - 2 * abs(z) / 12000 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 4000.0, 2) / 2))"


@query("normal_p", f"WITH z AS (SELECT c_custkey AS id, (c_custkey % 97 - 48) / 8.0 AS z FROM customer), si AS (SELECT unnest(range(0, 4001)) AS i), u AS (SELECT z, {_N_TAIL} AS p FROM (SELECT DISTINCT z FROM z), si GROUP BY z) SELECT id, round(p, 9) AS p_value FROM z JOIN u USING (z)")
def _(s, d):
    from ..functions.tails import normal_sf2
    from ..sources.tables import table

    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("id"), ((c % 97 - 48) / 8.0).alias("z")).withColumn("p_value", normal_sf2("z")).drop("z")


def _sql_polynomial(coefficients: tuple[float, ...], x: str) -> str:
    return " + ".join(f"({c}) * power({x}, {k})" for k, c in enumerate(coefficients))


#: Normal scores in the SQL from a table of the integral of the density in steps of 1e-4, with lines between.
_SW = f"""WITH {_RET}, gz AS (SELECT i / 10000.0::DOUBLE AS z, 0.5 + coalesce(sum(h) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, h FROM
  (SELECT i, (exp(-power(i / 10000.0, 2) / 2) + 4 * exp(-power((i + 0.5) / 10000, 2) / 2) + exp(-power((i + 1) / 10000.0, 2) / 2)) / 60000 / sqrt(2 * pi()) AS h FROM (SELECT unnest(range(0, 60000))::DOUBLE AS i))),
x AS (SELECT asset || strftime(dt, ' %Y-%m') AS asset, r FROM ret), o AS (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY r) AS i, CAST(count(*) OVER (PARTITION BY asset) AS DOUBLE) AS n FROM x), q AS (SELECT *, (i - 0.375) / (n + 0.25) AS pl, 0.5 + abs((i - 0.375) / (n + 0.25) - 0.5) AS pp FROM o WHERE n > 11),
m AS (SELECT asset, r, i, n, sign(pl - 0.5) * (gz.z + (pp - gz.p) / gz.h / 10000) AS m FROM q ASOF JOIN gz ON q.pp >= gz.p),
s AS (SELECT asset, max(n) AS n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, var_pop(r) * max(n) AS ss FROM m GROUP BY 1),
a AS (SELECT *, {_sql_polynomial(inference._LAST, '(1 / sqrt(n))')} + m1 / sqrt(mm) AS a1, {_sql_polynomial(inference._LAST_BUT_ONE, '(1 / sqrt(n))')} + m2 / sqrt(mm) AS a2 FROM s),
w AS (SELECT m.asset, max(a.n) AS n, power(sum(r * CASE WHEN i = 1 THEN -a1 WHEN i = m.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = m.n - 1 THEN a2 ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END), 2) / max(ss) AS w FROM m JOIN a USING (asset) GROUP BY 1),
zz AS (SELECT asset, n, w, (ln(1 - w) - ({_sql_polynomial(inference._MEAN, 'ln(n)')})) / exp({_sql_polynomial(inference._SD, 'ln(n)')}) AS z FROM w), si AS (SELECT unnest(range(0, 4001)) AS i)
SELECT asset, CAST(n AS BIGINT) AS n, round(w, 6) AS statistic, round(CASE WHEN z > 0 THEN ({_N_TAIL}) / 2 ELSE 1 - ({_N_TAIL}) / 2 END, 5) AS p_value FROM zz, si GROUP BY asset, n, w, z"""


@query("shapiro_wilk", _SW, 6)
def _(s, d):
    months = returns(s, d).select(F.concat("asset", F.date_format("dt", " yyyy-MM")).alias("asset"), "r")
    return inference.shapiro_wilk(months).filter("n > 11").withColumn("p_value", F.round("p_value", 5))


# ---- paths and points of bootstraps ---------------------------------------------------------------------


@query("performance_class", SQL["performance_metrics"].replace("248.48", "252"), 6)
def _(s, d):
    out = backtest.performance(path(s, d), ann=backtest.ANN_CLASS)
    return out.select(F.round(F.ln(1 + F.col("total_return")), 9).alias("log_total"), *out.columns[1:])


def _possible(p: str = "p_value"):
    """Whether a p-value and the bounds beside it can be right, which random draws leave to check."""
    return (F.col(p).between(0, 1) & (F.col("ci_low") <= F.col("ci_high"))).alias("possible")


_POINT = f"WITH {_RET}, x AS (SELECT dt, asset, r FROM ret WHERE asset IN ('A_F', 'R_F')){{more}} SELECT round(a, 6) AS value_a, round(b, 6) AS value_b, round(a - b, 6) AS diff, true AS possible FROM (SELECT max(v) FILTER (WHERE asset = 'A_F') AS a, max(v) FILTER (WHERE asset = 'R_F') AS b FROM ({{v}}))"


def _point(kind):
    def run(s, d):
        paths = returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net"))
        return bootstrap.path_difference(paths, "A_F", "R_F", kind).select("value_a", "value_b", "diff", _possible())

    return run


query("sharpe_difference", _POINT.format(more="", v="SELECT asset, avg(r) / stddev_pop(r) * sqrt(252) AS v FROM x GROUP BY 1"), 6)(_point("sharpe"))
query("drawdown_difference", _POINT.format(more=", w AS (SELECT asset, dt, exp(sum(r) OVER (PARTITION BY asset ORDER BY dt)) AS w FROM x), p AS (SELECT asset, w / max(w) OVER (PARTITION BY asset ORDER BY dt) - 1 AS d FROM w)", v="SELECT asset, -min(d) AS v FROM p GROUP BY 1"), 6)(_point("drawdown"))
query("cvar_difference", _POINT.format(more=", q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM x GROUP BY 1)", v="SELECT x.asset, -avg(r) AS v FROM x JOIN q ON x.asset = q.asset AND r <= q + 1e-15 GROUP BY 1"), 6)(_point("cvar"))


@query("correlation_differences", f"""WITH {_ST}, c AS (SELECT x.asset || '|' || y.asset AS name, x.regime AS k, corr(x.r, y.r) AS c FROM smp x JOIN smp y ON x.dt = y.dt AND x.asset < y.asset GROUP BY 1, 2),
pr AS (SELECT name, max(c) FILTER (WHERE k = 0) AS lo, max(c) FILTER (WHERE k = 2) AS hi FROM c GROUP BY 1), u AS (SELECT * FROM pr UNION ALL SELECT 'mean_abs', avg(abs(lo)), avg(abs(hi)) FROM pr)
SELECT name, round(lo, 6) AS rho_low, round(hi, 6) AS rho_high, round(hi - lo, 6) AS diff, true AS possible FROM u""", 6)
def _(s, d):
    t = bootstrap.correlation_differences(sample(s, d), 0, 2)
    return t.select("name", "rho_low", "rho_high", "diff", F.col("p_value").between(0, 1).alias("possible"))


def _drawn(out: str, src: str, keep: str, seed: int, **streams: str) -> str:
    """CTEs that end in ``out``: the rows of ``src`` (rep, place, ...) with uniform numbers, one for each named stream."""
    steps, at = [], src

    def step(what: dict[str, str]) -> None:
        nonlocal at
        steps.append(f"{out}{len(steps)} AS (SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in what.items())} FROM {at})")
        at = f"{out}{len(steps) - 1}"

    def mix(names: list[str], others: list[str]) -> None:
        for shift, times in ((16, bootstrap.MIX[0]), (15, bootstrap.MIX[1]), (16, None)):
            step({n: f"xor({n}, {n} >> {shift})" + (f" * {times}::UBIGINT & 4294967295::UBIGINT" if times else "") for n in names} | {n: n for n in others})

    word = lambda *x: "(" + " + ".join(f"CAST({v} AS UBIGINT) * {k}::UBIGINT" for v, k in zip(x, bootstrap.KEYS)) + ") & 4294967295::UBIGINT"
    names = list(streams)
    step({f"{n}{i}": word(*x) for n, s in streams.items() for i, x in ((1, (seed, "rep", s)), (2, (s, seed, "rep")))} | {"counter": f"CAST(place AS UBIGINT) * {bootstrap.KEYS[3]}::UBIGINT"})
    mix([f"{n}{i}" for n in names for i in (1, 2)], ["counter"])
    step({n: f"({n}1 + counter) & 4294967295::UBIGINT" for n in names} | {f"{n}2": f"{n}2" for n in names})
    mix(names, [f"{n}2" for n in names])
    step({n: f"({n} + {n}2) & 4294967295::UBIGINT" for n in names})
    mix(names, [])
    return ", ".join(steps) + f", {out} AS (SELECT {keep}, {', '.join(f'{n} / 4294967296.0::DOUBLE AS {n}' for n in names)} FROM {at})"


#: p and interval of replicates (name, v): twice the smaller share on one side of 0.
_TWO_SIDED = "SELECT name, least(1.0, 2 * least(avg(CAST(v <= 0 AS DOUBLE)), avg(CAST(v >= 0 AS DOUBLE)))) AS p_value, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, count(*) AS n FROM {} GROUP BY name"
_SIDES = range(1, 7)
_PAIRS = [(i, j) for i in _SIDES for j in _SIDES if i < j]


def _correlations_sql(b: int = 10_000) -> str:
    each = lambda src, by: f"SELECT {by}, regime, {', '.join(f'corr(x{i}, x{j}) AS c{i}{j}' for i, j in _PAIRS)} FROM {src} WHERE regime IN (0, 2) GROUP BY {by}, regime"
    both = lambda src, by: f"SELECT {by}, unnest([{', '.join(repr(f'{i}{j}') for i, j in _PAIRS)}]) AS k, unnest([{', '.join(f'max(c{i}{j}) FILTER (WHERE regime = 0)' for i, j in _PAIRS)}]) AS lo, unnest([{', '.join(f'max(c{i}{j}) FILTER (WHERE regime = 2)' for i, j in _PAIRS)}]) AS hi FROM {src} GROUP BY {by}"
    whole = lambda src, by: f"SELECT {by}, k, lo, hi FROM {src} UNION ALL SELECT {by}, 'mean_abs', avg(abs(lo)), avg(abs(hi)) FROM {src} GROUP BY {by}"
    return f"""WITH {_ST}, nm AS (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM (SELECT DISTINCT asset FROM smp)),
wd AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS t, any_value(regime) AS regime, {', '.join(f'max(r) FILTER (WHERE i = {i}) AS x{i}' for i in _SIDES)} FROM smp JOIN nm USING (asset) GROUP BY dt), nn AS (SELECT count(*) AS n FROM wd),
pl AS (SELECT rep, place FROM (SELECT unnest(range(0, {b})) AS rep), (SELECT unnest(range(0, n)) AS place FROM nn)), {_drawn('dr', 'pl', 'rep, place', 42, u='0', v='1')},
hd AS (SELECT rep, place, n, CAST(floor(u * n) AS BIGINT) AS start, place = 0 OR v < 1 / floor(sqrt(n)) AS first FROM dr, nn),
ix AS (SELECT rep, (last_value(CASE WHEN first THEN start - place END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + place + n) % n AS t FROM hd),
rs AS (SELECT ix.rep, wd.* FROM ix JOIN wd USING (t)), rc AS ({each('rs', 'rep')}), rb AS ({both('rc', 'rep')}), ra AS ({whole('rb', 'rep')}), rp AS (SELECT k AS name, hi - lo AS v FROM ra), su AS ({_TWO_SIDED.format('rp')}),
pc AS ({each('wd', '0 AS rep').replace('GROUP BY 0 AS rep, regime', 'GROUP BY regime')}), pb AS ({both('pc', 'rep')}), pa AS ({whole('pb', 'rep')}),
q AS (SELECT name, p_value, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM su WHERE name <> 'mean_abs'), qq AS (SELECT name, least(min(p_value * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_value FROM q)
SELECT CASE WHEN k = 'mean_abs' THEN k ELSE (SELECT asset FROM nm WHERE CAST(i AS VARCHAR) = left(k, 1)) || '|' || (SELECT asset FROM nm WHERE CAST(i AS VARCHAR) = right(k, 1)) END AS name, round(lo, 6) AS rho_low, round(hi, 6) AS rho_high, round(hi - lo, 6) AS diff,
  round(p_value, 6) AS p_value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, su.n, round(q_value, 6) AS q_value FROM pa JOIN su ON su.name = k LEFT JOIN qq ON qq.name = k"""


SQL["bootstrap_corr"] = _correlations_sql()

#: Two paths by day, and the places of the replicates' draws: all of them, or whole blocks.
_TWO_PATHS = f"""WITH {_RET}, ab AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS t, max(r) FILTER (WHERE asset = 'A_F') AS a, max(r) FILTER (WHERE asset = 'R_F') AS b FROM ret GROUP BY dt), nn AS (SELECT count(*) AS n, greatest(5, CAST(floor(sqrt(count(*))) AS BIGINT)) AS bl FROM ab),
rr AS (SELECT unnest(range(0, 10000)) AS rep)"""
_ANY_DAY = f", pl AS (SELECT rep, place FROM rr, (SELECT unnest(range(0, n)) AS place FROM nn)), {_drawn('dr', 'pl', 'rep, place', 42, u='0')}, rs AS (SELECT rep, place, a, b FROM (SELECT rep, place, CAST(floor(u * n) AS BIGINT) AS t FROM dr, nn) JOIN ab USING (t))"
_BLOCKS = f", pl AS (SELECT rep, place FROM rr, (SELECT unnest(range(0, n // bl)) AS place FROM nn)), {_drawn('dr', 'pl', 'rep, place', 42, u='0')}, bk AS (SELECT rep, place * bl + j AS place, CAST(floor(u * (n - bl + 1)) AS BIGINT) + j AS t FROM dr, nn, (SELECT unnest(range(0, bl)) AS j FROM nn)), rs AS (SELECT rep, place, a, b FROM bk JOIN ab USING (t))"
_WHOLE_PATH = ", al AS (SELECT rep, place, a, b FROM rs UNION ALL SELECT -1, t, a, b FROM ab)"
_SHARPE = ", st AS (SELECT rep, avg(a) / stddev_pop(a) * sqrt(252) AS va, avg(b) / stddev_pop(b) * sqrt(252) AS vb FROM al GROUP BY rep)"
_CVAR = ", qt AS (SELECT rep, quantile_cont(a, 0.05) AS qa, quantile_cont(b, 0.05) AS qb FROM al GROUP BY rep), st AS (SELECT rep, -avg(a) FILTER (WHERE a <= qa) AS va, -avg(b) FILTER (WHERE b <= qb) AS vb FROM al JOIN qt USING (rep) GROUP BY rep)"
_FALL = ", cu AS (SELECT rep, place, exp(sum(a) OVER w) AS a, exp(sum(b) OVER w) AS b FROM al WINDOW w AS (PARTITION BY rep ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), pk AS (SELECT rep, a / max(a) OVER w - 1 AS a, b / max(b) OVER w - 1 AS b FROM cu WINDOW w AS (PARTITION BY rep ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), st AS (SELECT rep, -min(a) AS va, -min(b) AS vb FROM pk GROUP BY rep)"
_OF_PATHS = """, po AS (SELECT va, vb, va - vb AS diff FROM st WHERE rep = -1)
SELECT round(max(po.va), 6) AS value_a, round(max(po.vb), 6) AS value_b, round(max(diff), 6) AS diff, round(least(2 * {p}, 1), 6) AS p_value, round(quantile_cont(st.va - st.vb, 0.025), 6) AS ci_low, round(quantile_cont(st.va - st.vb, 0.975), 6) AS ci_high FROM st, po WHERE rep >= 0"""
_OPPOSITE = "avg(CAST(CASE WHEN diff >= 0 THEN st.va - st.vb <= 0 ELSE st.va - st.vb >= 0 END AS DOUBLE))"
_BEYOND = "least(avg(CAST(st.va - st.vb >= abs(diff) AS DOUBLE)), avg(CAST(st.va - st.vb <= -abs(diff) AS DOUBLE)))"
SQL["bootstrap_sharpe"] = _TWO_PATHS + _ANY_DAY + _WHOLE_PATH + _SHARPE + _OF_PATHS.format(p=_OPPOSITE)
SQL["bootstrap_cvar"] = _TWO_PATHS + _ANY_DAY + _WHOLE_PATH + _CVAR + _OF_PATHS.format(p=_BEYOND)
SQL["bootstrap_drawdown"] = _TWO_PATHS + _BLOCKS + _WHOLE_PATH + _FALL + _OF_PATHS.format(p=_BEYOND)

#: Each test draws its two states from two streams of its own.
SQL["bootstrap_quantiles"] = f"""WITH {_ST}, gk AS (SELECT asset, regime, count(*) AS n FROM smp GROUP BY 1, 2 HAVING count(*) >= 50),
ts AS (SELECT x.asset, x.regime AS k1, y.regime AS k2, row_number() OVER (ORDER BY x.asset, x.regime, y.regime) - 1 AS i FROM gk x JOIN gk y ON x.asset = y.asset AND x.regime < y.regime),
sd AS (SELECT i, asset, k1, k2, s, CASE s WHEN 0 THEN k1 ELSE k2 END AS regime, 2 * i + s AS stream FROM ts, (SELECT unnest([0, 1]) AS s)),
x AS (SELECT asset, regime, r, row_number() OVER (PARTITION BY asset, regime ORDER BY dt) - 1 AS t FROM smp),
pl AS (SELECT rep, place, stream, i, s, asset, regime, n FROM (SELECT sd.*, n, unnest(range(0, n)) AS place FROM sd JOIN gk USING (asset, regime)), (SELECT unnest(range(0, 1000)) AS rep)), {_drawn('dr', 'pl', 'rep, i, s, asset, regime, n', 42, u='stream')},
qs AS (SELECT rep, i, s, quantile_cont(r, [0.05, 0.1, 0.25]) AS q FROM (SELECT rep, i, s, asset, regime, CAST(floor(u * n) AS BIGINT) AS t FROM dr) JOIN x USING (asset, regime, t) GROUP BY 1, 2, 3),
df AS (SELECT a.rep, a.i, unnest(['0.05', '0.1', '0.25']) AS level, unnest(a.q) - unnest(b.q) AS v FROM qs a JOIN qs b ON a.rep = b.rep AND a.i = b.i AND a.s = 0 AND b.s = 1),
rp AS (SELECT asset || '|' || k1 || '|' || k2 || '|' || level AS name, v FROM df JOIN ts USING (i)), su AS ({_TWO_SIDED.format('rp')})
SELECT name, round(p_value, 6) AS p_value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM su"""


#: Month ends that rebalance and recompute, with signals from the first, an early and a late day on.
_GATE = f"""WITH RECURSIVE {_ST}, rd AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS place FROM (SELECT DISTINCT dt FROM ret)),
sg AS (SELECT st.dt, p_1, place, since, row_number() OVER (PARTITION BY since ORDER BY st.dt) - 1 AS t FROM st JOIN rd ON st.dt = rd.dt, (SELECT unnest([0, 300, 1201]) AS since) WHERE place >= since),
en AS (SELECT since, t, place, dt, p_1 FROM sg QUALIFY row_number() OVER (PARTITION BY since, date_trunc('month', dt) ORDER BY dt DESC) = 1),
el AS (SELECT *, row_number() OVER (PARTITION BY since ORDER BY t) AS i FROM en WHERE place >= 252),
wk AS (SELECT since, i, t, t = 0 OR t >= 63 AS redo, CASE WHEN t >= 63 THEN t ELSE 0 END AS last FROM el WHERE i = 1
  UNION ALL SELECT el.since, el.i, el.t, el.t - last >= 63, CASE WHEN el.t - last >= 63 THEN el.t ELSE last END FROM wk JOIN el ON el.since = wk.since AND el.i = wk.i + 1)
SELECT since, el.dt, CAST(el.t AS INT) AS t, CAST(place AS INT) AS place, redo AS recomputed, last_value(CASE WHEN redo THEN el.dt END IGNORE NULLS) OVER (PARTITION BY since ORDER BY el.t) AS portfolio_dt FROM wk JOIN el USING (since, i)"""


@query("recompute_gate", _GATE)
def _(s, d):
    r, signal = returns(s, d), states(s, d).select("dt", "p_1")
    days = portfolios.live_days(r, signal)
    out = None
    for since in (0, 300, 1201):
        late = portfolios.live_days(r, signal.join(days.filter(F.col("place") >= since).select("dt"), "dt"))
        gate = portfolios.recompute_gate(late).select(F.lit(since).alias("since"), "dt", "t", "place", "recomputed", "portfolio_dt")
        out = gate if out is None else out.unionByName(gate)
    return out


# ---- forecasts of order one -----------------------------------------------------------------------------

_ORIGINS = f"WITH {_FC}, og AS (SELECT t, dt, p_1, y, a, b FROM ab WHERE t >= 250 AND (t - 250) % 20 = 0), hs AS (SELECT CAST(unnest(range(1, 22)) AS INT) AS h)"
_AHEAD = "1 / (1 + exp(-({0}a * (1 - power({0}b, h)) / (1 - {0}b) + power({0}b, h) * og.y)))"
_SNAIL = f", sn AS (SELECT og.dt AS origin_dt, h, f.dt AS forecast_dt, {_AHEAD.format('og.')} AS p_hat, 'ar' AS method, f.p_1 AS p FROM og CROSS JOIN hs LEFT JOIN y f ON f.t = og.t + h)"
_AWARE = f""", ky AS (SELECT t, p_1 > 0.5 AS high, y, lag(y) OVER (PARTITION BY p_1 > 0.5 ORDER BY t) AS ly FROM y),
kf AS (SELECT t, high, regr_slope(y, ly) OVER w AS b, regr_intercept(y, ly) OVER w AS a, count(*) OVER w AS n FROM ky WINDOW w AS (PARTITION BY high ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cf AS (SELECT og.t, {{}} FROM og ASOF LEFT JOIN (SELECT * FROM kf WHERE NOT high) c ON og.t >= c.t ASOF LEFT JOIN (SELECT * FROM kf WHERE high) s ON og.t >= s.t),
ra AS (SELECT og.dt AS origin_dt, og.p_1, h, f.dt AS forecast_dt, f.p_1 AS p, {_AHEAD.format('cf.c')} AS calm, {_AHEAD.format('cf.s')} AS stress FROM og JOIN cf ON og.t = cf.t CROSS JOIN hs LEFT JOIN y f ON f.t = og.t + h)""".format(", ".join(f"CASE WHEN {k}.n >= 30 THEN {k}.{x} ELSE og.{x} END AS {k}{x}" for k in "cs" for x in "ab"))


@query("snail_trail", f"{_ORIGINS}{_SNAIL} SELECT 'p' AS series, origin_dt, h, forecast_dt, round(p_hat, 6) AS p_hat, method FROM sn", 6)
def _(s, d):
    return forecasting.snail_trail(states(s, d))


@query("regime_aware_forecasts", f"{_ORIGINS}{_AWARE} SELECT 'p' AS series, origin_dt, h, forecast_dt, round((1 - p_1) * calm + p_1 * stress, 6) AS p_hat, 'regime_blend' AS method FROM ra", 6)
def _(s, d):
    return forecasting.regime_aware(states(s, d))


@query("compare_methods", f"""{_ORIGINS}{_SNAIL}{_AWARE}, al AS (SELECT method, h, p_hat, p FROM sn UNION ALL SELECT 'regime_blend', h, (1 - p_1) * calm + p_1 * stress, p FROM ra UNION ALL SELECT 'regime_switch', h, CASE WHEN p_1 > 0.5 THEN stress ELSE calm END, p FROM ra)
SELECT method, h, count(*) AS n, round(avg(abs(p_hat - p)), 6) AS mae, round(avg(power(p_hat - p, 2)), 6) AS mse, round(sqrt(avg(power(p_hat - p, 2))), 6) AS rmse, round(covar_samp(p_hat, p) / (stddev_samp(p_hat) * stddev_samp(p)), 6) AS corr FROM al WHERE p IS NOT NULL GROUP BY 1, 2""", 6)
def _(s, d):
    return forecasting.compare_methods(states(s, d))


#: The exact likelihood of an AR(1) from six sums, on a fine grid of its coefficient, and the greatest of it.
@query("logit_likelihood", f"""WITH {_FC}, su AS (SELECT CAST(count(*) AS DOUBLE) AS n, arg_min(y, t) AS y0, sum(y) FILTER (WHERE ly IS NOT NULL) AS sy, sum(ly) AS sx, sum(ly * ly) AS sxx, sum(ly * y) AS sxy, sum(y * y) FILTER (WHERE ly IS NOT NULL) AS syy FROM l),
gr AS (SELECT unnest(range(-99999, 100000)) / 100000.0::DOUBLE AS phi), me AS (SELECT *, 1 - phi AS sh, 1 - phi * phi AS inv, sy - phi * sx AS rest, ((1 - phi) * (sy - phi * sx) + (1 - phi * phi) * y0) / (power(1 - phi, 2) * (n - 1) + 1 - phi * phi) AS mean FROM gr, su),
va AS (SELECT *, (syy - 2 * phi * sxy + phi * phi * sxx - 2 * sh * mean * rest + (n - 1) * power(sh * mean, 2) + inv * power(y0 - mean, 2)) / n AS v FROM me), lv AS (SELECT phi, n, -n / 2 * (ln(2 * pi() * v) + 1) + ln(inv) / 2 AS level FROM va)
SELECT CAST(max(n) AS INT) AS n, round(arg_max(phi, level), 3) AS phi, round(max(level), 4) AS log_likelihood FROM lv""")
def _(s, d):
    f = forecasting.fit_logit(states(s, d))
    return f.select("n", F.round(F.col("coefficients")[0], 3).alias("phi"), F.round("log_likelihood", 4).alias("log_likelihood"))


#: Likelihoods of three orders on a grid of their one coefficient: sums for autoregressions (of levels with a mean, of
#: differences without one), and for the moving average the recursion of innovations w and their variances f, day by day.
_ARIMA_GRID = f"""WITH RECURSIVE {_FC}, gr AS (SELECT unnest(range(-9, 10)) / 10.0::DOUBLE AS c),
su AS (SELECT CAST(count(*) AS DOUBLE) AS n, arg_min(y, t) AS y0, sum(y) FILTER (WHERE ly IS NOT NULL) AS sy, sum(ly) AS sx, sum(ly * ly) AS sxx, sum(ly * y) AS sxy, sum(y * y) FILTER (WHERE ly IS NOT NULL) AS syy FROM l),
me AS (SELECT *, (1 - c) * (sy - c * sx) AS up, 1 - c * c AS inv FROM gr, su), mn AS (SELECT *, (up + inv * y0) / (power(1 - c, 2) * (n - 1) + inv) AS mean FROM me),
ar AS (SELECT c, n, (syy - 2 * c * sxy + c * c * sxx - 2 * (1 - c) * mean * (sy - c * sx) + (n - 1) * power((1 - c) * mean, 2) + inv * power(y0 - mean, 2)) / n AS v, ln(inv) / 2 AS half FROM mn),
z AS (SELECT t, y - ly AS z, lag(y - ly) OVER (ORDER BY t) AS lz, row_number() OVER (ORDER BY t) AS i FROM l WHERE ly IS NOT NULL),
ad AS (SELECT c, CAST(count(*) AS DOUBLE) AS n, (sum(power(z - c * lz, 2)) FILTER (WHERE lz IS NOT NULL) + (1 - c * c) * power(arg_min(z, i), 2)) / count(*) AS v, ln(1 - c * c) / 2 AS half FROM z, gr GROUP BY c),
ma AS (SELECT c, 1::BIGINT AS i, 1 + c * c AS f, z AS w, power(z, 2) / (1 + c * c) AS q, ln(1 + c * c) AS ld FROM z, gr WHERE i = 1
  UNION ALL SELECT c, z.i, 1 + c * c - c * c / ma.f, z.z - c * ma.w / ma.f, q + power(z.z - c * ma.w / ma.f, 2) / (1 + c * c - c * c / ma.f), ld + ln(1 + c * c - c * c / ma.f) FROM ma JOIN z ON z.i = ma.i + 1),
md AS (SELECT c, CAST(i AS DOUBLE) AS n, q / i AS v, -ld / 2 AS half FROM ma WHERE i = (SELECT max(i) FROM z)),
al AS (SELECT '1,0,0' AS model, * FROM ar UNION ALL SELECT '1,1,0', * FROM ad UNION ALL SELECT '0,1,1', * FROM md)
SELECT model, round(c, 1) AS coefficient, round(-n / 2 * (ln(2 * pi() * v) + 1) + half, 4) AS log_likelihood, true AS below_fit FROM al"""


@query("arima_likelihood", _ARIMA_GRID)
def _(s, d):
    """Likelihoods of given coefficients, and whether the fitted ones have a greater."""
    orders, grid = ((1, 0, 0), (1, 1, 0), (0, 1, 1)), np.arange(-9, 10) / 10

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, k, q = orders[key[0]]
        m = ARIMA(forecasting.logit(pdf.sort_values("dt")["p_1"].to_numpy(float)), p, k, q).fit()
        levels = m.profile(*(grid[:, None] if n else np.zeros((len(grid), 0)) for n in (p, q)))[2]
        return pd.DataFrame({"model": f"{p},{k},{q}", "coefficient": grid, "log_likelihood": levels.round(4), "below_fit": levels <= m.level})

    dealt = states(s, d).select("dt", "p_1", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    return dealt.groupBy("i").applyInPandas(run, "model string, coefficient double, log_likelihood double, below_fit boolean")


def _refined(level: str, rounds: int) -> str:
    """The greatest of a function of ``c`` for each origin, on grids that grow finer around the best point so far."""
    out, step = "c0 AS (SELECT t, 0.0::DOUBLE AS c FROM cs)", 0.1
    for i in range(1, rounds + 1):
        reach = 9 if i == 1 else 10
        out += f", g{i} AS (SELECT cs.*, least(greatest(c{i - 1}.c + k * {step}, -0.999999), 0.999999) AS c FROM cs JOIN c{i - 1} USING (t), (SELECT unnest(range(-{reach}, {reach + 1})) AS k)), c{i} AS (SELECT t, arg_max(c, {level}) AS c FROM m{i} GROUP BY t)".replace(f", c{i} AS", f", m{i} AS (SELECT *, ((1 - c) * (sy - c * sx) + (1 - c * c) * y0) / (power(1 - c, 2) * (n - 1) + 1 - c * c) AS mean FROM g{i}), c{i} AS")
        step /= 8
    return out


#: The exact AR(1) of every origin's past from running sums; its coefficient by grids, finer eight times over.
_AR1_LEVEL = "-n * ln((syy - 2 * c * sxy + c * c * sxx - 2 * (1 - c) * mean * (sy - c * sx) + (n - 1) * power((1 - c) * mean, 2) + (1 - c * c) * power(y0 - mean, 2)) / n) + ln(1 - c * c)"
_AR1_WALK = f"""WITH {_FC}, cs AS (SELECT * FROM (SELECT t, dt, p_1, y, lead(p_1) OVER o AS nxt, CAST(t + 1 AS DOUBLE) AS n, first_value(y) OVER w AS y0, sum(CASE WHEN ly IS NOT NULL THEN y END) OVER w AS sy, sum(ly) OVER w AS sx, sum(ly * ly) OVER w AS sxx, sum(ly * y) OVER w AS sxy, sum(CASE WHEN ly IS NOT NULL THEN y * y END) OVER w AS syy
  FROM l WINDOW o AS (ORDER BY t), w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE t >= 250 AND nxt IS NOT NULL),
{_refined(_AR1_LEVEL, 8)}, wf AS (SELECT p_1 AS rw, CAST(nxt > 0.5 AS INT) AS z, 1 / (1 + exp(-(mean + c * (y - mean)))) AS p FROM m8 JOIN c8 USING (t, c))"""
_LOSS = "avg(-(z * ln(least(greatest({0}, 1e-8), 1 - 1e-8)) + (1 - z) * ln(1 - least(greatest({0}, 1e-8), 1 - 1e-8))))"


@query("ar1_exact_scores", f"{_AR1_WALK} SELECT count(*) AS n_forecasts, round(avg(power(z - p, 2)), 5) AS brier_ar, round(avg(power(z - rw, 2)), 5) AS brier_rw, round({_LOSS.format('p')}, 5) AS logloss_ar, round({_LOSS.format('rw')}, 4) AS logloss_rw, round(1 - avg(power(z - p, 2)) / avg(power(z - rw, 2)), 4) AS skill, round(avg(CAST((p >= 0.5) = (z = 1) AS DOUBLE)), 5) AS hit_ar FROM wf")
def _(s, d):
    t = arima.against_random_walk(states(s, d), None)[1]
    five, four = ("brier_ar", "brier_rw", "logloss_ar", "hit_ar"), (("logloss_rw", "logloss_rw"), ("brier_skill_vs_rw", "skill"))
    return t.select("n_forecasts", *(F.round(c, 5).alias(c) for c in five), *(F.round(c, 4).alias(a) for c, a in four))


# ---- mixtures -------------------------------------------------------------------------------------------

#: A mixture of given parameters: shares, and for each of the six series a mean and a variance by state.
_GIVEN = mixture.State(np.array([[0.01, -0.01, 0.0, 0.02, 0.0, 0.01], [0.1, 0.0, -0.2, 0.0, 0.1, 0.0]]), np.array([np.diag([0.2, 0.3, 0.25, 0.2, 0.3, 0.2]), np.diag([1.0, 1.5, 1.2, 0.9, 1.1, 1.0])]), np.array([0.7, 0.3]))


def _density(k: int) -> str:
    g = _GIVEN
    terms = (f"WHEN {i + 1} THEN -0.5 * (power(r - ({g.means[k][i]}), 2) / ({g.covs[k][i][i]} + 1e-6) + ln(2 * pi() * ({g.covs[k][i][i]} + 1e-6)))" for i in range(6))
    return f"ln({g.weights[k]}) + sum(CASE i {' '.join(terms)} END)"


@query("given_mixture_scores", f"""WITH {_RET}, x AS (SELECT dt, r, row_number() OVER (PARTITION BY dt ORDER BY asset) AS i FROM ret), l AS (SELECT dt, {_density(0)} AS l0, {_density(1)} AS l1 FROM x GROUP BY 1)
SELECT dt, round(1 / (1 + exp(l1 - l0)), 6) AS p_0, CAST(l1 > l0 AS INT) AS regime, round(greatest(l0, l1) + ln(1 + exp(-abs(l0 - l1))), 6) AS log_density FROM l""", 6)
def _(s, d):
    return score_days(_days(s, d), _GIVEN).select("dt", F.col("p")[0].alias("p_0"), "regime", "log_density")


def _round_sql() -> str:
    """One round of the regularised fit of all six series from the given parameters: shares, means and whole covariances."""
    c = mixture.HEADLINE
    order = "ORDER BY tr"
    return f"""WITH {_RET}, x AS (SELECT dt, r, row_number() OVER (PARTITION BY dt ORDER BY asset) AS i FROM ret), l AS (SELECT dt, {_density(0)} AS l0, {_density(1)} AS l1 FROM x GROUP BY 1),
s AS (SELECT dt, 0 AS k, 1 / (1 + exp(l1 - l0)) AS p FROM l UNION ALL SELECT dt, 1, 1 / (1 + exp(l0 - l1)) FROM l), nk AS (SELECT k, sum(p) AS nk FROM s GROUP BY 1), gm AS (SELECT i, avg(r) AS g FROM x GROUP BY 1),
sp AS (SELECT a.i, b.i AS j, covar_samp(a.r, b.r) AS c FROM x a JOIN x b USING (dt) GROUP BY 1, 2), yb AS (SELECT k, i, sum(p * r) / sum(p) AS y FROM x JOIN s USING (dt) GROUP BY 1, 2),
sc AS (SELECT s.k, a.i, b.i AS j, sum(p * (a.r - ya.y) * (b.r - yb.y)) AS sc FROM s JOIN x a USING (dt) JOIN x b USING (dt) JOIN yb ya ON ya.k = s.k AND ya.i = a.i JOIN yb ON yb.k = s.k AND yb.i = b.i GROUP BY 1, 2, 3),
cv AS (SELECT sc.k, sc.i, sc.j, ({c.lambda_scale} * c / power(2, 2.0 / 6) + sc + {c.kappa} * nk / ({c.kappa} + nk) * (ya.y - ga.g) * (yb.y - gb.g)) / (6 + {c.nu_extra} + nk + 6 + 2) + CASE WHEN sc.i = sc.j THEN {c.reg} ELSE 0 END AS cov
  FROM sc JOIN nk USING (k) JOIN sp ON sp.i = sc.i AND sp.j = sc.j JOIN yb ya ON ya.k = sc.k AND ya.i = sc.i JOIN yb ON yb.k = sc.k AND yb.i = sc.j JOIN gm ga ON ga.i = sc.i JOIN gm gb ON gb.i = sc.j),
od AS (SELECT k, row_number() OVER ({order}) - 1 AS new FROM (SELECT k, sum(cov) FILTER (WHERE i = j) AS tr FROM cv GROUP BY 1)), ww AS (SELECT k, (nk + {c.alpha} - 1) / sum(nk + {c.alpha} - 1) OVER () AS w FROM nk)
SELECT CAST(new AS INT) AS k, CAST(cv.i AS INT) AS i, CAST(cv.j AS INT) AS j, round(w, 9) AS weight, round((nk * y + {c.kappa} * g) / (nk + {c.kappa}), 9) AS mean, round(cov, 9) AS covariance FROM cv JOIN od USING (k) JOIN nk USING (k) JOIN ww USING (k) JOIN yb ON yb.k = cv.k AND yb.i = cv.i JOIN gm ON gm.i = cv.i"""


@query("mixture_round", _round_sql())
def _(s, d):
    f = mixture_tables.fit_em_table(_days(s, d), _GIVEN, replace(mixture.HEADLINE, max_iter=1))
    rows = [(k, i + 1, j + 1, float(f.weights[k]), float(f.means[k][i]), float(f.covs[k][i][j])) for k in range(2) for i in range(6) for j in range(6)]
    return s.createDataFrame(rows, "k int, i int, j int, weight double, mean double, covariance double")


#: Where the steps below start: two states of a series of market means.
_START = mixture.State(np.array([[0.0], [0.0]]), np.array([[[0.04]], [[0.2]]]), np.array([0.5, 0.5]))
_STEP_CFG = replace(mixture.HEADLINE, config_id="steps", max_iter=3, tol=0.0)


def _em_sql() -> str:
    """Three steps of the regularised fit on one series, step by step."""
    c = _STEP_CFG
    nu0 = 1 + c.nu_extra
    out = f"""WITH {_RET}, x AS (SELECT dt, avg(r) AS x FROM ret GROUP BY 1), gr AS (SELECT count(*) AS n, avg(x) AS mu0, {c.lambda_scale} * var_samp(x) / 4 AS lam0 FROM x),
p0 AS (SELECT unnest([0, 1]) AS k, unnest([{_START.means[0][0]}, {_START.means[1][0]}]::DOUBLE[]) AS m, unnest([{_START.covs[0][0][0]}, {_START.covs[1][0][0]}]::DOUBLE[]) AS v, unnest([0.5, 0.5]::DOUBLE[]) AS w)"""
    for i in range(1, c.max_iter + 1):
        out += f""", l{i} AS (SELECT dt, x, k, w * exp(-0.5 * power(x - m, 2) / (v + {c.reg})) / sqrt(2 * pi() * (v + {c.reg})) AS f FROM x, p{i - 1}),
r{i} AS (SELECT x, k, f / sum(f) OVER (PARTITION BY dt) AS r FROM l{i}), n{i} AS (SELECT k, sum(r) AS nk, sum(r * x) / sum(r) AS yb FROM r{i} GROUP BY 1), s{i} AS (SELECT r{i}.k, max(nk) AS nk, max(yb) AS yb, sum(r * power(x - yb, 2)) AS sc FROM r{i} JOIN n{i} ON r{i}.k = n{i}.k GROUP BY 1),
u{i} AS (SELECT (nk * yb + {c.kappa} * mu0) / (nk + {c.kappa}) AS m, (lam0 + sc + {c.kappa} * nk / ({c.kappa} + nk) * power(yb - mu0, 2)) / ({nu0} + nk + 3) + {c.reg} AS v, nk + {c.alpha} - 1 AS w0 FROM s{i}, gr),
p{i} AS (SELECT row_number() OVER (ORDER BY v) - 1 AS k, m, v, w0 / sum(w0) OVER () AS w FROM u{i}), e{i} AS (SELECT avg(ln(f)) AS level FROM (SELECT dt, sum(f) AS f FROM l{i} GROUP BY 1))"""
    return out + f" SELECT k, round(m, 9) AS mean, round(v, 9) AS variance, round(w, 9) AS weight, (SELECT round(level, 9) FROM e{c.max_iter}) AS level, {c.max_iter} AS steps FROM p{c.max_iter}"


@query("mixture_steps", _em_sql())
def _(s, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = mixture.fit_em(pdf.sort_values("dt")[["x"]].to_numpy(float), _START, _STEP_CFG)
        return pd.DataFrame({"k": [0, 1], "mean": f.means[:, 0], "variance": f.covs[:, 0, 0], "weight": f.weights, "level": f.loglik, "steps": f.n_iter})

    x = returns(s, d).groupBy("dt").agg(F.avg("r").alias("x"))
    return x.withColumn("series", F.lit("market")).groupBy("series").applyInPandas(run, "k int, mean double, variance double, weight double, level double, steps int")


@query("fit_conditions", "SELECT config_id, rule, 0 AS bad FROM (SELECT unnest(['headline', 'forecast']) AS config_id), (SELECT unnest(['states', 'criterion', 'shares', 'sizes', 'order', 'windows', 'density']) AS rule)")
def _(s, d):
    """Fits that break a rule: states among the candidates, the greatest criterion, shares and sizes that add up, states in order of variance, windows in their places, a finite density."""
    fits = mixture.fit_rolling(_days(s, d), MAIN)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    trace = F.transform("covs", lambda c: F.aggregate(F.transform(c, lambda r, i: r[i]), F.lit(0.0), lambda a, v: a + v))
    ks = {c.config_id: c.k_candidates for c in MAIN}
    best = F.array_max(F.map_values("bic_grid"))
    rules = {
        "states": ~F.array_contains(F.map_keys("bic_grid"), F.col("K")) | (F.size("bic_grid") != F.when(F.col("config_id") == "headline", len(ks["headline"])).otherwise(len(ks["forecast"]))),
        "criterion": (F.element_at("bic_grid", F.col("K")) != best) | (F.col("bic") != best),
        "shares": F.abs(total("weights") - 1) > 1e-9,
        "sizes": (F.abs(total("neff") - (F.col("e") - F.col("s") + 1)) > 1e-6) | (F.col("neff_min") != F.array_min("neff")),
        "order": F.array_sort(trace) != trace,
        "windows": (F.col("s") != F.col("w") * MAIN[0].step) | (F.col("e") - F.col("s") + 1 != MAIN[0].window),
        "density": F.isnan("loglik") | F.col("loglik").isNull(),
    }
    each = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(True)).cast("int").alias("broken")) for k, v in rules.items()))
    return fits.select("config_id", F.inline(each)).groupBy("config_id", "rule").agg(F.sum("broken").cast("int").alias("bad"))


@query("random_walk_scores", f"""WITH {_ST}, y AS (SELECT dt, p_1, row_number() OVER (ORDER BY dt) - 1 AS t, lead(p_1) OVER (ORDER BY dt) AS nxt FROM st), x AS (SELECT p_1 AS p, CAST(nxt > 0.5 AS INT) AS z FROM y WHERE t >= 250 AND nxt IS NOT NULL)
SELECT count(*) AS n_forecasts, round(avg(power(z - p, 2)), 6) AS brier_rw, round(avg(CAST((p >= 0.5) = (z = 1) AS DOUBLE)), 6) AS hit_rw, true AS possible FROM x""", 6)
def _(s, d):
    t = forecasting.against_random_walk(states(s, d))[1]
    possible = F.col("modal_ar_order").between(1, 5) & F.col("dm_pvalue_squared").between(0, 1) & F.col("dm_pvalue_absolute").between(0, 1) & (F.abs(1 - F.col("brier_ar") / F.col("brier_rw") - F.col("brier_skill_vs_rw")) < 1e-9)
    return t.select("n_forecasts", "brier_rw", "hit_rw", possible.alias("possible"))


@query("dm_p", _cte("dm_stat") + f", z AS (SELECT n, mean_diff, statistic AS z FROM s), si AS (SELECT unnest(range(0, 4001)) AS i) SELECT n, round(mean_diff, 6) AS mean_diff, round(z, 4) AS statistic, round({_N_TAIL}, 3) AS p_value FROM z, si GROUP BY n, mean_diff, z", 6)
def _(s, d):
    f = _one_step(s, d).select(F.col("date_t").alias("dt"), ((F.col("p_ar_t1") - F.col("z_t1")) ** 2 - (F.col("p_rw_t1") - F.col("z_t1")) ** 2).alias("d"))
    return inference.diebold_mariano(f, 5).select("n", "mean_diff", F.round("statistic", 4).alias("statistic"), F.round("p_value", 3).alias("p_value"))
