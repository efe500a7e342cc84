"""Logit autoregressive moving averages by exact likelihood: fits of several orders, forecasts and walk-forward tests.

A fit is a task: series and orders are dealt out as rows, and so are stretches of the origins of a walk-forward test.
Autoregressions of many origins are fitted side by side, from prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arma import ARIMA
from .forecast_eval import error_by_horizon, with_realised
from .forecasting import ExactARs, ExpandingAR, _series, inv_logit, logit, snail_trail, summarised, with_scores

Order = tuple[int, int, int]

FITTED = "series string, p int, d int, q int, n int, mean double, phi array<double>, theta array<double>, variance double, log_likelihood double, aic double, bic double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("\n", " ").split(", ")]


def fit_arima(probs: DataFrame, orders: Sequence[Order] = ((1, 0, 0),)) -> DataFrame:
    """A row per series and order (p, d, q): the logits' model by exact likelihood, and its information criteria.

    The likelihood is that of the differences if ``d`` is above 0, which then have no mean. Series that are flat or too short
    for an order have no row for it.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        series, i = key
        p, d, q = orders[i]
        rows = []
        try:
            m = ARIMA(logit(pdf.sort_values("dt")["p_1"].to_numpy(float)), p, d, q).fit()
            n, k = len(m.z), p + q + 1 + (d == 0)
            rows.append((series, p, d, q, n, m.mean, m.phi.tolist(), m.theta.tolist(), m.variance, m.level, 2 * k - 2 * m.level, np.log(n) * k - 2 * m.level))
        except np.linalg.LinAlgError:
            pass
        return pd.DataFrame(rows, columns=_names(FITTED))

    dealt = _series(probs).withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(len(orders))))))
    return dealt.groupBy("series", "i").applyInPandas(run, FITTED)


def best_arima(fits: DataFrame, criterion: str = "bic") -> DataFrame:
    """Of each series the fit of least criterion; of equal ones that of fewest terms, then of least (d, p, q)."""
    order = F.struct(criterion, (F.col("p") + F.col("q")).alias("terms"), "d", "p", "q")
    return fits.groupBy("series").agg(F.min_by(F.struct(*fits.columns), order).alias("best")).select("best.*")


def arima_forecast(probs: DataFrame, order: Order = (1, 0, 0), steps: int = 1) -> DataFrame:
    """(series, h, p_hat): the next days' probabilities given all days; today's value for flat or short series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("dt")["p_1"].to_numpy(float)
        try:
            f = inv_logit(ARIMA(logit(p), *order).fit().forecast(steps))
        except np.linalg.LinAlgError:
            f = np.full(steps, p[-1])
        return pd.DataFrame({"series": pdf["series"].iloc[0], "h": np.arange(1, steps + 1, dtype=np.int32), "p_hat": f})

    return _series(probs).groupBy("series").applyInPandas(run, "series string, h int, p_hat double")


WALK = "series string, date_t date, date_t1 date, ar_order int, p_t double, p_ar_t1 double, p_rw_t1 double, p_realized_t1 double, z_t1 int"


def walk_forward(probs: DataFrame, max_lag: int | None = None, order: Order = (1, 0, 0), min_train: int = 250, refit: int = 21, criterion: str = "bic", stretches: int = 16) -> DataFrame:
    """One-step forecasts from every origin by a model fitted anew to all days up to it, beside today's value.

    With ``max_lag`` the order is that of an autoregression by least squares, chosen anew every ``refit`` origins; else it
    is ``order``. Where no model can be fitted today's value stands in. The realised state is whether tomorrow's probability
    is above one half.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, dates = pdf["p_1"].to_numpy(float), pdf["dt"].to_numpy()
        y, ends = logit(p), np.arange(min_train, len(p) - 1)
        mine = np.array_split(np.arange(len(ends)), stretches)[key[1]]
        used, t = np.full(len(mine), order[0]), ends[mine]
        ahead = y[t]
        sums = ExpandingAR(y, max_lag or max(order[0], 1))
        if max_lag:
            chosen = {int(i): sums.order(int(ends[i]), criterion) for i in np.unique(mine - mine % refit)}
            used = np.array([chosen[int(i - i % refit)] for i in mine], np.int64)
        if max_lag or order[1:] == (0, 0) and order[0]:
            for k in np.unique(used):
                try:
                    ahead[used == k] = ExactARs(sums, int(k), t[used == k]).forecast(1)[:, 0]
                except np.linalg.LinAlgError:
                    pass
        else:
            for j, end in enumerate(t):
                try:
                    ahead[j] = ARIMA(y[: end + 1], *order).fit().forecast(1)[0]
                except np.linalg.LinAlgError:
                    pass
        rows = {"series": key[0], "date_t": dates[t], "date_t1": dates[t + 1], "ar_order": used, "p_t": p[t], "p_ar_t1": inv_logit(ahead), "p_rw_t1": p[t], "p_realized_t1": p[t + 1], "z_t1": (p[t + 1] > 0.5).astype(int)}
        return pd.DataFrame(rows, columns=_names(WALK))

    dealt = _series(probs).withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))))
    return dealt.groupBy("series", "stretch").applyInPandas(run, WALK)


def against_random_walk(probs: DataFrame, max_lag: int | None = 5, order: Order = (1, 0, 0), min_train: int = 250, refit: int = 21) -> tuple[DataFrame, DataFrame]:
    """(details, summary) of :func:`walk_forward`, as :func:`.forecasting.against_random_walk` gives them for least squares."""
    f = with_scores(walk_forward(probs, max_lag, order, min_train, refit))
    return f, summarised(f)


AWARE = "series string, origin_dt date, h int, forecast_dt date, p_hat double, current_regime string, p_normal double, method string"


def regime_aware(probs: DataFrame, horizon: int = 21, every: int = 20, min_train: int = 250, threshold: float = 0.5, blend: bool = True, min_obs: int = 30, order: int = 1) -> DataFrame:
    """Forecasts by two autoregressions, of the days in the main state and of the others, each as one series of its days.

    The main state is that of the greater mean probability. Each model goes on from its own last day; their logits are
    weighed by today's probability of the main state, or the model of today's state stands alone. A model of fewer than
    ``min_obs`` days, or one that can't be fitted, forecasts today's logit. ``p_hat`` is that of state 1. Only origins with a
    whole horizon ahead are used.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, dates = pdf["p_1"].to_numpy(float), pdf["dt"].to_numpy()
        main = p if p.mean() > 0.5 else 1 - p
        y, rows = logit(p), []
        normal = main >= 0.5 if main is not p else main > 0.5  # of two equal probabilities the first state's counts
        origins = np.arange(min_train, len(p) - horizon, every)
        ahead = [np.repeat(y[origins, None], horizon, 1) for _ in range(2)]
        for out, days in zip(ahead, (normal, ~normal)):
            n = np.cumsum(days)[origins]
            enough = n >= max(min_obs, 2 * order + 2)
            if enough.any():
                model = ExactARs(ExpandingAR(y[days], order), order, n[enough] - 1)
                out[enough] = np.where(model.good[:, None], model.forecast(horizon), out[enough])
        for i, t in enumerate(origins):
            now = "normal" if main[t] >= threshold else "stress"
            share = main[t] if blend else float(now == "normal")
            f = inv_logit(share * ahead[0][i] + (1 - share) * ahead[1][i])
            method = "blended" if blend else f"{now}_ar"
            rows += [(pdf["series"].iloc[0], dates[t], h, dates[t + h], f[h - 1], now, main[t], method) for h in range(1, horizon + 1)]
        return pd.DataFrame(rows, columns=_names(AWARE))

    return _series(probs).groupBy("series").applyInPandas(run, AWARE)


def compare_methods(probs: DataFrame, horizon: int = 21, every: int = 20, min_train: int = 250) -> DataFrame:
    """Errors by method and horizon of the plain model and of the weighed and switched ones, by exact likelihood."""
    plain = snail_trail(probs, horizon, every, min_train, exact=True).filter("forecast_dt is not null").select("series", "origin_dt", "h", "forecast_dt", "p_hat", F.lit("standard").alias("method"))
    for blend in (True, False):
        aware = regime_aware(probs, horizon, every, min_train, blend=blend)
        plain = plain.unionByName(aware.select("series", "origin_dt", "h", "forecast_dt", "p_hat", F.lit("regime_blend" if blend else "regime_switch").alias("method")))
    return error_by_horizon(with_realised(plain, probs), ("method",))
