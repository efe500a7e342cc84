"""Autoregressive forecasts of state probabilities on logits, from prefix sums instead of repeated fits.

Every origin's regression is a solve of the normal equations of all rows up to it. Their cumulative sums are
formed once for each order, so all origins cost linear time; origins that do not refit reuse the last refit's order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arma import least_of_each, of_partial, partial_of

EPS = 1e-8


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, EPS, 1 - EPS)
    return np.log(q / (1 - q))


def inv_logit(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-y))


class ExpandingAR:
    """Least-squares AR(p) with intercept on y[0..t] for any t and p up to ``max_lag``."""

    def __init__(self, y: np.ndarray, max_lag: int):
        self.y, self.max_lag = np.asarray(y, float), max_lag
        self.gram, self.cross, self.square = {}, {}, {}
        for p in range(1, max_lag + 1):
            n = len(y) - p
            x = np.column_stack([np.ones(max(n, 0)), *(self.y[p - j : p - j + max(n, 0)] for j in range(1, p + 1))])
            target = self.y[p:]
            self.gram[p] = np.cumsum(x[:, :, None] * x[:, None, :], axis=0)
            self.cross[p] = np.cumsum(x * target[:, None], axis=0)
            self.square[p] = np.cumsum(target**2)

    def fit(self, t: int, p: int) -> tuple[np.ndarray, float, int]:
        """(coefficients, residual sum of squares, observations) on y[0..t]."""
        i = t - p
        n = i + 1
        if n <= p + 1:
            raise np.linalg.LinAlgError("too few rows")
        g, c = self.gram[p][i], self.cross[p][i]
        beta = np.linalg.solve(g, c)
        if not np.isfinite(beta).all():
            raise np.linalg.LinAlgError("a flat history")
        return beta, float(max(self.square[p][i] - beta @ c, 0.0)), n

    def order(self, t: int, criterion: str = "bic") -> int:
        """The order with the least information criterion; each order uses all the rows it has; of equal ones the least."""
        best, out = np.inf, 1
        for p in range(1, self.max_lag + 1):
            try:
                _, rss, n = self.fit(t, p)
            except np.linalg.LinAlgError:
                continue
            sigma2 = max(rss / n, 1e-300)
            loglik = -n / 2 * (np.log(2 * np.pi) + np.log(sigma2) + 1)
            k = p + 2  # intercept, lags, variance
            ic = -2 * loglik + (np.log(n) if criterion == "bic" else 2) * k
            if ic < best - 1e-12:
                best, out = ic, p
        return out

    def forecast(self, t: int, p: int, steps: int) -> np.ndarray:
        beta, _, _ = self.fit(t, p)
        past = list(self.y[t - p + 1 : t + 1])
        out = []
        for _ in range(steps):
            nxt = beta[0] + float(np.dot(beta[1:], past[::-1][:p]))
            out.append(nxt)
            past.append(nxt)
        return np.array(out)


class ExactAR:
    """Gaussian AR(p) around a mean by its exact likelihood, on y[0..t] for any t.

    The density of y[0..t] is that of the first p values under the stationary law, times one normal term for each value
    after them. The latter depend on the history by the sums of :class:`ExpandingAR` alone, so a fit costs the same at
    every t. Mean and variance are profiled out; what is left is searched over partial autocorrelations, which keep the
    process stationary.
    """

    def __init__(self, sums: ExpandingAR, p: int):
        self.sums, self.p, self.start = sums, p, None

    def _profile(self, phi: np.ndarray, t: int) -> tuple[float, float, float]:
        """(mean, variance, -2 log likelihood / observations) at given coefficients."""
        p, i = self.p, t - self.p
        m, n = i + 1, t + 1
        g, c, q = self.sums.gram[p][i], self.sums.cross[p][i], self.sums.square[p][i]
        first = self.sums.y[:p]
        head, tail = np.r_[1.0, -phi[:-1]], -phi[::-1]
        low = np.subtract.outer(np.arange(p), np.arange(p))
        a, b = (np.where(low >= 0, v[np.maximum(low, 0)], 0.0) for v in (head, tail))
        inverse = a @ a.T - b @ b.T  # of the stationary covariances of p values, over the variance of a shock
        share = 1 - phi.sum()
        rest, squares = c[0] - phi @ g[0, 1:], q - 2 * phi @ c[1:] + phi @ g[1:, 1:] @ phi
        mean = (share * rest + inverse.sum(0) @ first) / (share**2 * m + inverse.sum())
        z = first - mean
        total = squares - 2 * share * mean * rest + m * (share * mean) ** 2 + z @ inverse @ z
        variance = max(total / n, 1e-300)
        return mean, variance, np.log(2 * np.pi * variance) + 1 - np.linalg.slogdet(inverse)[1] / n

    def fit(self, t: int) -> tuple[float, np.ndarray, float, float]:
        """(mean, coefficients, variance, log likelihood); a search begins where the last one ended."""
        if self.start is None:
            beta = self.sums.fit(t, self.p)[0]
            self.start = np.arctanh(np.clip(partial_of(beta[1:]), -0.99, 0.99))
        elif t - self.p + 1 <= self.p + 1:
            raise np.linalg.LinAlgError("too few rows")
        self.start = least(lambda u: self._profile(of_partial(np.tanh(u)), t)[2], self.start)
        phi = of_partial(np.tanh(self.start))
        mean, variance, level = self._profile(phi, t)
        if not np.isfinite(level):
            raise np.linalg.LinAlgError("a flat history")
        return mean, phi, variance, -0.5 * (t + 1) * level

    def forecast(self, t: int, steps: int) -> np.ndarray:
        mean, phi, _, _ = self.fit(t)
        past = list(self.sums.y[t - self.p + 1 : t + 1] - mean)
        for _ in range(steps):
            past.append(float(phi @ np.array(past[: -self.p - 1 : -1])))
        return mean + np.array(past[self.p :])


class ExactARs:
    """:class:`ExactAR` at many ends of history at once: (mean, coefficients, variance, log likelihood) of each y[0..t]."""

    def __init__(self, sums: ExpandingAR, p: int, ts: np.ndarray):
        self.p, self.ts, self.y = p, np.asarray(ts, np.int64), sums.y
        if len(self.ts) and self.ts.min() - p + 1 <= p + 1:
            raise np.linalg.LinAlgError("too few rows")
        i = self.ts - p
        self.g, self.c, self.q = sums.gram[p][i], sums.cross[p][i], sums.square[p][i]
        flat = np.linalg.matrix_rank(self.g, tol=1e-12 * np.abs(self.g).max(initial=0)) <= p
        safe = np.where(flat[:, None, None], np.eye(p + 1), self.g)
        beta = np.linalg.solve(safe, self.c[:, :, None])[:, :, 0]
        start = np.array([np.arctanh(partial_of(b[1:])) for b in beta]).reshape(-1, p)
        found = least_of_each(lambda which, u: self._profile(which, of_partial(np.tanh(u)))[2], start)
        self.phi = of_partial(np.tanh(found))
        self.mean, self.variance, level = (x[:, 0] for x in self._profile(np.arange(len(self.ts)), self.phi[:, None]))
        self.level = -0.5 * (self.ts + 1) * level
        self.good = np.isfinite(level) & ~flat

    def _profile(self, which: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        m, n = (self.ts[which] - p + 1)[:, None], (self.ts[which] + 1)[:, None]
        g, c, q = self.g[which], self.c[which], self.q[which, None]
        first = self.y[:p]
        head, tail = np.concatenate([np.ones((*phi.shape[:-1], 1)), -phi[..., :-1]], axis=-1), -phi[..., ::-1]
        low = np.subtract.outer(np.arange(p), np.arange(p))
        a, b = (np.where(low >= 0, v[..., np.maximum(low, 0)], 0.0) for v in (head, tail))
        inverse = a @ a.swapaxes(-1, -2) - b @ b.swapaxes(-1, -2)
        share = 1 - phi.sum(-1)
        rest = c[:, None, 0] - np.einsum("mki,mi->mk", phi, g[:, 0, 1:])
        squares = q - 2 * np.einsum("mki,mi->mk", phi, c[:, 1:]) + np.einsum("mki,mij,mkj->mk", phi, g[:, 1:, 1:], phi)
        mean = (share * rest + inverse.sum(-2) @ first) / (share**2 * m + inverse.sum((-1, -2)))
        z = first - mean[..., None]
        total = squares - 2 * share * mean * rest + m * (share * mean) ** 2 + np.einsum("mki,mkij,mkj->mk", z, inverse, z)
        variance = np.maximum(total / n, 1e-300)
        return mean, variance, np.log(2 * np.pi * variance) + 1 - np.linalg.slogdet(inverse)[1] / n

    def forecast(self, steps: int) -> np.ndarray:
        """(histories, steps); of histories without a fit the last value."""
        back = self.ts[:, None] - np.arange(self.p)
        past = self.y[back] - self.mean[:, None]
        out = np.empty((len(self.ts), steps))
        for h in range(steps):
            ahead = (self.phi * past).sum(1)
            out[:, h] = ahead + self.mean
            past = np.column_stack([ahead, past[:, :-1]])
        return np.where(self.good[:, None], out, self.y[self.ts][:, None])


def least(f, u: np.ndarray, rounds: int = 100, h: float = 1e-5) -> np.ndarray:
    """Where a smooth function of few variables is least: quasi-Newton steps on central differences."""
    n = len(u)

    def slope(at: np.ndarray) -> np.ndarray:
        return np.array([(f(at + h * e) - f(at - h * e)) / (2 * h) for e in np.eye(n)])

    value, g, inverse = f(u), slope(u), np.eye(n)
    for _ in range(rounds):
        if not np.isfinite(value) or np.abs(g).max() < 1e-9:
            break
        move = -inverse @ g
        if g @ move >= 0:
            inverse, move = np.eye(n), -g
        size = min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        while size > 1e-10 and not f(u + size * move) <= value + 1e-4 * size * (g @ move):
            size /= 2
        if size <= 1e-10:
            break
        to = u + size * move
        after = slope(to)
        d, y = to - u, after - g
        if d @ y > 1e-14:
            left = np.eye(n) - np.outer(d, y) / (d @ y)
            inverse = left @ inverse @ left.T + np.outer(d, d) / (d @ y)
        u, g, value = to, after, f(to)
    return u


def _series(probs: DataFrame) -> DataFrame:
    keys = [c for c in ("series",) if c in probs.columns]
    return probs.select(*(keys or [F.lit("p").alias("series")]), "dt", "p_1")


MULTI = (
    "series string, date_t date, date_th date, horizon int, ar_order_change int, ar_order_baseline int, p_t double, p_change_th double, p_baseline_th double, p_rw_th double, p_realized_th double, z_th int, fallback boolean"
)


def multi_horizon(probs: DataFrame, horizons: Sequence[int] = (1, 5, 21), max_lag: int = 5, min_train: int = 250, refit: int = 21) -> DataFrame:
    """Change, level and random-walk forecasts from every origin: AR on differences of the logit summed from today's
    level, AR on the logit, and today's probability. All horizons share their origins. One task per ``series``."""
    names = [c.split()[0] for c in MULTI.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, dates = pdf["p_1"].to_numpy(float), pdf["dt"].to_numpy()
        y = logit(p)
        level, change = ExpandingAR(y, max_lag), ExpandingAR(np.diff(y), max_lag)
        far, rows = max(horizons), []
        for i, t in enumerate(range(min_train, len(p) - far)):
            if i % refit == 0:
                orders = change.order(t - 1), level.order(t)
            fallback = False
            try:
                by_change = inv_logit(y[t] + np.cumsum(change.forecast(t - 1, orders[0], far)))
            except np.linalg.LinAlgError:
                by_change, fallback = np.full(far, p[t]), True
            try:
                by_level = inv_logit(level.forecast(t, orders[1], far))
            except np.linalg.LinAlgError:
                by_level, fallback = np.full(far, p[t]), True
            for h in horizons:
                rows.append((pdf["series"].iloc[0], dates[t], dates[t + h], h, *orders, p[t], by_change[h - 1], by_level[h - 1], p[t], p[t + h], int(p[t + h] > 0.5), fallback))
        return pd.DataFrame(rows, columns=names)

    return _series(probs).groupBy("series").applyInPandas(run, MULTI)


def multi_long(frame: DataFrame) -> DataFrame:
    """(series, horizon, date_t, method, p, z) of a multi-horizon frame."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("p")) for m, c in (("ar_change", "p_change_th"), ("ar_baseline", "p_baseline_th"), ("rw", "p_rw_th"))))
    return frame.select("series", "horizon", "date_t", F.inline(each), F.col("z_th").alias("z"), F.col("p_realized_th").alias("p_realized"))


SNAIL = "series string, origin_dt date, h int, forecast_dt date, p_hat double, method string"


def snail_trail(probs: DataFrame, horizon: int = 21, every: int = 20, min_train: int = 250, order: int = 1, exact: bool = False) -> DataFrame:
    """Multi-step forecasts of a fixed order from every n-th origin: (series, origin_dt, h, forecast_dt, p_hat, method).

    By least squares, or with ``exact`` by the exact likelihood. A flat or short history forecasts today's value.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, dates = pdf["p_1"].to_numpy(float), pdf["dt"].to_numpy()
        ar, rows = ExpandingAR(logit(p), order), []
        whole = ExactAR(ar, order)
        for t in range(min_train, len(p), every):
            try:
                f = inv_logit(whole.forecast(t, horizon) if exact else ar.forecast(t, order, horizon))
            except np.linalg.LinAlgError:
                f = np.full(horizon, p[t])
            rows += [(pdf["series"].iloc[0], dates[t], h, dates[t + h] if t + h < len(p) else None, f[h - 1], "ar_exact" if exact else "ar") for h in range(1, horizon + 1)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SNAIL.split(", ")])

    return _series(probs).groupBy("series").applyInPandas(run, SNAIL)


FITTED = "series string, order int, n int, mean double, coefficients array<double>, variance double, log_likelihood double, aic double, bic double"


def fit_logit(probs: DataFrame, order: int = 1) -> DataFrame:
    """The autoregression of each series' logits by exact likelihood, with its information criteria. Series of too few days give none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = logit(pdf.sort_values("dt")["p_1"].to_numpy(float))
        rows = []
        try:
            if len(y) > 2 * order + 1:
                mean, phi, variance, level = ExactAR(ExpandingAR(y, order), order).fit(len(y) - 1)
                k = order + 2
                rows.append((pdf["series"].iloc[0], order, len(y), mean, phi.tolist(), variance, level, 2 * k - 2 * level, np.log(len(y)) * k - 2 * level))
        except np.linalg.LinAlgError:
            pass
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FITTED.split(", ")])

    return _series(probs).groupBy("series").applyInPandas(run, FITTED)


def logit_forecast(probs: DataFrame, steps: int = 1, order: int = 1) -> DataFrame:
    """(series, h, p_hat): the next days' probabilities by the exact likelihood on all days; today's value where that fails."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("dt")["p_1"].to_numpy(float)
        try:
            if len(p) <= 2 * order + 1:
                raise np.linalg.LinAlgError("too few rows")
            f = inv_logit(ExactAR(ExpandingAR(logit(p), order), order).forecast(len(p) - 1, steps))
        except np.linalg.LinAlgError:
            f = np.full(steps, p[-1])
        return pd.DataFrame({"series": pdf["series"].iloc[0], "h": np.arange(1, steps + 1, dtype=np.int32), "p_hat": f})

    return _series(probs).groupBy("series").applyInPandas(run, "series string, h int, p_hat double")


def regime_aware(probs: DataFrame, horizon: int = 21, every: int = 20, min_train: int = 250, threshold: float = 0.5, blend: bool = True, min_obs: int = 30) -> DataFrame:
    """AR(1) fits on calm and on stressed days (each as one series of its days), blended by today's probability or
    switched at the threshold; with fewer than ``min_obs`` days of a kind the fit on all days stands in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, dates = pdf["p_1"].to_numpy(float), pdf["dt"].to_numpy()
        y, rows = logit(p), []
        whole = ExpandingAR(y, 1)
        kinds = [(np.cumsum(m), ExpandingAR(y[m], 1)) for m in (p <= threshold, p > threshold)]
        for t in range(min_train, len(p), every):
            try:
                every_day = whole.fit(t, 1)[0]
                calm, high = (sums.fit(int(n[t]) - 1, 1)[0] if n[t] >= min_obs else every_day for n, sums in kinds)
                a = b = y[t]
                for h in range(1, horizon + 1):
                    a, b = calm[0] + calm[1] * a, high[0] + high[1] * b
                    share = p[t] if blend else float(p[t] > threshold)
                    f = (1 - share) * inv_logit(a) + share * inv_logit(b)
                    rows.append((pdf["series"].iloc[0], dates[t], h, dates[t + h] if t + h < len(p) else None, f, "regime_blend" if blend else "regime_switch"))
            except np.linalg.LinAlgError:
                rows += [(pdf["series"].iloc[0], dates[t], h, dates[t + h] if t + h < len(p) else None, p[t], "fallback") for h in range(1, horizon + 1)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SNAIL.split(", ")])

    return _series(probs).groupBy("series").applyInPandas(run, SNAIL)


def backtest_signals(probs: DataFrame, horizon: int = 21, min_train: int = 252, refit: int = 21, max_lag: int = 5) -> DataFrame:
    """(dt, p_1_oracle_fwd, p_1_current, p_1_ar_baseline, p_1_ar_change), stamped at the day the forecast is for."""
    f = multi_horizon(probs, (horizon,), max_lag, min_train, refit)
    ahead = probs.select(F.col("dt").alias("date_t"), F.avg("p_1").over(Window.orderBy("dt").rowsBetween(horizon, 2 * horizon - 1)).alias("fwd"))
    return f.join(ahead, "date_t").select(F.col("date_th").alias("dt"), F.col("fwd").alias("p_1_oracle_fwd"), F.col("p_t").alias("p_1_current"), F.col("p_baseline_th").alias("p_1_ar_baseline"), F.col("p_change_th").alias("p_1_ar_change"))


def compare_methods(probs: DataFrame, horizon: int = 21, every: int = 20, min_train: int = 250) -> DataFrame:
    """Errors by method and horizon of the plain, blended and switched forecasts."""
    from .forecast_eval import error_by_horizon, with_realised

    all_ = snail_trail(probs, horizon, every, min_train)
    for blend in (True, False):
        all_ = all_.unionByName(regime_aware(probs, horizon, every, min_train, blend=blend))
    return error_by_horizon(with_realised(all_.filter("forecast_dt IS NOT NULL"), probs), ("method",))


def against_random_walk(probs: DataFrame, max_lag: int = 5, min_train: int = 250, refit: int = 21) -> tuple[DataFrame, DataFrame]:
    """(details, summary) of one-step forecasts by a walk-forward autoregression and by the last value.

    ``details`` has a row per origin: the order in use (chosen anew every ``refit`` days), forecasts, errors and scores.
    ``summary`` has one row per series: orders, mean scores, skill, hit rates, and Diebold-Mariano statistics of squared
    and absolute errors.
    """
    f = multi_horizon(probs, (1,), max_lag, min_train, refit)
    f = with_scores(f.select("series", "date_t", F.col("date_th").alias("date_t1"), F.col("ar_order_baseline").alias("ar_order"), "p_t", F.col("p_baseline_th").alias("p_ar_t1"), F.col("p_rw_th").alias("p_rw_t1"), F.col("p_realized_th").alias("p_realized_t1"), F.col("z_th").alias("z_t1")))
    return f, summarised(f)


def with_scores(f: DataFrame) -> DataFrame:
    """One-step forecasts with the errors, Brier scores, log losses and hits of the model and of the random walk."""
    for m in ("ar", "rw"):
        p, z = F.col(f"p_{m}_t1"), F.col("z_t1")
        clipped = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
        f = f.withColumns({f"error_{m}": p - F.col("p_realized_t1"), f"brier_{m}": (z - p) ** 2, f"logloss_{m}": -(z * F.ln(clipped) + (1 - z) * F.ln(1 - clipped)), f"hit_{m}": ((p >= 0.5) == (z == 1)).cast("double")})
    return f


def summarised(f: DataFrame) -> DataFrame:
    """A row per series of :func:`with_scores`: orders, mean scores, skill, hit rates, and Diebold-Mariano statistics."""
    from .inference import diebold_mariano

    means = f.groupBy("series").agg(F.count(F.lit(1)).alias("n_forecasts"), F.mode("ar_order", True).alias("modal_ar_order"), F.avg("ar_order").alias("mean_ar_order"), *(F.avg(f"{c}_{m}").alias(f"{c}_{m}") for c in ("brier", "logloss", "hit") for m in ("ar", "rw")))
    means = means.withColumn("brier_skill_vs_rw", F.when(F.col("brier_rw") > 0, 1 - F.col("brier_ar") / F.col("brier_rw")))
    for name, loss in (("squared", lambda e: e * e), ("absolute", F.abs)):
        d = f.select("series", F.col("date_t").alias("dt"), (loss(F.col("error_ar")) - loss(F.col("error_rw"))).alias("d"))
        dm = diebold_mariano(d, 1, ("series",))
        means = means.join(dm.select("series", F.col("statistic").alias(f"dm_stat_{name}"), F.col("p_value").alias(f"dm_pvalue_{name}")), "series", "left")
    return means
