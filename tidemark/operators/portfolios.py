"""Optimised portfolios: per state, unconditional, on frontiers, and along expanding samples.

Moments are windows and aggregates; only the programmes themselves, one per state or rebalance date, run in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quadratic
from ..functions.scalar import ratio
from .backtest import ANN_LIVE, drifted
from .panel import rebalance_dates
from .regimes import pairs


@dataclass(frozen=True)
class Bounds:
    """Limits of a portfolio's weights, and the risk-free rate."""

    low: float = 0.0
    high: float = 1.0
    rf: float = 0.0

    @classmethod
    def of(cls, allow_short: bool = False, max_weight: float = 1.0, min_weight: float = 0.0, rf: float = 0.0) -> Bounds:
        return cls(-max_weight if allow_short else min_weight, max_weight, rf)


def moment_arrays(sample: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(…, assets, mu, cov) of long returns, as arrays in order of the assets."""
    two = pairs(sample, keep).groupBy(*keep, "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.avg("ra").alias("ma"))
    return _arrays(two, keep)


def _arrays(two: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(…, a, b, cov, ma) with a <= b as arrays."""
    cells = F.array_sort(F.collect_list(F.struct("a", "b", "cov", "ma")))
    return two.groupBy(*keep).agg(cells.alias("cells"))


def _unpack(cells) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted({c["a"] for c in cells} | {c["b"] for c in cells})
    at = {a: i for i, a in enumerate(names)}
    mu, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for c in cells:
        i, j = at[c["a"]], at[c["b"]]
        cov[i, j] = cov[j, i] = np.nan if c["cov"] is None else c["cov"]
        if i == j:
            mu[i] = c["ma"]
    return names, mu, cov


def solve(mu: np.ndarray, cov: np.ndarray, method: str = "max_sharpe", bounds: Bounds = Bounds(), target: float | None = None) -> np.ndarray | None:
    if method == "equal_weight":
        return np.full(len(mu), 1 / len(mu))
    if method == "min_variance":
        return quadratic.minimise(cov, mu, target, bounds.low, bounds.high)
    if method == "target_vol":
        return quadratic.target_volatility(mu, cov, target, bounds.low, bounds.high)
    if method == "max_sharpe":
        return quadratic.max_sharpe(mu, cov, bounds.rf, bounds.low, bounds.high)
    raise ValueError(f"unknown method {method!r}")


def optimised(arrays: DataFrame, keep: tuple[str, ...] = (), method: str = "max_sharpe", bounds: Bounds = Bounds(), target: float | None = None, ann: float = ANN_LIVE) -> DataFrame:
    """(…, asset, w, expected_return, volatility, sharpe_ratio, fallback) for each row of moment arrays; moments are
    annualised. Where the programme has no answer the weights are equal and ``fallback`` is true."""
    types = dict(arrays.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "asset string, w double, expected_return double, volatility double, sharpe_ratio double, fallback boolean"])

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                names, mu, cov = _unpack(r["cells"])
                mu, cov = mu * ann, cov * ann
                w = solve(mu, cov, method, bounds, target) if np.isfinite(cov).all() else None
                fallback = w is None
                w = np.full(len(mu), 1 / len(mu)) if fallback else w
                m, s = float(w @ mu), float(np.sqrt(max(w @ cov @ w, 0)))
                rows += [(*(r[k] for k in keep), a, float(x), m, s, (m - bounds.rf) / s if s > 0 else None, fallback) for a, x in zip(names, w)]
            yield pd.DataFrame(rows, columns=[*keep, "asset", "w", "expected_return", "volatility", "sharpe_ratio", "fallback"])

    return arrays.select(*keep, "cells").mapInPandas(run, schema)


def state_portfolios(sample: DataFrame, **how) -> DataFrame:
    """Portfolios of each state of labelled returns (dt, asset, r, regime): (k, asset, w, …)."""
    return optimised(moment_arrays(sample.withColumnRenamed("regime", "k"), ("k",)), ("k",), **how)


def unconditional_portfolio(returns: DataFrame, **how) -> DataFrame:
    return optimised(moment_arrays(returns), (), **how)


def efficient_frontier(returns: DataFrame, n: int = 50, bounds: Bounds = Bounds(), ann: float = ANN_LIVE) -> DataFrame:
    """(point, expected_return, volatility, asset, w) from the least-variance return to the greatest mean."""

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                names, mu, cov = _unpack(r["cells"])
                for i, (m, s, w) in enumerate(quadratic.frontier(mu * ann, cov * ann, n, bounds.low, bounds.high)):
                    rows += [(i, m, s, a, float(x)) for a, x in zip(names, w)]
            yield pd.DataFrame(rows, columns=["point", "expected_return", "volatility", "asset", "w"])

    return moment_arrays(returns).mapInPandas(run, "point int, expected_return double, volatility double, asset string, w double")


def _until(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, on): each day of the returns with the first of ``dates`` from it on; days after the last have none."""
    marked = returns.select("dt").distinct().join(dates.select("dt", F.col("dt").alias("d")).distinct(), "dt", "left")
    return marked.select("dt", F.min("d").over(Window.orderBy(F.col("dt").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("on")).filter("on is not null")


def expanding_moments(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, t, cells) on ``dates``: moments of all days up to each. Sums between two dates first, then sums of those."""
    two = pairs(returns).join(_until(returns, dates), "dt").groupBy("on", "a", "b").agg(F.count("ra").alias("n"), F.sum("ra").alias("sa"), F.sum("rb").alias("sb"), F.sum(F.col("ra") * F.col("rb")).alias("sab"))
    past = Window.partitionBy("a", "b").orderBy("on").rowsBetween(Window.unboundedPreceding, 0)
    two = two.select(F.col("on").alias("dt"), "a", "b", *(F.sum(c).over(past).alias(c) for c in ("n", "sa", "sb", "sab")))
    cov = F.when(F.col("n") > 1, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1))
    return _arrays(two.select("dt", "a", "b", cov.alias("cov"), (F.col("sa") / F.col("n")).alias("ma"), (F.col("n") - 1).alias("t")), ("dt", "t"))


def equal_weights(returns: DataFrame) -> DataFrame:
    return returns.select("asset").distinct().withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))


LIVE = Bounds(0.0, 0.40)


def backtest_unconditional(returns: DataFrame, min_train: int = 252, transaction_cost: float = 0.0005) -> DataFrame:
    """Expanding greatest-Sharpe path: equal weights until the first month end with ``min_train`` days behind it."""
    returns = returns.persist()
    arrays = expanding_moments(returns, rebalance_dates(returns.select("dt"))).filter(F.col("t") >= min_train)
    targets = optimised(arrays, ("dt",), bounds=LIVE).select("dt", "asset", "w")
    return drifted(returns, equal_weights(returns), targets, transaction_cost)


def weighted_expanding(returns: DataFrame, probs: DataFrame, dates: DataFrame, unbiased: bool = False) -> DataFrame:
    """(dt, t, k, total, cells) on ``dates``: probability-weighted moments of each state over all days up to each.

    Covariances are divided by the weights' sum or, ``unbiased``, by it less the sum of their squares over it.
    """
    p = F.col("p")
    weighted = pairs(returns).join(probs.select("dt", "k", "p"), "dt").join(_until(returns, dates), "dt")
    sums = weighted.groupBy("on", "k", "a", "b").agg(F.sum(p).alias("n"), F.sum(p * p).alias("n2"), F.sum(p * F.col("ra")).alias("sa"), F.sum(p * F.col("rb")).alias("sb"), F.sum(p * F.col("ra") * F.col("rb")).alias("sab"), F.count("p").alias("t"))
    past = Window.partitionBy("k", "a", "b").orderBy("on").rowsBetween(Window.unboundedPreceding, 0)
    x = sums.select(F.col("on").alias("dt"), "k", "a", "b", *(F.sum(c).over(past).alias(c) for c in ("n", "n2", "sa", "sb", "sab", "t"))).filter("n > 0").withColumn("t", F.col("t") - 1)
    scatter = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    x = x.withColumn("ma", F.col("sa") / F.col("n")).withColumn("cov", ratio(scatter, F.col("n") - F.col("n2") / F.col("n")) if unbiased else scatter / F.col("n"))
    return x.groupBy("dt", "t", "k").agg(F.max("n").alias("total"), F.array_sort(F.collect_list(F.struct("a", "b", "cov", "ma"))).alias("cells"))


def live_days(returns: DataFrame, signal: DataFrame) -> DataFrame:
    """(dt, t, place, p_1): the days that have returns and a signal, numbered from 0, with their place among all days of returns."""
    days = returns.select("dt").distinct().withColumn("place", F.row_number().over(Window.orderBy("dt")) - 1)
    common = days.join(signal.filter("p_1 IS NOT NULL").select("dt", "p_1"), "dt")
    return common.select("dt", (F.row_number().over(Window.orderBy("dt")) - 1).alias("t"), "place", "p_1")


def recompute_gate(days: DataFrame, min_train: int = 252, recompute: int = 63) -> DataFrame:
    """(dt, t, place, p_1, recomputed, portfolio_dt) of the month ends of ``days`` (dt, t, place, p_1) that rebalance.

    They have ``min_train`` or more days of returns before them. One recomputes the portfolios if it lies ``recompute`` or
    more days behind the last one that did, counted from day 0, or is day 0; ``portfolio_dt`` is the last that did, null
    while none has. The chain of recomputations is a fold over the month ends, one number a month.
    """
    ends = days.join(rebalance_dates(days.select("dt")), "dt").filter(F.col("place") >= min_train)
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("done"))
    again = lambda acc, t: (t - acc["last"] >= recompute) | (t == 0)
    step = lambda acc, t: F.when(again(acc, t), F.struct(t.alias("last"), F.concat(acc["done"], F.array(t)).alias("done"))).otherwise(acc)
    numbers = F.array_sort(F.collect_list(F.col("t").cast("long")))
    done = ends.agg(F.aggregate(numbers, start, step)["done"].alias("done")).select(F.explode("done").alias("t"), F.lit(True).alias("recomputed"))
    so_far = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = ends.join(done, "t", "left").withColumn("recomputed", F.coalesce("recomputed", F.lit(False)))
    return out.withColumn("portfolio_dt", F.last(F.when(F.col("recomputed"), F.col("dt")), True).over(so_far)).select("dt", "t", "place", "p_1", "recomputed", "portfolio_dt")


def live_state_portfolios(moments: DataFrame) -> DataFrame:
    """(dt, k, asset, w) of states' weighted moments: the greatest Sharpe ratio, or equal weights under 10 days of weight."""

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                names, mu, cov = _unpack(r["cells"])
                w = np.full(len(names), 1 / len(names)) if r["total"] < 10 else quadratic.live_max_sharpe(mu * ANN_LIVE, cov * ANN_LIVE)
                rows += [(r["dt"], int(r["k"]), a, float(x)) for a, x in zip(names, w)]
            yield pd.DataFrame(rows, columns=["dt", "k", "asset", "w"])

    return moments.select("dt", "k", "total", "cells").mapInPandas(run, "dt date, k int, asset string, w double")


def backtest_regimes(returns: DataFrame, probs: DataFrame, signal: DataFrame, min_train: int = 252, recompute: int = 63, transaction_cost: float = 0.0005) -> DataFrame:
    """Expanding state-aware path over the days with a signal. ``probs`` (dt, k, p) weight the moments of all days up to a
    recomputation, ``signal`` (dt, p_1) blends the portfolios.

    The path starts with equal weights on the first such day. Month ends of these days with ``min_train`` days of returns
    before them rebalance; portfolios are computed anew where :func:`recompute_gate` says so, and both are equal weights
    until then; a state with under 10 days of weight, or without any, has equal weights.
    """
    days = live_days(returns, signal)
    gate = recompute_gate(days, min_train, recompute)
    moments = weighted_expanding(returns, probs.filter("k in (0, 1)"), gate.filter("recomputed").select("dt"))
    found = live_state_portfolios(moments).withColumnsRenamed({"dt": "portfolio_dt", "w": "found"})
    even = equal_weights(returns).select("asset", F.col("w").alias("even"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    each = gate.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).join(even, "k").join(found, ["portfolio_dt", "k", "asset"], "left")
    share = F.when(F.col("k") == 1, F.col("p_1")).otherwise(1 - F.col("p_1"))
    blended = each.groupBy("dt", "asset").agg(F.sum(share * F.coalesce("found", "even")).alias("w"))
    targets = blended.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dt")))
    return drifted(returns.join(days.select("dt"), "dt"), equal_weights(returns), targets, transaction_cost)


def backtest_out_of_sample(returns: DataFrame, probs: DataFrame, initial: int = 1250, every: int = 63, transaction_cost: float = 0.0005, bounds: Bounds = Bounds(), blend: bool = True) -> DataFrame:
    """(strategy, dt, gross, turnover, cost, net) of three strategies from day ``initial`` on, without drift.

    Portfolios are computed every ``every`` days from the days before: unconditional; per state, with probabilities
    (dt, k, p) as weights; strategic, the states' blended by their mean probabilities so far. ``regime_aware`` blends the
    states' portfolios by the day's probabilities (or takes the most probable one's); without any that day the weights
    stay. Turnover is the whole absolute change of targets, 0 on the first day.
    """
    returns = returns.persist()
    days = returns.select("dt").distinct().withColumn("t", F.row_number().over(Window.orderBy("dt")) - 1)
    live = days.filter(F.col("t") >= initial).withColumn("block", F.floor((F.col("t") - initial) / every))
    starts = live.groupBy("block").agg(F.min("t").alias("t0"))
    before = days.join(starts, days["t"] == starts["t0"] - 1).select("dt", "block")  # the last day that a block's portfolios may know
    plain = optimised(expanding_moments(returns, before).join(before, "dt"), ("block",), bounds=bounds).select("block", "asset", "w")
    moments = weighted_expanding(returns, probs.filter("p > 0"), before, unbiased=True).join(before, "dt")
    state = optimised(moments, ("block", "k"), bounds=bounds).select("block", "k", "asset", "w")
    known = probs.join(_until(returns, before), "dt").groupBy("on", "k").agg(F.sum("p").alias("p"))
    so_far = Window.partitionBy("k").orderBy("on").rowsBetween(Window.unboundedPreceding, 0)
    shares = known.select(F.col("on").alias("dt"), "k", F.sum("p").over(so_far).alias("p")).join(before, "dt").select("block", "k", "p")

    def blended(x: DataFrame, by: str) -> DataFrame:
        return x.groupBy(by, "asset").agg(ratio(F.sum(F.col("p") * F.col("w")), F.sum("p")).alias("w"))

    strategic = blended(state.join(shares, ["block", "k"]), "block")
    if not blend:
        probs = probs.groupBy("dt").agg(F.max_by(F.struct("k"), F.struct("p", -F.col("k"))).alias("m")).select("dt", F.col("m.k").alias("k"), F.lit(1.0).alias("p"))
    aware = blended(live.join(probs, "dt").join(state, ["block", "k"]), "dt")
    spine = live.select("dt", F.lit(1).alias("o")).join(equal_weights(returns).select("asset", F.col("w").alias("even"), F.lit(1).alias("o")), "o")
    step = Window.partitionBy("asset").orderBy("dt")
    held = F.coalesce(F.last("w", True).over(step), F.col("even"))
    aware = spine.join(aware, ["dt", "asset"], "left").select("dt", "asset", held.alias("w"))
    each = live.select("dt", "block")
    weights = each.join(plain, "block").select(F.lit("unconditional").alias("strategy"), "dt", "asset", "w").unionByName(aware.select(F.lit("regime_aware").alias("strategy"), "dt", "asset", "w")).unionByName(each.join(strategic, "block").select(F.lit("strategic").alias("strategy"), "dt", "asset", "w"))
    change = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("strategy", "asset").orderBy("dt")))
    x = weights.withColumn("change", change).join(returns, ["dt", "asset"])
    out = x.groupBy("strategy", "dt").agg(F.ln(F.sum(F.col("w") * F.exp("r")) / F.sum("w")).alias("gross"), F.coalesce(F.sum("change"), F.lit(0.0)).alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * transaction_cost).withColumn("net", F.col("gross") - F.col("cost"))


def risk_report(paths: DataFrame, n_bootstrap: int = 5000, seed: int = 42) -> dict[str, DataFrame | str]:
    """Of (strategy, dt, net): ``performance`` (profiles with ranks), ``risk_metrics``, ``sharpe_tests``, ``drawdown_tests``
    and ``cvar_tests`` of every strategy against the unconditional (else the first) one, and a text ``summary``."""
    from functools import reduce

    from .backtest import drawdown_risk, strategy_profiles
    from .bootstrap import path_difference

    names = sorted(r["strategy"] for r in paths.select("strategy").distinct().collect())  # strategies are few
    base = next((n for n in names if n.lower() == "unconditional"), names[0])
    out: dict[str, DataFrame | str] = {"performance": strategy_profiles(paths), "risk_metrics": drawdown_risk(paths, keep=("strategy",))}
    for kind in ("sharpe", "drawdown", "cvar"):
        tests = [path_difference(paths, n, base, kind, n_bootstrap, seed).select(F.lit(f"{n} vs {base}").alias("comparison"), "*") for n in names if n != base]
        out[f"{kind}_tests"] = reduce(DataFrame.unionByName, tests) if tests else path_difference(paths, base, base, kind, 1, seed).limit(0).select(F.lit("").alias("comparison"), "*")
    best = out["performance"].toPandas().set_index("strategy")
    lines = ["Risk summary", ""]
    for label, column, greatest, form in (("Best Sharpe ratio", "sharpe_ratio", True, "{:.4f}"), ("Lowest maximum drawdown", "max_drawdown", False, "{:.2%}"), ("Best Calmar ratio", "calmar_ratio", True, "{:.4f}"), ("Lowest CVaR (95%)", "cvar_95", False, "{:.4%}")):
        which = (best[column].idxmax if greatest else best[column].idxmin)()
        lines.append(f"- {label}: {which} ({form.format(best.loc[which, column])})")
    for kind, form in (("sharpe", "{:.4f}"), ("drawdown", "{:.4%}")):
        for r in out[f"{kind}_tests"].collect():
            mark = "***" if r["p_value"] < 0.01 else "**" if r["p_value"] < 0.05 else "*" if r["p_value"] < 0.1 else ""
            lines.append(f"- {r['comparison']}: {kind} difference {form.format(r['diff'])}, p {r['p_value']:.4f} {mark}".rstrip())
    return out | {"summary": "\n".join(lines)}
