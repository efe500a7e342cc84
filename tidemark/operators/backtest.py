"""Backtests as segmented windows, and the risk and performance of their paths.

Between two rebalances an asset's value is its weight times the exponential of its summed log returns, so a drifting
portfolio needs no day-by-day recursion: a window within each segment gives all values, a sum by day the portfolio.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .panel import rebalance_dates
from .regimes import mid_rank, pairs

ANN_LIVE, ANN_CLASS = 248.48, 252.0


def segments(days: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(dt, flag, seg): whether the day rebalances, and how many rebalances came strictly before it."""
    flagged = days.select("dt").distinct().join(rebalances.select("dt", F.lit(1).alias("f")).distinct(), "dt", "left").withColumn("flag", F.coalesce("f", F.lit(0)))
    before = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    return flagged.select("dt", "flag", F.coalesce(F.sum("flag").over(before), F.lit(0)).alias("seg"))


def drifted(returns: DataFrame, initial: DataFrame, targets: DataFrame, transaction_cost: float = 0.0005) -> DataFrame:
    """(dt, gross, turnover, cost, net) of a portfolio that drifts from ``initial`` (asset, w) and is set to
    ``targets`` (dt, asset, w) at the end of each of their days. Turnover is half of the summed weight changes."""
    seg = segments(returns, targets)
    w = initial.select(F.lit(0).cast("long").alias("seg"), "asset", "w").unionByName(targets.join(seg, "dt").select((F.col("seg") + 1).alias("seg"), "asset", "w"))
    later = Window.partitionBy("asset").orderBy("seg")  # a target follows in the next segment, or the asset has none there
    w = w.withColumn("next", F.when(F.lead("seg").over(later) == F.col("seg") + 1, F.lead("w").over(later)))
    path = Window.partitionBy("seg", "asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    v = returns.join(seg, "dt").join(w, ["seg", "asset"]).withColumn("v", F.col("w") * F.exp(F.sum("r").over(path)))
    moved = F.when(F.col("flag") == 1, F.abs(F.col("next") - F.col("v") / F.sum("v").over(Window.partitionBy("dt"))))
    day = v.withColumn("moved", moved).groupBy("dt", "seg").agg(F.sum("v").alias("total"), F.sum("w").alias("start"), (F.coalesce(F.sum("moved"), F.lit(0.0)) / 2).alias("turnover"))
    order = Window.partitionBy("seg").orderBy("dt")
    out = day.withColumn("gross", F.ln("total") - F.coalesce(F.lag(F.ln("total")).over(order), F.ln("start")))
    return out.select("dt", "gross", "turnover", (F.col("turnover") * transaction_cost).alias("cost"), (F.col("gross") - F.col("turnover") * transaction_cost).alias("net"))


def static_backtest(returns: DataFrame, weights: Mapping[str, float] | None = None, frequency: str = "M", transaction_cost: float = 0.001) -> DataFrame:
    """Fixed weights (equal ones if None), restored on the last day of each month, week or quarter.

    The panel of returns is kept (in memory and on disk, with its lineage): the plan reads it several times, and it
    has a row per day and asset however large the table is that it comes from.
    """
    returns = returns.persist()
    if weights is None:
        names = returns.select("asset").distinct()
        fixed = names.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))
    else:
        fixed = returns.sparkSession.createDataFrame(list(weights.items()), "asset string, w double")
    dates = rebalance_dates(returns.select("dt"), frequency)
    arrays = fixed.agg(F.collect_list(F.struct("asset", "w")).alias("all"), F.lit(1).alias("one"))
    targets = dates.withColumn("one", F.lit(1)).join(arrays, "one").select("dt", F.inline("all"))
    return drifted(returns, fixed, targets, transaction_cost)


def labelled_targets(days: DataFrame, labels: DataFrame, portfolios: DataFrame, frequency: str = "M") -> DataFrame:
    """Targets on rebalance days from the portfolio (k, asset, w) of the day's label."""
    dates = rebalance_dates(days.select("dt"), frequency)
    return dates.join(labels.select("dt", F.col("regime").alias("k")), "dt").join(portfolios, "k").select("dt", "asset", "w")


def blended_targets(days: DataFrame, probs: DataFrame, portfolios: DataFrame, frequency: str = "M", blend: bool = True) -> DataFrame:
    """Targets on rebalance days: probability-weighted portfolios (dt, k, p), or that of the most probable state."""
    dates = rebalance_dates(days.select("dt"), frequency)
    on_dates = probs.join(dates, "dt", "left_semi")
    if not blend:
        on_dates = on_dates.withColumn("best", F.row_number().over(Window.partitionBy("dt").orderBy(F.col("p").desc(), "k"))).filter("best = 1").withColumn("p", F.lit(1.0))
    mixed = on_dates.join(portfolios, "k").groupBy("dt", "asset").agg(F.sum(F.col("p") * F.col("w")).alias("w"))
    return mixed.withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("dt"))))


def strategic(portfolios: DataFrame, shares: DataFrame) -> DataFrame:
    """Blend of portfolios (k, asset, w) by long-run shares (k, p), renormalised."""
    mixed = portfolios.join(shares, "k").groupBy("asset").agg(F.sum(F.col("p") * F.col("w")).alias("w"))
    return mixed.withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy())))


# ---- paths ----------------------------------------------------------------------------------------------


def drawdowns(path: DataFrame, value: str = "net", keep: Sequence[str] = ()) -> DataFrame:
    """(…, dt, r, wealth, peak, drawdown). The first peak is the first wealth, not 1."""
    w = Window.partitionBy(*keep).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    wealth = path.select(*keep, "dt", F.col(value).alias("r")).withColumn("wealth", F.exp(F.sum("r").over(w)))
    return wealth.withColumn("peak", F.max("wealth").over(w)).withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def longest_drawdown(dd: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(…, max_dd_duration): days of the longest stretch below the peak."""
    w = Window.partitionBy(*keep).orderBy("dt")
    at = dd.withColumn("i", F.row_number().over(w)).filter("wealth < peak").withColumn("run", F.col("i") - F.row_number().over(w))
    longest = at.groupBy(*keep, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*keep).agg(F.max("n").alias("longest"))
    if not keep:
        return longest.select(F.coalesce("longest", F.lit(0)).alias("max_dd_duration"))
    return dd.select(*keep).distinct().join(longest, list(keep), "left").select(*keep, F.coalesce("longest", F.lit(0)).alias("max_dd_duration"))


def _adjusted(n, g1, g2):
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def performance(path: DataFrame, value: str = "net", keep: Sequence[str] = (), ann: float = ANN_LIVE) -> DataFrame:
    """Geometric annual return, volatility, Sharpe, Sortino (deviation of negative returns) and worst drawdown."""
    dd = drawdowns(path, value, keep)
    agg = dd.groupBy(*keep).agg(
        F.sum("r").alias("s"), F.count("r").alias("n"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("drawdown").alias("max_drawdown"),
        F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"), F.percentile("r", 0.05).alias("var_5pct"),
    )
    a = F.exp("s") ** F.try_divide(F.lit(ann), F.col("n")) - 1
    vol = F.col("sd") * (ann**0.5)
    skew, kurt = _adjusted(F.col("n"), F.col("g1"), F.col("g2"))
    zero = F.lit(0.0)
    return agg.select(
        *keep, (F.exp("s") - 1).alias("total_return"), a.alias("ann_return"), vol.alias("ann_volatility"), F.when(vol > 0, a / vol).otherwise(zero).alias("sharpe_ratio"),
        F.when(F.col("down") > 0, a / (F.col("down") * ann**0.5)).otherwise(zero).alias("sortino_ratio"), "max_drawdown", F.when(F.col("max_drawdown") != 0, a / F.abs("max_drawdown")).otherwise(zero).alias("calmar_ratio"),
        skew.alias("skewness"), kurt.alias("kurtosis"), "var_5pct", F.col("n").alias("n_days"),
    )


def tail_risk(path: DataFrame, levels: Sequence[float] = (0.95, 0.99), value: str = "net", keep: Sequence[str] = ()) -> DataFrame:
    """(…, level, var, cvar) as positive losses."""
    base = path.select(*keep, F.col(value).alias("r"))
    q = base.groupBy(*keep).agg(F.percentile("r", [1 - x for x in levels]).alias("q")).select(*keep, F.posexplode("q").alias("i", "q")).select(*keep, F.get(F.array(*map(F.lit, levels)), F.col("i")).alias("level"), "q")
    joined = base.join(q, list(keep)) if keep else base.withColumn("one", F.lit(1)).join(q.withColumn("one", F.lit(1)), "one")
    return joined.filter("r <= q").groupBy(*keep, "level", "q").agg(F.avg("r").alias("es")).select(*keep, "level", (-F.col("q")).alias("var"), (-F.col("es")).alias("cvar"))


def drawdown_risk(path: DataFrame, value: str = "net", keep: Sequence[str] = ()) -> DataFrame:
    """Worst and mean drawdown (positive), ulcer and pain index, duration, Calmar on the arithmetic return, downside deviation."""
    so_far = Window.partitionBy(*keep).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    below = (F.col("wealth") < F.col("peak")).cast("int")
    dd = drawdowns(path, value, keep).withColumn("peaks", F.sum(1 - below).over(so_far))  # days below a peak share its number
    dd = dd.withColumn("run", F.sum(below).over(Window.partitionBy(*keep, "peaks")))
    agg = dd.groupBy(*keep).agg(
        (-F.min("drawdown")).alias("max_drawdown"), F.coalesce(-F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"),
        F.avg(F.abs("drawdown")).alias("pain_index"), (F.avg("r") * ANN_CLASS).alias("ann_mean"), (F.stddev_samp("r") * ANN_CLASS**0.5).alias("ann_vol"), F.sqrt(F.avg(F.least("r", F.lit(0.0)) ** 2)).alias("dd0"), F.count("r").alias("n"),
        F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("max_dd_duration"),
    )
    return agg.withColumn("calmar_ratio", F.when(F.col("max_drawdown") > 0, F.col("ann_mean") / F.col("max_drawdown"))).withColumn("downside_dev", F.col("dd0") * ANN_CLASS**0.5).drop("dd0")


def rolling_sharpe(path: DataFrame, window: int = 252, value: str = "net", ann: float = ANN_CLASS) -> DataFrame:
    """Mean over deviation of the last ``window`` days, annualised; null until there are so many."""
    w = Window.orderBy("dt").rowsBetween(-(window - 1), 0)
    return path.select("dt", F.when(F.count(value).over(w) == window, ratio(F.avg(value).over(w), F.stddev_samp(value).over(w)) * ann**0.5).alias("rolling_sharpe"))


def monthly_turnover(path: DataFrame) -> DataFrame:
    return path.groupBy(F.last_day("dt").alias("month")).agg(F.sum("turnover").alias("turnover"))


def risk_contributions(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """(asset, w, contribution, share): w_i (C w)_i / volatility, and its part of all. ``covariance``: (a, b, cov), a <= b."""
    both = covariance.select("a", "b", "cov").union(covariance.filter("a <> b").select(F.col("b"), F.col("a"), F.col("cov")))
    inner = both.join(weights.select(F.col("asset").alias("b"), F.col("w").alias("wb")), "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("m"))
    x = inner.join(weights.select(F.col("asset").alias("a"), "w"), "a").withColumn("part", F.col("w") * F.col("m"))
    var = F.sum("part").over(Window.partitionBy())
    return x.select(F.col("a").alias("asset"), "w", F.when(var > 0, F.col("part") / F.sqrt(var)).alias("contribution"), ratio(F.col("part"), var).alias("share"))


def rolling_risk_shares(returns: DataFrame, weights: DataFrame, window: int = 63) -> DataFrame:
    """(dt, asset, share) from the covariance of the ``window`` days before each day, without it."""
    p = pairs(returns)
    w = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(-window, -1)
    cov = p.select("dt", "a", "b", F.covar_samp("ra", "rb").over(w).alias("cov"), F.count("ra").over(w).alias("n")).filter(F.col("n") == window)
    both = cov.select("dt", "a", "b", "cov").union(cov.filter("a <> b").select("dt", F.col("b"), F.col("a"), "cov"))
    wa, wb = weights.select(F.col("asset").alias("a"), F.col("w").alias("wa")), weights.select(F.col("asset").alias("b"), F.col("w").alias("wb"))
    part = both.join(wa, "a").join(wb, "b").groupBy("dt", "a").agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("part"))
    return part.select("dt", F.col("a").alias("asset"), ratio(F.col("part"), F.sum("part").over(Window.partitionBy("dt"))).alias("share"))


def cost_sensitivity(returns: DataFrame, costs: Sequence[float] = tuple(i / 10_000 for i in range(1, 11)), frequency: str = "M") -> DataFrame:
    """Performance for each cost; the gross path and its turnover are computed once."""
    path = static_backtest(returns, frequency=frequency)
    grid = path.withColumn("tc", F.explode(F.array(*map(F.lit, costs)))).withColumn("net", F.col("gross") - F.col("turnover") * F.col("tc"))
    return performance(grid, keep=("tc",), ann=ANN_CLASS).withColumn("tc_bps", F.col("tc") * 10_000).drop("tc")


def strategy_profiles(paths: DataFrame) -> DataFrame:
    """One row per strategy of (strategy, dt, net): risk figures, and ranks with averaged ties.

    Ranks count from the least for risks and from the greatest for returns.
    """
    risk = drawdown_risk(paths, keep=("strategy",)).filter("n >= 30")
    tails = tail_risk(paths, keep=("strategy",)).groupBy("strategy").pivot("level", [0.95, 0.99]).agg(F.first("var").alias("var"), F.first("cvar").alias("cvar"))
    names = {"0.95_var": "var_95", "0.99_var": "var_99", "0.95_cvar": "cvar_95", "0.99_cvar": "cvar_99"}
    tails = tails.select("strategy", *(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    out = risk.join(tails, "strategy").withColumn("sharpe_ratio", ratio(F.col("ann_mean"), F.col("ann_vol"))).withColumn("sortino_ratio", ratio(F.col("ann_mean"), F.col("downside_dev"))).withColumnRenamed("ann_mean", "ann_return").withColumnRenamed("ann_vol", "ann_volatility")
    low = ("var_95", "var_99", "cvar_95", "cvar_99", "max_drawdown", "avg_drawdown", "max_dd_duration", "ulcer_index", "pain_index", "downside_dev")
    high = ("ann_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio")
    return out.withColumns({f"{c}_rank": mid_rank(c, descending=c in high) for c in (*low, *high)})


def compare_portfolios(paths: DataFrame, ann: float = ANN_LIVE) -> DataFrame:
    """Performance and turnover of (strategy, dt, turnover, cost, net), one row per strategy."""
    traded = paths.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"), F.sum("turnover").alias("total_turnover"), F.sum("cost").alias("total_tc"))
    return performance(paths, keep=("strategy",), ann=ann).join(traded, "strategy")


def compare_out_of_sample(paths: DataFrame) -> DataFrame:
    """One row per strategy of out-of-sample paths: arithmetic annual return and volatility, ratios, drawdown, tail loss, turnover."""
    risk = drawdown_risk(paths, keep=("strategy",))
    tail = tail_risk(paths, (0.95,), keep=("strategy",)).select("strategy", F.col("cvar").alias("cvar_95"))
    traded = paths.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_tc"))
    out = risk.join(tail, "strategy").join(traded, "strategy")
    down = F.when(F.col("downside_dev") > 0, F.col("ann_mean") / F.col("downside_dev"))
    return out.select("strategy", F.col("ann_mean").alias("ann_return"), F.col("ann_vol").alias("ann_volatility"), ratio(F.col("ann_mean"), F.col("ann_vol")).alias("sharpe_ratio"), "max_drawdown", "calmar_ratio", "cvar_95", down.alias("sortino_ratio"), "avg_turnover", "total_tc")
