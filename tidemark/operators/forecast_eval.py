"""Forecast frames as windows and their scores: one-step AR(1) by expanding regressions, calibration, errors, hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import inv_logit, logit, ratio

EPS = 1e-8


def one_step_ar1(probs: DataFrame, min_train: int = 250) -> DataFrame:
    """(date_t, date_t1, p_ar_t1, p_rw_t1, z_t1): AR(1) on the logit of all days up to t, and today's level.

    The regression of each day is an aggregate over the rows before it, so the cost is linear in days.
    """
    w = Window.orderBy("dt")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    y = probs.select("dt", "p_1", logit(F.col("p_1")).alias("y"), (F.row_number().over(w) - 1).alias("t"))
    y = y.withColumn("ly", F.lag("y").over(w)).withColumn("p_next", F.lead("p_1").over(w)).withColumn("dt_next", F.lead("dt").over(w))
    y = y.withColumn("b", F.regr_slope("y", "ly").over(past)).withColumn("a", F.regr_intercept("y", "ly").over(past)).filter((F.col("t") >= min_train) & F.col("p_next").isNotNull())
    p = F.coalesce(inv_logit(F.col("a") + F.col("b") * F.col("y")), F.col("p_1"))  # a flat history forecasts today's level
    return y.select(F.col("dt").alias("date_t"), F.col("dt_next").alias("date_t1"), p.alias("p_ar_t1"), F.col("p_1").alias("p_rw_t1"), (F.col("p_next") > 0.5).cast("int").alias("z_t1"))


def long_methods(frame: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("ar").alias("method"), F.col("p_ar_t1").alias("p")), F.struct(F.lit("rw").alias("method"), F.col("p_rw_t1").alias("p")))
    return frame.select("date_t", F.inline(both), F.col("z_t1").alias("z"))


def scores(long: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss (clipped), hit rate at one half and that of always forecasting calm, of (…, p, z)."""
    q = F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS))
    z = F.col("z")
    loss = -(z * F.ln(q) + (1 - z) * F.ln(1 - q))
    hit = ((F.col("p") >= 0.5) == (z == 1)).cast("double")
    return long.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - z) ** 2).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(hit).alias("hit_rate"), F.avg((z == 0).cast("double")).alias("always_calm"))


def skill(scored: DataFrame, against: str, keep: Sequence[str] = ()) -> DataFrame:
    """1 - Brier / Brier of the method ``against``."""
    base = scored.filter(F.col("method") == against).select(*keep, F.col("brier").alias("base"))
    joined = scored.join(base, list(keep)) if keep else scored.withColumn("one", F.lit(1)).join(base.withColumn("one", F.lit(1)), "one").drop("one")
    return joined.withColumn("skill", 1 - ratio(F.col("brier"), F.col("base"))).drop("base")


def rolling_hits(frame: DataFrame, window: int = 252, full: bool = True) -> DataFrame:
    """(dt, hit_rate) of the last ``window`` forecasts; null until there are so many, unless not ``full``."""
    w = Window.orderBy("dt").rowsBetween(-(window - 1), 0)
    h = frame.select(F.col("date_t1").alias("dt"), ((F.col("p_ar_t1") >= 0.5) == (F.col("z_t1") == 1)).cast("double").alias("h"))
    rate = F.avg("h").over(w)
    return h.select("dt", (F.when(F.count("h").over(w) == window, rate) if full else rate).alias("hit_rate"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_z): bins of equal width over the range of p, closed on the right, the first on both sides."""
    ends = pairs.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("one", F.lit(1))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.greatest(F.ceil(ratio(F.col("p") - F.col("lo"), width)), F.lit(1))
    x = pairs.select("p", "z", F.lit(1).alias("one")).join(F.broadcast(ends), "one")
    return x.select("p", "z", F.coalesce(at, F.lit(1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("z").alias("mean_z"))


def forward_average(probs: DataFrame, h: int = 21) -> DataFrame:
    """Mean probability of the days t+h to t+2h-1, as far as there are such days."""
    return probs.select("dt", F.avg("p_1").over(Window.orderBy("dt").rowsBetween(h, 2 * h - 1)).alias("p_1_oracle_fwd"))


def persistence(probs: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(origin_dt, h, forecast_dt, p_hat, p): today's level as forecast of each horizon, with what came."""
    w = Window.orderBy("dt")
    ahead = probs.select(F.col("dt").alias("origin_dt"), F.col("p_1").alias("p_hat"), *(c for h in horizons for c in (F.lead("dt", h).over(w).alias(f"dt{h}"), F.lead("p_1", h).over(w).alias(f"p{h}"))))
    each = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"dt{h}").alias("forecast_dt"), F.col(f"p{h}").alias("p")) for h in horizons))
    return ahead.select("origin_dt", "p_hat", F.inline(each)).filter("p IS NOT NULL")


def with_realised(forecasts: DataFrame, probs: DataFrame) -> DataFrame:
    """Forecasts (…, forecast_dt, p_hat) with the day's value p; those without a day go."""
    return forecasts.join(probs.select(F.col("dt").alias("forecast_dt"), F.col("p_1").alias("p")), "forecast_dt")


def error_by_horizon(joined: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    e = F.col("p_hat") - F.col("p")
    g = joined.groupBy(*keep, "h").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.covar_samp("p_hat", "p").alias("c"), F.stddev_samp("p_hat").alias("s1"), F.stddev_samp("p").alias("s2"))
    return g.select(*keep, "h", "n", "mae", "mse", F.sqrt("mse").alias("rmse"), ratio(F.col("c"), F.col("s1") * F.col("s2")).alias("corr"))


def fan(forecasts: DataFrame) -> DataFrame:
    q = F.percentile("p_hat", [0.1, 0.5, 0.9])
    return forecasts.groupBy("forecast_dt").agg(q.alias("q")).select("forecast_dt", F.get("q", F.lit(0)).alias("q10"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q90"))


def thinned(forecasts: DataFrame, every: int) -> DataFrame:
    """Forecasts of every n-th origin."""
    origins = forecasts.select("origin_dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("origin_dt")) - 1).filter(F.col("i") % every == 0)
    return forecasts.join(origins.select("origin_dt"), "origin_dt", "left_semi")
