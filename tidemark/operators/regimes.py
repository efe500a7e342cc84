"""Labels and probabilities of market states: joins by time, moments, quantiles, tails, runs, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hard_label, ratio

ANN = 248.48


def proxy_states(returns: DataFrame, window: int = 21) -> DataFrame:
    """(dt, v, p_1, regime2, regime3): states from the rolling volatility of the mean return, without a fit.

    p_1 is a logistic of the standardised volatility; regime2 splits at the median, regime3 at .34 and .67. Days
    before the window is full have none.
    """
    w = Window.orderBy("dt").rowsBetween(-(window - 1), 0)
    mean = returns.groupBy("dt").agg(F.avg("r").alias("m"))
    vol = mean.select("dt", F.stddev_samp("m").over(w).alias("v"), F.count("m").over(w).alias("n")).filter(F.col("n") == window)
    whole = Window.partitionBy()  # one row per day
    v = F.col("v")
    p = 1 / (1 + F.exp(-ratio(v - F.avg("v").over(whole), F.stddev_samp("v").over(whole))))
    above = lambda q: (v > F.percentile("v", q).over(whole)).cast("int")
    return vol.select("dt", "v", p.alias("p_1"), above(0.5).alias("regime2"), (above(0.34) + above(0.67)).alias("regime3"))


def hard_labels(probs: DataFrame) -> DataFrame:
    """(dt, regime) of long probabilities (dt, k, p): the most probable, of ties the lowest."""
    return probs.groupBy("dt").agg(F.max_by(F.struct((-F.col("k")).alias("k")), F.struct("p", (-F.col("k")).alias("t"))).alias("m")).select("dt", (-F.col("m.k")).cast("int").alias("regime"))


def hard_labels_of_array(probs: DataFrame, column: str = "p") -> DataFrame:
    return probs.select("dt", hard_label(F.col(column)).alias("regime"))


def split_counts(probs: DataFrame, column: str = "p_1", threshold: float = 0.5) -> DataFrame:
    return probs.agg(F.count_if(~(F.col(column) > threshold)).alias("n_low"), F.count_if(F.col(column) > threshold).alias("n_high"))


def normalised(probs: DataFrame) -> DataFrame:
    """Long probabilities divided by their day's sum; 0 where the sum is 0."""
    day = Window.partitionBy("dt")
    return probs.withColumn("p", F.coalesce(ratio(F.col("p"), F.sum("p").over(day)), F.lit(0.0)))


def labelled(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns of the days that have a label: (dt, asset, r, regime)."""
    return returns.join(labels.select("dt", "regime").filter("regime IS NOT NULL"), "dt").filter("r IS NOT NULL")


def moments(sample: DataFrame, min_n: int = 1) -> DataFrame:
    """Per regime and asset: n, mean, variance, volatility, bias-adjusted skewness and excess kurtosis."""
    n, g1, g2 = F.count("r"), F.skewness("r"), F.kurtosis("r")
    return (
        sample.groupBy("regime", "asset").agg(n.alias("n"), F.avg("r").alias("mean"), F.var_samp("r").alias("var"), F.stddev_samp("r").alias("vol"), g1.alias("g1"), g2.alias("g2")).filter(F.col("n") >= min_n)
        .withColumn("skew", F.when(F.col("n") > 2, F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1.0)) / (F.col("n") - 2)))
        .withColumn("kurt", F.when(F.col("n") > 3, (F.col("n") - 1.0) / ((F.col("n") - 2.0) * (F.col("n") - 3)) * ((F.col("n") + 1) * F.col("g2") + 6))).drop("g1", "g2")
    )


def quantiles(sample: DataFrame, levels: Sequence[float] = (0.05, 0.10, 0.25), min_n: int = 50) -> DataFrame:
    """Exact linear-interpolation quantiles by regime and asset: (regime, asset, n, level, q)."""
    by = sample.groupBy("regime", "asset").agg(F.count("r").alias("n"), F.percentile("r", list(levels)).alias("q")).filter(F.col("n") >= min_n)
    return by.select("regime", "asset", "n", F.posexplode("q").alias("i", "q")).select("regime", "asset", "n", F.get(F.array(*map(F.lit, levels)), F.col("i")).alias("level"), "q")


def var_es(sample: DataFrame, levels: Sequence[float] = (0.05, 0.10), min_n: int = 50) -> DataFrame:
    """Value at risk (the quantile) and expected shortfall (mean of what is not above it)."""
    q = quantiles(sample, levels, min_n)
    tail = sample.join(q, ["regime", "asset"]).filter("r <= q").groupBy("regime", "asset", "level").agg(F.avg("r").alias("es"), F.count("r").alias("n_tail"))
    return q.join(tail, ["regime", "asset", "level"], "left").select("regime", "asset", "n", "level", F.col("q").alias("var"), "es", "n_tail")


def valid_samples(sample: DataFrame, min_n: int = 50) -> DataFrame:
    return sample.join(sample.groupBy("regime", "asset").agg(F.count("r").alias("n")).filter(F.col("n") >= min_n).select("regime", "asset"), ["regime", "asset"], "left_semi")


def pairs(returns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each day's returns of every unordered pair of assets (a < b)."""
    a = returns.select("dt", *keep, F.col("asset").alias("a"), F.col("r").alias("ra"))
    b = returns.select("dt", F.col("asset").alias("b"), F.col("r").alias("rb"))
    return a.join(b, "dt").filter("a <= b")


def correlation_matrix(returns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(…, a, b, n, cov, corr) for a <= b; the correlation with a constant series is null."""
    two = pairs(returns, keep).groupBy(*keep, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ra", "rb").alias("cov"), F.stddev_samp("ra").alias("sa"), F.stddev_samp("rb").alias("sb"))
    return two.select(*keep, "a", "b", "n", "cov", ratio(F.col("cov"), F.col("sa") * F.col("sb")).alias("corr"))


def mean_abs_correlation(returns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return correlation_matrix(returns, keep).filter("a < b").groupBy(*keep).agg(F.avg(F.abs("corr")).alias("mean_abs_corr"))


def run_lengths(labels: DataFrame, key: str = "regime") -> DataFrame:
    """(run, label, n, first, last): maximal runs of one label in order of dt."""
    w = Window.orderBy("dt")
    change = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    runs = labels.withColumn("c", change).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run", F.col(key).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


def turnover_stats(labels: DataFrame, key: str = "regime") -> DataFrame:
    """Share of days with another label than the day before, mean and median run length."""
    return run_lengths(labels, key).agg(
        ratio(F.count(F.lit(1)) - 1, F.sum("n") - 1).cast("double").alias("turnover_rate"), F.avg("n").alias("avg_run_length"), F.percentile("n", 0.5).alias("med_run_length")
    )


# ---- windows and what they serve ------------------------------------------------------------------------


def estimation_windows(days: DataFrame, size: int, step: int, partial: bool = False) -> DataFrame:
    """(w, s, e, end_dt): rolling windows over the places 0..T-1 of (t, dt). Fewer days than one window: none.

    With ``partial`` shrinking windows go on while they start before the end.
    """
    total = days.agg(F.max("t").alias("m")).select((F.col("m") + 1).alias("n"))
    last = F.col("n") - 1 if partial else F.col("n") - size
    starts = total.filter(last >= 0).select("n", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("s"))
    e = F.least(F.col("s") + size, F.col("n")) - 1
    w = starts.select((F.col("s") / step).cast("int").alias("w"), "s", e.alias("e"))
    return w.join(days.select(F.col("t").alias("e"), F.col("dt").alias("end_dt")), "e").select("w", "s", "e", "end_dt")


def one_sided_serving(days: DataFrame, windows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(…, t, dt, w): the latest window that ends strictly before the day. Days up to the first end have none.

    Each window is spread over the days that it serves, so days and windows meet in an equi-join.
    """
    n = days.agg(F.max("t").alias("m")).first()["m"]
    if n is None:
        return windows.select(*keep).join(days.select("t", "dt", F.lit(None).cast("int").alias("w")), F.lit(True)) if keep else days.select("t", "dt", F.lit(None).cast("int").alias("w"))
    ends = windows.select(*keep, "w", "e", F.lead("e").over(Window.partitionBy(*keep).orderBy("e")).alias("next"))
    served = ends.select(*keep, "w", (F.col("e") + 1).alias("a"), F.least(F.coalesce("next", F.lit(n)), F.lit(n)).alias("b")).filter("a <= b").select(*keep, "w", F.explode(F.sequence("a", "b")).alias("t"))
    return days.select("t", "dt").join(served, "t").select(*keep, "t", "dt", "w")


def covering(days: DataFrame, windows: DataFrame) -> DataFrame:
    """(t, dt, w) for every window that contains the day."""
    return days.select("t", "dt").join(windows.select("w", F.explode(F.sequence("s", "e")).alias("t")), "t")


def retrospective(probs: DataFrame) -> DataFrame:
    """Mean over all windows that contain a day of long (w, t, dt, k, p), 0 for states that a window lacks.

    With a ``config_id`` each configuration by itself. Every window has state 0, so its rows count a day's windows.
    """
    keep = [c for c in ("config_id",) if c in probs.columns]
    by = probs.groupBy(*keep, "t", "dt", "k").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    by = by.withColumn("last", F.max("k").over(Window.partitionBy(*keep)))  # over one row per day and state
    day = by.groupBy(*keep, "t", "dt").agg(F.max("n").alias("n"), F.first("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("sums"))
    spread = day.select(*keep, "t", "dt", "n", "sums", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("k"))
    return spread.select(*keep, "t", "dt", "k", (F.coalesce(F.try_element_at("sums", F.col("k").cast(probs.schema["k"].dataType)), F.lit(0.0)) / F.col("n")).alias("p"))


def window_means(probs: DataFrame) -> DataFrame:
    return probs.groupBy("w", "k").agg(F.avg("p").alias("p"))


def effective_sizes(resp: DataFrame) -> DataFrame:
    """(w, k, neff, min_neff) of responsibilities (w, t, k, p)."""
    return resp.groupBy("w", "k").agg(F.sum("p").alias("neff")).withColumn("min_neff", F.min("neff").over(Window.partitionBy("w")))


def weighted_moments(resp: DataFrame, returns: DataFrame) -> DataFrame:
    """Responsibility-weighted mean and volatility: (w, k, asset, mean, vol, weight); resp has (w, t, dt, k, p)."""
    centre = F.avg("r").over(Window.partitionBy("asset"))  # sums of squares about it do not cancel
    joined = resp.join(returns.withColumn("c", centre).withColumn("x", F.col("r") - F.col("c")), "dt")
    out = joined.groupBy("w", "k", "asset").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("x")).alias("s1"), F.sum(F.col("p") * F.col("x") * F.col("x")).alias("s2"), F.first("c").alias("c"), F.avg("p").alias("weight"))
    n = F.col("s") + 1e-15
    mean = (F.col("s1") + F.col("c") * F.col("s")) / n
    off = mean - F.col("c")
    var = (F.col("s2") - 2 * off * F.col("s1") + off * off * F.col("s")) / n
    return out.select("w", "k", "asset", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("vol"), "weight")


def pooled(moments_long: DataFrame) -> DataFrame:
    """Means over windows with each window's weight: (k, asset, mean_wavg, vol_wavg, avg_regime_weight, n_windows)."""
    w = F.sum("weight")
    return moments_long.groupBy("k", "asset").agg(
        ratio(F.sum(F.col("mean") * F.col("weight")), w).alias("mean_wavg"), ratio(F.sum(F.col("vol") * F.col("weight")), w).alias("vol_wavg"), F.avg("weight").alias("avg_regime_weight"), F.count_distinct("w").alias("n_windows")
    )


def select_pair(sample: DataFrame, mode: str = "ordered", min_n: int = 50) -> DataFrame:
    """(regime_low, regime_high): one row; the first and last label, or (``realised_vol``) those of least and greatest
    mean volatility over assets, among states with ``min_n`` days or more (of ties the lower label). Raises under two states."""
    if mode not in ("ordered", "realised_vol"):
        raise ValueError("mode must be 'ordered' or 'realised_vol'")
    ends = sample.agg(F.min("regime").alias("a"), F.max("regime").alias("b"))
    checked = F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("two states are needed")).cast("int"))
    ends = ends.select(checked.alias("a"), "b")
    if mode == "ordered":
        return ends.select(F.col("a").alias("regime_low"), F.col("b").alias("regime_high"))
    vols = sample.groupBy("regime", "asset").agg(F.stddev_samp("r").alias("sd"), F.count("r").alias("n")).groupBy("regime").agg(F.avg("sd").alias("v"), F.max("n").alias("n")).filter((F.col("n") >= min_n) & F.col("v").isNotNull())
    key = F.struct("v", "regime")
    both = vols.agg(F.count(F.lit(1)).alias("m"), F.min(key)["regime"].alias("low"), F.max(F.struct("v", (-F.col("regime")).alias("k")))["k"].alias("high"))
    few = F.col("m") < 2
    return ends.join(both, F.lit(True)).select(F.when(few, F.col("a")).otherwise(F.col("low")).alias("regime_low"), F.when(few, F.col("b")).otherwise(-F.col("high")).alias("regime_high"))  # one row each


def pooled_equal(moments_long: DataFrame, n_windows: int, last_k: int) -> DataFrame:
    """Means over all windows with equal weight, also over those that lack a state, of the states of the last window."""
    return moments_long.filter(F.col("k") < last_k).groupBy("k", "asset").agg((F.sum("mean") / n_windows).alias("mean"), (F.sum("vol") / n_windows).alias("vol"))


def last_window(moments_long: DataFrame) -> DataFrame:
    last = moments_long.agg(F.max("w").alias("w"))
    return moments_long.join(last, "w", "left_semi")


def k_stability(ks: DataFrame) -> DataFrame:
    """Share of windows (w, k_selected) that choose as many states as the window before."""
    prev = F.lag("k_selected").over(Window.orderBy("w"))
    return ks.select((F.col("k_selected") == prev).cast("double").alias("same")).agg(F.avg("same").alias("k_stability"))


def dominant_autocorrelation(probs: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation of each day's greatest probability (dt, k, p)."""
    top = probs.groupBy("dt").agg(F.max("p").alias("p")).select("dt", "p", F.lag("p").over(Window.orderBy("dt")).alias("q")).filter("q IS NOT NULL")
    return top.agg(ratio(F.covar_samp("p", "q"), F.stddev_samp("p") * F.stddev_samp("q")).alias("autocorr"))


def label_changes(before: DataFrame, after: DataFrame, first: int = 10) -> DataFrame:
    """Two p_1 series (dt, p_1): common days, mean and greatest difference, correlation, flips and the first days of them."""
    both = before.select("dt", F.col("p_1").alias("a")).join(after.select("dt", F.col("p_1").alias("b")), "dt").withColumn("flip", (F.col("a") > 0.5) != (F.col("b") > 0.5))
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(
        F.count(F.lit(1)).alias("n_common"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), ratio(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("corr"), F.count_if("flip").alias("n_flips"),
        F.concat_ws(",", F.slice(F.array_sort(F.collect_list(F.when(F.col("flip"), F.col("dt").cast("string")))), 1, first)).alias("first_flips"),
    )


def first_wins(*frames: DataFrame) -> DataFrame:
    """Long panels as one: of a (dt, asset) in several the first frame's row, also if it is null."""
    out = None
    for i, f in enumerate(frames):
        one = f.select("dt", "asset", "r", F.lit(i).alias("source"))
        out = one if out is None else out.unionByName(one)
    keep = out.groupBy("asset").agg(F.min("source").alias("source"))
    return out.join(keep, ["asset", "source"]).select("dt", "asset", "r")


def mid_rank(value: str, partition: Sequence[str] = (), descending: bool = False):
    """Average rank of ties, from 1."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)
