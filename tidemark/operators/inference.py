"""Tests between market states: statistics by aggregation and windows, tails by vectorised functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.scalar import ratio, stars
from .regimes import mid_rank, valid_samples


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", q: str = "q_value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Step-up adjusted values: the least p m / rank from the row's rank on, at most 1. Null p-values have none.

    Equal p-values have one adjusted value, that of their last rank, so the work is on different ones. They are dealt by
    octaves cut in 256; a task ranks those of one, and only the sizes and least values of the cuts are put in line.
    ``tests`` is kept, as sums in another order could give other last digits in a second reading.
    """
    part = tests.filter(F.col(p).isNotNull()).persist()
    of = F.struct(F.lit(0).alias("all"), *keep)  # equal also where a column is null
    cut = F.when(F.isnan("_p"), F.lit((1 << 63) - 1)).otherwise(F.coalesce(F.floor(F.log2("_p") * 256), F.lit(-1 << 62)))
    values = part.groupBy(of.alias("_of"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_cut", cut)
    line = Window.partitionBy("_of").orderBy("_cut")
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = values.groupBy("_of", "_cut").agg(F.sum("_c").alias("_n")).select("_of", "_cut", before.alias("_before"), F.sum("_n").over(Window.partitionBy("_of")).alias("_m"))
    up, down = (Window.partitionBy("_of", "_cut").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_p"), F.col("_p").desc()))
    scaled = values.join(cuts, ["_of", "_cut"]).withColumn("_scaled", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_c").over(up)))
    back = Window.partitionBy("_of").orderBy(F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = scaled.groupBy("_of", "_cut").agg(F.min("_scaled").alias("_least")).select("_of", "_cut", F.min("_least").over(back).alias("_later"))
    adjusted = scaled.withColumn("_own", F.min("_scaled").over(down)).join(later, ["_of", "_cut"]).select("_of", "_p", F.least("_own", "_later", F.lit(1.0)).alias("_q"))
    return part.join(adjusted, (of == F.col("_of")) & (F.col(p) == F.col("_p"))).select(*(F.col(f"`{c}`") for c in part.columns if c != q), F.col("_q").alias(q))


def anova(sample: DataFrame, min_n: int = 30) -> DataFrame:
    """One-way analysis of variance over the states of each asset: (asset, f, df1, df2, p_value)."""
    return _f_of(valid_samples(sample, min_n), "r")


def brown_forsythe(sample: DataFrame, min_n: int = 30) -> DataFrame:
    """The same on absolute deviations from each state's median."""
    x = valid_samples(sample, min_n)
    med = x.groupBy("asset", "regime").agg(F.percentile("r", 0.5).alias("med"))
    return _f_of(x.join(med, ["asset", "regime"]).withColumn("z", F.abs(F.col("r") - F.col("med"))), "z")


def _f_of(x: DataFrame, c: str) -> DataFrame:
    g = x.groupBy("asset", "regime").agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("asset")) / F.sum("n").over(Window.partitionBy("asset"))
    g = g.withColumn("grand", grand)
    s = g.groupBy("asset").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.min("n").alias("min_group_n"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within")).filter("k >= 2")
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    out = s.select("asset", ratio(F.col("between") / df1, F.col("within") / df2).alias("statistic"), df1.alias("df1"), df2.alias("df2"), F.col("k").alias("regimes_tested"), "min_group_n")
    return out.withColumn("p_value", tails.f_sf("statistic", "df1", "df2"))


def welch(sample: DataFrame, min_n: int = 30) -> DataFrame:
    """Pairs of states of each asset: t for unequal variances, its degrees of freedom, and p."""
    g = valid_samples(sample, min_n).groupBy("asset", "regime").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_samp("r").alias("v"))
    a, b = (g.select("asset", *(F.col(c).alias(f"{c}{i}") for c in ("regime", "n", "m", "v"))) for i in (1, 2))
    p = a.join(b, "asset").filter("regime1 < regime2").withColumn("e1", F.col("v1") / F.col("n1")).withColumn("e2", F.col("v2") / F.col("n2"))
    t = ratio(F.col("m1") - F.col("m2"), F.sqrt(F.col("e1") + F.col("e2")))
    df = ratio((F.col("e1") + F.col("e2")) ** 2, F.col("e1") ** 2 / (F.col("n1") - 1) + F.col("e2") ** 2 / (F.col("n2") - 1))
    out = p.select("asset", "regime1", "regime2", t.alias("t"), df.alias("df"), "m1", "m2", F.sqrt("v1").alias("vol1"), F.sqrt("v2").alias("vol2"), "n1", "n2")
    return out.withColumn("p_value", tails.t_sf2("t", "df"))


def pair_brown_forsythe(sample: DataFrame, min_n: int = 30) -> DataFrame:
    x = valid_samples(sample, min_n)
    states = x.select("asset", "regime").distinct()
    two = states.withColumnRenamed("regime", "regime1").join(states.withColumnRenamed("regime", "regime2"), "asset").filter("regime1 < regime2").withColumn("pair", F.concat_ws("|", "asset", "regime1", "regime2"))
    both = two.select("pair", "asset", F.explode(F.array("regime1", "regime2")).alias("regime"))
    named = x.join(both, ["asset", "regime"]).select(F.col("pair").alias("asset"), "regime", "r")
    out = brown_forsythe(named, min_n)
    parts = F.split("asset", r"\|")
    return out.withColumn("regime1", parts[1].cast("int")).withColumn("regime2", parts[2].cast("int")).withColumn("asset", parts[0])


def kruskal(sample: DataFrame, min_n: int = 50) -> DataFrame:
    """Tie-corrected rank statistic over the states of each asset: (asset, h, df, p_value)."""
    x = valid_samples(sample, min_n).withColumn("rank", mid_rank("r", ("asset",)))
    n = x.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("regime").alias("k"))
    ties = x.groupBy("asset", "r").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("asset").agg(F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"))
    sums = x.groupBy("asset", "regime").agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("g")).groupBy("asset").agg(F.sum(F.col("s") ** 2 / F.col("g")).alias("q"))
    j = n.join(ties, "asset").join(sums, "asset").filter("k >= 2")
    m = F.col("n").cast("double")
    h = ratio(12 / (m * (m + 1)) * F.col("q") - 3 * (m + 1), 1 - F.col("ties") / (m**3 - m))
    return j.select("asset", h.alias("statistic"), (F.col("k") - 1).alias("df")).withColumn("p_value", tails.chi2_sf("statistic", "df"))


def kolmogorov(sample: DataFrame, min_n: int = 50, exact: int = 10_000) -> DataFrame:
    """Greatest difference of the distribution functions of two states of an asset.

    p is exact while neither state has more than ``exact`` days (0 for the limit law alone), and takes the pooled sample
    to have no ties.
    """
    x = valid_samples(sample, min_n)
    sizes = x.groupBy("asset", "regime").agg(F.count(F.lit(1)).alias("n"))
    two = sizes.select("asset", F.col("regime").alias("regime1"), F.col("n").alias("n1")).join(sizes.select("asset", F.col("regime").alias("regime2"), F.col("n").alias("n2")), "asset").filter("regime1 < regime2")
    at = x.join(two, "asset").filter("regime = regime1 OR regime = regime2").groupBy("asset", "regime1", "regime2", "n1", "n2", "r").agg(F.count_if(F.col("regime") == F.col("regime1")).alias("c1"), F.count_if(F.col("regime") == F.col("regime2")).alias("c2"))
    w = Window.partitionBy("asset", "regime1", "regime2").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    gap = at.withColumn("d", F.abs(F.sum("c1").over(w) / F.col("n1") - F.sum("c2").over(w) / F.col("n2")))
    out = gap.groupBy("asset", "regime1", "regime2", "n1", "n2").agg(F.max("d").alias("statistic"))
    return out.withColumn("p_value", tails.ks_exact("statistic", "n1", "n2", exact) if exact else tails.ks_sf("statistic", "n1", "n2"))


def jarque_bera(returns: DataFrame) -> DataFrame:
    """Normality by skewness and kurtosis of each asset, with bias-adjusted moments beside it."""
    g = returns.groupBy("asset").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    n = F.col("n")
    out = g.withColumn("statistic", n / 6.0 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)).withColumn("df", F.lit(2))
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3)
    return out.select("asset", "statistic", "df", "mean", "std", skew.alias("skew"), kurt.alias("kurtosis")).withColumn("p_value", tails.chi2_sf("statistic", "df")).drop("df")


def dagostino(returns: DataFrame) -> DataFrame:
    """Normality by the transformed skewness and kurtosis of each asset: (asset, n, z_skew, z_kurtosis, statistic, p_value).

    Null below 8 days and for a constant asset.
    """
    g = returns.groupBy("asset").agg(F.count("r").cast("double").alias("n"), F.skewness("r").alias("g1"), (F.kurtosis("r") + 3).alias("b2"))
    g = g.filter((F.col("n") >= 8) & F.col("g1").isNotNull() & ~F.isnan("g1"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    w2 = F.sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1
    g = g.withColumns({"w2": w2, "y": y / F.sqrt(2 / (w2 - 1))})
    z_skew = F.log(F.col("y") + F.sqrt(F.col("y") ** 2 + 1)) / F.sqrt(0.5 * F.log("w2"))
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    g = g.withColumns({"z_skew": z_skew, "a": a, "down": 1 + x * F.sqrt(2 / (a - 4))})
    part = F.signum("down") * F.pow((1 - 2 / F.col("a")) / F.abs("down"), F.lit(1 / 3))
    z_kurtosis = (1 - 2 / (9 * F.col("a")) - part) / F.sqrt(2 / (9 * F.col("a")))
    out = g.withColumn("z_kurtosis", z_kurtosis).withColumn("statistic", F.col("z_skew") ** 2 + F.col("z_kurtosis") ** 2)
    return out.select("asset", n.cast("long").alias("n"), "z_skew", "z_kurtosis", "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


# Royston's polynomials (Applied Statistics, algorithm R 94), coefficients by rising power.
_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SD = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_MEAN, _SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _polynomial(coefficients: tuple[float, ...], x):
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def shapiro_wilk(returns: DataFrame) -> DataFrame:
    """Normality of each asset by the regression of ordered values on normal scores: (asset, n, statistic, p_value).

    Scores and weights follow the ranks, so values are ordered once, by a window within each asset. p is that of Royston's
    approximation, made for 3 to 5,000 days; fewer days, or a constant asset, have no row.
    """
    w = Window.partitionBy("asset")
    x = returns.filter(F.col("r").isNotNull()).select("asset", "r", F.row_number().over(w.orderBy("r")).alias("i"), F.count(F.lit(1)).over(w).cast("double").alias("n"))
    x = x.filter("n >= 3").withColumn("place", (F.col("i") - 0.375) / (F.col("n") + 0.25)).withColumn("m", tails.normal_quantile("place"))
    n = F.col("n")
    sums = x.groupBy("asset").agg(F.max("n").alias("n"), F.sum(F.col("m") ** 2).alias("mm"), F.max("m").alias("m1"), F.max(F.when(F.col("i") == n - 1, F.col("m"))).alias("m2"), (F.var_pop("r") * F.max("n")).alias("ss"))
    root, short = 1 / F.sqrt(n), 1 / F.sqrt("mm")
    last = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(_polynomial(_LAST, root) + F.col("m1") * short)
    sums = sums.filter("ss > 0").withColumn("a1", last).withColumn("a2", F.when(n > 5, _polynomial(_LAST_BUT_ONE, root) + F.col("m2") * short))
    two = F.sqrt((F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2))
    one = F.sqrt((F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2))
    sums = sums.withColumn("scale", F.when(n > 5, two).when(n > 3, one))
    from_end = F.least(F.col("i"), n + 1 - F.col("i"))
    weight = F.when(from_end == 1, F.signum("m") * F.col("a1")).when((from_end == 2) & (n > 5), F.signum("m") * F.col("a2")).otherwise(F.coalesce(F.col("m") / F.col("scale"), F.lit(0.0)))
    both = x.select("asset", "r", "i", "m").join(sums, "asset").groupBy("asset").agg(F.max("n").alias("n"), F.sum(weight * F.col("r")).alias("b"), F.max("ss").alias("ss"))
    both = both.withColumn("statistic", F.least(F.col("b") ** 2 / F.col("ss"), F.lit(1.0)))
    y, lx = F.log(1 - F.col("statistic")), F.log(n)
    small = -F.log(_polynomial(_GAMMA, n) - y)
    z = F.when(n <= 11, (small - _polynomial(_SMALL_MEAN, n)) / F.exp(_polynomial(_SMALL_SD, n))).otherwise((y - _polynomial(_MEAN, lx)) / F.exp(_polynomial(_SD, lx)))
    three = F.greatest(6 / math.pi * (F.asin(F.sqrt("statistic")) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    out = both.withColumn("z", z).withColumn("tail", tails.normal_sf2("z"))
    upper = F.when(F.col("z") >= 0, F.col("tail") / 2).otherwise(1 - F.col("tail") / 2)
    p = F.when(n == 3, three).when((n <= 11) & (y >= _polynomial(_GAMMA, n)), F.lit(1e-99)).otherwise(upper)
    return out.select("asset", n.cast("long").alias("n"), "statistic", p.alias("p_value"))


def normality(returns: DataFrame, method: str = "jarque_bera") -> DataFrame:
    """(asset, statistic, p_value, mean, std, skew, kurtosis) by ``jarque_bera``, ``shapiro`` or ``dagostino``; assets that a
    test is not made for have null statistics."""
    moments = jarque_bera(returns)
    if method == "jarque_bera":
        return moments.select("asset", "statistic", "p_value", "mean", "std", "skew", "kurtosis")
    tests = {"shapiro": shapiro_wilk, "dagostino": dagostino}
    if method not in tests:
        raise ValueError(f"no such test of normality: {method}")
    return moments.select("asset", "mean", "std", "skew", "kurtosis").join(tests[method](returns).select("asset", "statistic", "p_value"), "asset", "left").select("asset", "statistic", "p_value", "mean", "std", "skew", "kurtosis")


def diebold_mariano(losses: DataFrame, h: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of loss differences (…, dt, d): mean, long-run variance with h - 1 autocovariances, statistic and normal p.

    Autocovariances use the means of their own sub-samples; where the variance is not positive the first term stands alone.
    """
    w = Window.partitionBy(*keep).orderBy("dt")
    x = losses.select(*keep, "dt", "d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, h)))
    terms = [F.covar_samp("d", f"l{k}").alias(f"g{k}") for k in range(1, h)]
    g = x.groupBy(*keep).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("g0"), *terms)
    long_run = F.col("g0")
    for k in range(1, h):
        long_run = long_run + 2 * F.col(f"g{k}")
    v = F.when(long_run > 0, long_run).otherwise(F.col("g0")) / F.col("n")
    out = g.select(*keep, "n", "mean_diff", ratio(F.col("mean_diff"), F.sqrt(v)).alias("statistic"))
    return out.withColumn("p_value", tails.normal_sf2("statistic"))


def auc(scores: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve of (…, p, z) from mid-ranks; null where there is one class."""
    r = scores.withColumn("rank", mid_rank("p", keep)).groupBy(*keep).agg(F.sum(F.when(F.col("z") == 1, F.col("rank"))).alias("s"), F.count_if(F.col("z") == 1).alias("n1"), F.count_if(F.col("z") == 0).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return r.select(*keep, "n1", "n0", ratio(F.col("s") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def starred(tests: DataFrame, p: str = "p_value") -> DataFrame:
    return benjamini_hochberg(tests, p).withColumn("stars", stars(F.col("q_value")))


def spearman_by_window(a: DataFrame, b: DataFrame, min_obs: int = 6) -> DataFrame:
    """Rank correlation of two long probability frames (w, dt, k, p) by window and state; null if one is constant."""
    j = a.select("w", "dt", "k", F.col("p").alias("x")).join(b.select("w", "dt", "k", F.col("p").alias("y")), ["w", "dt", "k"])
    j = j.withColumn("rx", mid_rank("x", ("w", "k"))).withColumn("ry", mid_rank("y", ("w", "k")))
    return j.groupBy("w", "k").agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_samp("rx", "ry"), F.stddev_samp("rx") * F.stddev_samp("ry")).alias("rho")).filter(F.col("n") >= min_obs)
