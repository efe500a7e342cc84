"""Report tables and robustness studies over fits, probabilities and test results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import format_number, format_p, ratio, stars
from .inference import spearman_by_window


def display(df: DataFrame, names: Mapping[str, str], column: str = "asset", order: bool = False) -> DataFrame:
    """Display names, and (``order``) the place of each name in the mapping. Names that it lacks stay and come last."""
    keys = list(names)
    place = F.array_position(F.array(*map(F.lit, keys)), F.col(column))
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    out = df.withColumn("place", F.when(place > 0, place).otherwise(len(keys) + 1)) if order else df
    return out.withColumn(column, F.coalesce(F.try_element_at(label, F.col(column)), F.col(column)))


def moments_table(profiles: DataFrame, names: Mapping[str, str], ann: float = 248.48, digits: int | None = 4) -> DataFrame:
    """Annualised per cent by asset and state, of (asset, regime, mean, vol, es5, q25) per observation."""
    t = display(profiles, names, order=True)
    cells = {"mean_pct": F.col("mean") * ann * 100, "vol_pct": F.col("vol") * ann**0.5 * 100, "es5_pct": F.col("es5") * 100, "q25_pct": F.col("q25") * 100}
    return t.select("place", F.col("asset").alias("Asset"), "regime", *((x if digits is None else F.round(x, digits)).alias(c) for c, x in cells.items()))


def correlation_table(tests: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Formatted pairwise tests (asset_i, asset_j, rho_low, rho_high, diff, p_value, q_value), by p and then pair."""
    t = display(display(tests, names, "asset_i"), names, "asset_j")
    w = Window.orderBy("p_value", "asset_i", "asset_j")
    return t.select(
        F.row_number().over(w).alias("place"), F.concat_ws(" / ", "asset_i", "asset_j").alias("pair"), format_number(F.col("rho_low")).alias("rho_low"), format_number(F.col("rho_high")).alias("rho_high"),
        format_number(F.col("diff")).alias("diff"), format_p(F.col("p_value")).alias("p"), format_p(F.col("q_value")).alias("q"), stars(F.col("q_value")).alias("stars"),
    )


def breaking_points(tiers: DataFrame, k_match: float = 0.8, corr: float = 0.7, unstable: int = 2, neff: float = 50) -> DataFrame:
    """The tiers of :func:`tier_summary` that fail a threshold, with the reasons; the first tier has nothing to fail against."""
    reasons = F.concat_ws(
        ", ",
        F.when(F.col("K_match_rate") < k_match, F.concat(F.lit("K_match="), F.format_string("%.0f%%", F.bround(F.col("K_match_rate") * 100, 0)))),
        F.when(F.col("prob_corr_min") < corr, F.concat(F.lit("low_corr="), F.format_string("%.2f", F.col("prob_corr_min")))),
        F.when(F.col("n_unstable_windows") > unstable, F.concat(F.lit("unstable_wins="), F.col("n_unstable_windows").cast("long").cast("string"))),
        F.when(F.col("Neff_min_mean") < neff, F.concat(F.lit("low_Neff="), F.format_string("%.0f", F.bround("Neff_min_mean", 0)))),
    )
    first = tiers.agg(F.min("tier").alias("first"))
    found = tiers.join(F.broadcast(first), F.col("tier") > F.col("first")).withColumn("reasons", reasons).filter("reasons <> ''")  # one row
    return found.select("tier", "added_asset", "n_assets", "reasons", "K_match_rate", "prob_corr_mean", "n_unstable_windows")


def tier_assets(core: Sequence[str], more: Sequence[str], there: Sequence[str]) -> list[tuple[int, tuple[str, ...]]]:
    """(tier, assets) of a growing universe: the core, then one asset more at a time. Assets that are not ``there`` or
    already in are skipped; the others keep the number of their place."""
    out = [(0, tuple(core))]
    for i, asset in enumerate(more, 1):
        if asset in there and asset not in out[-1][1]:
            out.append((i, (*out[-1][1], asset)))
    return out


def added_assets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Assets (asset) of the later universe that the earlier one lacks."""
    return after.select("asset").distinct().join(before.select("asset").distinct(), "asset", "left_anti")


def run_tiers(returns: DataFrame, core: Sequence[str], more: Sequence[str], config, exempt: Sequence[str] = ("cash",)) -> DataFrame:
    """Fits (as :func:`..mixture.fit_rolling`, config_id ``tier_<n>``) of a growing universe, each on its own synchronous days.

    A tier is one configuration and one task; its panel has a row per day.
    """
    from dataclasses import replace
    from functools import reduce

    from . import mixture, panel

    there = [r["asset"] for r in returns.select("asset").distinct().collect()]  # the universe's names
    tiers = tier_assets(core, more, there)
    fits = []
    for n, assets in tiers:
        mine = panel.complete_cases(returns.filter(F.col("asset").isin(*assets)), len(assets))
        fits.append(mixture.fit_rolling(panel.vectors(panel.synchronous(mine, exempt)), [replace(config, config_id=f"tier_{n}")]))
    return reduce(DataFrame.unionByName, fits)


def within_calendar(probs: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    """Rows (w, dt, …) up to 1.5 times ``window`` calendar days before the end of their window (w, end_dt)."""
    return probs.join(ends, "w").filter(F.datediff("end_dt", "dt").between(0, int(1.5 * window))).drop("end_dt")


def compare_tiers(before: DataFrame, after: DataFrame, k_before: DataFrame, k_after: DataFrame, corr: float = 0.7, min_days: int = 10, window: int | None = None) -> DataFrame:
    """Two tiers' window probabilities (w, dt, k, p) and selections (end_dt, w, k_selected): match rate, correlation, unstable windows.

    Windows meet by their last day. Without a common window the rate is null and n_common_windows is 0. A window's
    days are those within 1.5 times ``window`` calendar days up to its end (all of its own if ``window`` is None);
    windows with fewer than ``min_days`` common days have no correlation.
    """
    ks = k_before.select("end_dt", F.col("w").alias("w0"), F.col("k_selected").alias("k0")).join(k_after.select("end_dt", F.col("w").alias("w1"), F.col("k_selected").alias("k1")), "end_dt")
    same = ks.filter("k0 = k1")
    a = before.withColumnRenamed("w", "w0").join(same.select("w0", F.col("w1").alias("w")), "w0").drop("w0")
    b = after.join(same.select(F.col("w1").alias("w")), "w")
    if window is not None:
        ends = same.select(F.col("w1").alias("w"), "end_dt")
        a, b = within_calendar(a, ends, window), within_calendar(b, ends, window)
    rho = spearman_by_window(a, b, min_days).groupBy("w").agg(F.avg("rho").alias("rho"))
    j = ks.join(rho.withColumnRenamed("w", "w1"), "w1", "left").withColumn("unstable", (F.col("k0") != F.col("k1")) | F.coalesce(F.col("rho") < corr, F.lit(False)))
    return j.agg(F.count(F.lit(1)).alias("n_common_windows"), F.avg((F.col("k0") == F.col("k1")).cast("double")).alias("k_match_rate"), F.avg("rho").alias("mean_corr"), F.min("rho").alias("min_corr"), F.count_if("unstable").alias("unstable_windows"))


def tier_summary(tiers: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per tier of (tier, n_assets, added_asset, w, k_selected, bic, neff_min), with its comparison to the tier before.

    The most frequent K is the least of ties. A tier without a comparison has no rates and no unstable windows.
    """
    k = F.col("k_selected")
    s = tiers.groupBy("tier", "n_assets", "added_asset").agg(F.count(F.lit(1)).alias("n_windows"), F.mode(k, True).alias("K_mode"), F.min(k).alias("K_min"), F.max(k).alias("K_max"), F.avg("bic").alias("bic_mean"), F.avg("neff_min").alias("Neff_min_mean"))
    c = comparisons.select("tier", F.col("k_match_rate").alias("K_match_rate"), F.col("mean_corr").alias("prob_corr_mean"), F.col("min_corr").alias("prob_corr_min"), F.col("unstable_windows").alias("n_unstable_windows"))
    return s.join(c, "tier", "left").fillna(0, ["n_unstable_windows"])


def against_baseline(probs: DataFrame, baseline: DataFrame, min_days: int = 50) -> DataFrame:
    """Correlation and mean absolute difference of long probabilities (dt, k, p) on common days and states; null on too few."""
    j = probs.select("dt", "k", F.col("p").alias("a")).join(baseline.select("dt", "k", F.col("p").alias("b")), ["dt", "k"])
    g = j.agg(F.count_distinct("dt").alias("n"), F.covar_samp("a", "b").alias("c"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))
    ok = F.col("n") > min_days
    return g.select("n", F.when(ok, ratio(F.col("c"), F.col("sa") * F.col("sb"))).alias("corr"), F.when(ok, F.col("mae")).alias("mae"))


def config_summary(fits: DataFrame) -> DataFrame:
    """Per configuration of fits (config_id, w, K, bic, n_iter, neff_min, max_age): windows, stability of K, BIC, iterations."""
    prev = F.lag("K").over(Window.partitionBy("config_id").orderBy("w"))
    x = fits.withColumn("same", (F.col("K") == prev).cast("double"))
    return x.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("K").alias("k_mean"), F.mode("K", True).alias("k_mode"), F.avg("same").alias("k_stability"), F.avg("bic").alias("mean_bic"), F.avg("n_iter").alias("mean_iter"), F.min("neff_min").alias("min_neff"), F.max("max_age").alias("max_age"))


def with_total(rows: DataFrame, key: str, sums: Sequence[str], greatest: Sequence[str] = ()) -> DataFrame:
    """The rows and one named ``_summary_`` with sums and greatest values."""
    total = rows.agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in greatest)).withColumn(key, F.lit("_summary_"))
    return rows.unionByName(total, allowMissingColumns=True)


def paper_omnibus(sample: DataFrame, min_n: int = 50) -> DataFrame:
    """p-values of each asset's tests over all states. Nothing is bootstrapped, so no series goes to the driver."""
    from . import bootstrap, inference

    kw = inference.kruskal(sample, min_n).select("asset", F.col("p_value").alias("KW_p_value"))
    omnibus = inference.anova(sample).select("asset", F.col("p_value").alias("ANOVA_p_value")).join(inference.brown_forsythe(sample).select("asset", F.col("p_value").alias("BF_p_value")), "asset", "full")
    return omnibus.join(kw, "asset", "full").join(bootstrap.anderson_darling(sample, min_n).select("asset", F.col("p_approx").alias("AD_p_value_approx")), "asset", "full")


def paper_text(df: DataFrame) -> DataFrame:
    """A table of :func:`paper_tables` as text, with p-values by the names of their columns."""

    def cell(c: str):
        if c.endswith("_n"):
            return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return format_p(F.col(f"`{c}`")) if c.endswith(("_p", "_p_value", "_p_value_approx")) else format_number(F.col(f"`{c}`"), 4)

    return df.select("asset", *(cell(c).alias(c) for c in df.columns[1:]))


def paper_profiles(sample: DataFrame, low: int, high: int, alpha: float = 0.05, levels: Sequence[float] = (0.05, 0.10, 0.25), min_n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(profiles of two states by asset, the differences of the second from the first)."""
    from . import regimes

    tail = int(alpha * 100)
    columns = ["n", "mean", "vol", f"VaR{tail}", f"ES{tail}", *(f"Q{int(100 * q)}" for q in levels)]

    def profile(k: int) -> DataFrame:
        mine = sample.filter(F.col("regime") == k)
        m = regimes.moments(mine, min_n).select("asset", "n", "mean", "vol")
        tails = regimes.var_es(mine, (alpha,), min_n).select("asset", F.col("var").alias(f"VaR{tail}"), F.col("es").alias(f"ES{tail}"))
        q = mine.groupBy("asset").agg(F.percentile("r", list(levels)).alias("q")).select("asset", *(F.col("q")[i].alias(f"Q{int(100 * x)}") for i, x in enumerate(levels)))
        return m.join(tails, "asset", "left").join(q, "asset", "left").select("asset", *(F.col(c).alias(f"R{k}_{c}") for c in columns))

    profiles = profile(low).join(profile(high), "asset", "full")
    comparison = profiles.select("asset", *((F.col(f"R{high}_{c}") - F.col(f"R{low}_{c}")).alias(f"delta_{c}_R{high}-R{low}") for c in columns[1:]))
    return profiles, comparison


def paper_tables(sample: DataFrame, mode: str = "ordered", alpha: float = 0.05, levels: Sequence[float] = (0.05, 0.10, 0.25), min_n: int = 50, b: int = 1000) -> dict[str, DataFrame]:
    """Tables of two chosen states (see :func:`..regimes.select_pair`): meta_selected_pair, and paper_profiles,
    paper_comparison and paper_omnibus as numbers (``_raw``) and as text (``_fmt``). Assets that one state lacks stay."""
    from . import bootstrap, inference, regimes

    pair = regimes.select_pair(sample, mode, min_n)
    low, high = pair.first()
    profiles, comparison = paper_profiles(sample, low, high, alpha, levels, min_n)
    ks = inference.kolmogorov(sample, min_n).filter((F.col("regime1") == low) & (F.col("regime2") == high)).select("asset", F.col("statistic").alias("ks_stat"), F.col("p_value").alias("KS_p_value"))
    kw = inference.kruskal(sample, min_n).select("asset", F.col("p_value").alias("KW_p_value"))
    name = F.split("name", r"\|")
    equal = bootstrap.quantile_equality(sample, levels, b, min_n).select(name[0].alias("asset"), name[1].cast("int").alias("k1"), name[2].cast("int").alias("k2"), name[3].cast("double").alias("q"), "p_value").filter((F.col("k1") == low) & (F.col("k2") == high))
    equal = equal.groupBy("asset").agg(*(F.min(F.when(F.col("q") == x, F.col("p_value"))).alias(f"Q{int(100 * x)}_p") for x in levels))
    comparison = comparison.join(ks, "asset", "left").join(kw, "asset", "left").join(equal, "asset", "left")
    raw = {"paper_profiles": profiles, "paper_comparison": comparison, "paper_omnibus": paper_omnibus(sample, min_n)}
    meta = pair.select("regime_low", "regime_high", F.lit(alpha).alias("alpha_main"), F.lit(mode).alias("pair_mode"))
    return {"meta_selected_pair": meta} | {f"{k}_raw": v for k, v in raw.items()} | {f"{k}_fmt": paper_text(v) for k, v in raw.items()}


def all_tests(sample: DataFrame, mode: str = "ordered", min_n: int = 50, b: int = 1000) -> dict[str, DataFrame]:
    """Every table and test of labelled returns by name: what :func:`paper_tables` gives, and the tests it draws from."""
    from . import bootstrap, inference, regimes

    tests = {
        "moments": regimes.moments(sample, min_n), "quantiles": regimes.quantiles(sample, min_n=min_n), "var_es": regimes.var_es(sample, min_n=min_n), "anova_means": inference.anova(sample),
        "brown_forsythe_vols": inference.brown_forsythe(sample), "kruskal_wallis": inference.kruskal(sample, min_n), "ks_pairwise": inference.kolmogorov(sample, min_n), "anderson_darling": bootstrap.anderson_darling(sample, min_n),
        "quantile_equality": bootstrap.quantile_equality(sample, b=b, min_n=min_n),
    }
    return tests | paper_tables(sample, mode, min_n=min_n, b=b)
