"""Queries on numeric kernels, which SQL cannot express: mixtures, autoregressions, programmes, bootstraps, tails."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arima, backtest, bootstrap, drift, forecast_eval, forecasting, inference, mixture, mixture_tables, panel, portfolios, regimes, studies
from .relational import path, returns, sample, states

#: The specifications of the main and the forecast fit, and the main one without a tie between windows.
MAIN = (mixture.HEADLINE, mixture.FORECAST)
GRID = (*MAIN, replace(mixture.HEADLINE, config_id="grand_mean", target="grand_mean", ewma_decay=None))


def _days(s: SparkSession, d: str) -> DataFrame:
    return panel.vectors(returns(s, d)).persist()


def _fits(s: SparkSession, d: str, configs=MAIN[:1]) -> tuple[DataFrame, DataFrame]:
    days = _days(s, d)
    return days, mixture.fit_rolling(days, configs).persist()


def _two(s: SparkSession, d: str) -> DataFrame:
    return states(s, d).select("dt", F.posexplode(F.array(1 - F.col("p_1"), "p_1")).alias("k", "p"))


def gmm_fit(s, d):
    return mixture.diagnostics(_fits(s, d, GRID)[1])


def bic_grid(s, d):
    return _fits(s, d, MAIN)[1].select("config_id", "w", F.explode("bic_grid").alias("k", "bic"))


def filtered_probabilities(s, d):
    days, fits = _fits(s, d, MAIN)
    return mixture.filtered_probabilities(days, fits)


def retrospective_probabilities(s, d):
    days, fits = _fits(s, d, MAIN)
    return regimes.retrospective(mixture.window_probabilities(days, fits))


def covariance_diagnostics(s, d):
    return mixture.covariance_diagnostics(_fits(s, d, MAIN)[1])


def mean_drift(s, d):
    return mixture.mean_drift(_fits(s, d, MAIN)[1])


def parameter_drift(s, d):
    return drift.parameter_drift(_fits(s, d, MAIN)[1], panel.assets_of(returns(s, d)))


def track_summary(s, d):
    return drift.track_summary(_fits(s, d, MAIN)[1])


def config_summary(s, d):
    return studies.config_summary(_fits(s, d, (*GRID, *mixture.ROBUSTNESS, *mixture.SHRINKAGE))[1])


def fitted_correlations(s, d):
    from ..sources.tables import correlations_long

    days, fits = _fits(s, d)
    return correlations_long(fits, panel.assets_of(returns(s, d)))


def one_sided_scorer(s, d):
    """The flow form of the one-sided scoring, run over the days as one available batch."""
    from ..streaming.scoring import score_days

    days, fits = _fits(s, d, MAIN[1:])
    last = fits.orderBy(F.col("w").desc()).limit(1)
    return score_days(days.select("dt", "x"), mixture.state_of(last.toPandas().iloc[0]))


def implied_moments(s, d):
    days, fits = _fits(s, d)
    return mixture.implied_moments(fits, panel.assets_of(returns(s, d)))


def pooled_fits(s, d):
    return mixture.pooled_fits(_fits(s, d)[1])


def tier_fits(s, d):
    """Fits of a growing universe of the price panel: two series, then one more at a time."""
    r = returns(s, d)
    names = panel.assets_of(r)
    return mixture.diagnostics(studies.run_tiers(r, names[:2], [*names[2:], names[0], "absent"], mixture.FORECAST))


def one_sided_contract(s, d):
    """Served probabilities that change if the days after a cut are missing, or are made up: none may."""
    days, fits = _fits(s, d, MAIN[1:])
    cut = days.agg(F.max("t")).first()[0] - 300
    early = F.col("t") < cut
    before = mixture.filtered_probabilities(days, fits).filter(early).select("t", "k", F.col("p").alias("a"))
    made_up = days.withColumn("x", F.when(early, F.col("x")).otherwise(F.transform("x", lambda v: 10 * v + 0.1)))

    def changed(other: DataFrame, case: str) -> DataFrame:
        after = mixture.filtered_probabilities(other, mixture.fit_rolling(other, MAIN[1:])).filter(early).select("t", "k", F.col("p").alias("b"))
        differs = F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-12, F.lit(True))
        return before.join(after, ["t", "k"], "full").agg(F.count_if(differs).alias("changed"), (F.count(F.lit(1)) > 0).alias("served")).select(F.lit(case).alias("case"), "changed", "served")

    return changed(days.filter(early), "truncated").unionByName(changed(made_up, "corrupted"))


def probability_sums(s, d):
    """Days of each configuration on which served or averaged probabilities do not add up to 1, or a state lies outside 0 to 1."""
    days, fits = _fits(s, d, MAIN)
    kinds = {"one_sided": mixture.filtered_probabilities(days, fits), "retrospective": regimes.retrospective(mixture.window_probabilities(days, fits))}
    out = [p.groupBy("config_id", "t").agg(F.sum("p").alias("s"), F.min("p").alias("a"), F.max("p").alias("b")).groupBy("config_id").agg(F.count_if((F.abs(F.col("s") - 1) > 1e-9) | (F.col("a") < 0) | (F.col("b") > 1 + 1e-12)).alias("bad")).select(F.lit(k).alias("kind"), "config_id", "bad") for k, p in kinds.items()]
    return out[0].unionByName(out[1])


def portfolio_conditions(s, d):
    """Optimised portfolios whose weights leave their bounds or do not add up to 1, or that the equal weights beat: none may."""
    r, labelled = returns(s, d), sample(s, d)
    found = portfolios.unconditional_portfolio(r, bounds=portfolios.LIVE).withColumn("k", F.lit(-1)).unionByName(portfolios.state_portfolios(labelled, bounds=portfolios.LIVE).withColumn("k", F.col("k").cast("int")), allowMissingColumns=True)
    even = portfolios.unconditional_portfolio(r, method="equal_weight").withColumn("k", F.lit(-1)).unionByName(portfolios.state_portfolios(labelled, method="equal_weight").withColumn("k", F.col("k").cast("int")), allowMissingColumns=True)
    base = even.groupBy("k").agg(F.max("sharpe_ratio").alias("least"))
    per = found.groupBy("k").agg(F.sum("w").alias("s"), F.min("w").alias("a"), F.max("w").alias("b"), F.max("sharpe_ratio").alias("sharpe"), F.bool_or("fallback").alias("fallback")).join(base, "k")
    bad = (F.abs(F.col("s") - 1) > 1e-6) | (F.col("a") < -1e-9) | (F.col("b") > portfolios.LIVE.high + 1e-6) | (F.col("sharpe") < F.col("least") - 1e-6) & ~F.col("fallback")
    return per.select("k", bad.cast("int").alias("bad"))


#: What the checks of conditions have to give, as SQL.
SQL = {
    "one_sided_contract": "SELECT unnest(['truncated', 'corrupted']) AS \"case\", 0 AS changed, true AS served",
    "probability_sums": "SELECT kind, config_id, 0 AS bad FROM (SELECT unnest(['one_sided', 'retrospective']) AS kind), (SELECT unnest(['headline', 'forecast']) AS config_id)",
    "portfolio_conditions": "SELECT unnest([-1, 0, 1, 2]) AS k, 0 AS bad",
}

QUERIES = {
    "gmm_fit": gmm_fit,
    "bic_grid": bic_grid,
    "filtered_probabilities": filtered_probabilities,
    "retrospective_probabilities": retrospective_probabilities,
    "covariance_diagnostics": covariance_diagnostics,
    "mean_drift": mean_drift,
    "parameter_drift": parameter_drift,
    "track_summary": track_summary,
    "config_summary": config_summary,
    "fitted_correlations": fitted_correlations,
    "one_sided_scorer": one_sided_scorer,
    "implied_moments": implied_moments,
    "pooled_fits": pooled_fits,
    "tier_fits": tier_fits,
    "mixture_starts": lambda s, d: mixture_tables.best_of_starts(mixture_tables.fit_starts(_days(s, d), (2, 3, 4), mixture.HEADLINE)).select("k", "start", "loglik", "bic", "n_iter", "weights", "selected"),
    "one_sided_contract": one_sided_contract,
    "probability_sums": probability_sums,
    "portfolio_conditions": portfolio_conditions,
    "ar_against_random_walk": lambda s, d: forecasting.against_random_walk(states(s, d))[1],
    "paper_comparison_fmt": lambda s, d: studies.paper_tables(sample(s, d))["paper_comparison_fmt"],
    "paper_omnibus_fmt": lambda s, d: studies.paper_text(studies.paper_omnibus(sample(s, d))),
    "risk_report": lambda s, d: portfolios.risk_report(returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net")))["drawdown_tests"],
    "ar_multihorizon": lambda s, d: forecasting.multi_horizon(states(s, d)),
    "ar_scores": lambda s, d: forecast_eval.scores(forecasting.multi_long(forecasting.multi_horizon(states(s, d))), ("horizon", "method")),
    "logit_fits": lambda s, d: forecasting.fit_logit(states(s, d)).unionByName(forecasting.fit_logit(states(s, d), 3)),
    "logit_forecast": lambda s, d: forecasting.logit_forecast(states(s, d), 21),
    "snail_trail_exact": lambda s, d: forecasting.snail_trail(states(s, d), exact=True),
    "arima_fits": lambda s, d: arima.fit_arima(states(s, d), ((1, 0, 0), (2, 0, 1), (1, 1, 0), (0, 1, 1), (1, 1, 1))),
    "arima_forecast": lambda s, d: arima.arima_forecast(states(s, d), (1, 1, 1), 21),
    "ar_exact_against_random_walk": lambda s, d: arima.against_random_walk(states(s, d))[1],
    "regime_aware_exact": lambda s, d: arima.regime_aware(states(s, d)),
    "compare_methods_exact": lambda s, d: arima.compare_methods(states(s, d)),
    "backtest_signals": lambda s, d: forecasting.backtest_signals(states(s, d)),
    "max_sharpe": lambda s, d: portfolios.unconditional_portfolio(returns(s, d), bounds=portfolios.LIVE),
    "state_portfolios": lambda s, d: portfolios.state_portfolios(sample(s, d)),
    "frontier": lambda s, d: portfolios.efficient_frontier(returns(s, d)),
    "backtest_unconditional": lambda s, d: portfolios.backtest_unconditional(returns(s, d)),
    "backtest_regimes": lambda s, d: portfolios.backtest_regimes(returns(s, d), _two(s, d), states(s, d).select("dt", "p_1")),
    "backtest_out_of_sample": lambda s, d: portfolios.backtest_out_of_sample(returns(s, d), _two(s, d), 1250),
    "bootstrap_quantiles": lambda s, d: bootstrap.quantile_equality(sample(s, d), b=1000),
    "bootstrap_corr": lambda s, d: bootstrap.correlation_differences(sample(s, d), 0, 2),
    "bootstrap_sharpe": lambda s, d: bootstrap.path_difference(returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net")), "A_F", "R_F", "sharpe"),
    "bootstrap_drawdown": lambda s, d: bootstrap.path_difference(returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net")), "A_F", "R_F", "drawdown"),
    "bootstrap_cvar": lambda s, d: bootstrap.path_difference(returns(s, d).select(F.col("asset").alias("strategy"), "dt", F.col("r").alias("net")), "A_F", "R_F", "cvar"),
    "anderson_darling": lambda s, d: bootstrap.anderson_darling(sample(s, d)),
}
