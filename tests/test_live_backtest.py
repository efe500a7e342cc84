"""The live state-aware path against a loop over days, with a signal that starts early, late, and with gaps."""

import datetime

import numpy as np
import pytest

from tidemark.functions import quadratic
from tidemark.operators import portfolios
from tidemark.operators.backtest import ANN_LIVE

N, ASSETS = 420, ["a0", "a1", "a2"]
START = datetime.date(2015, 1, 1)
DAYS = [START + datetime.timedelta(days=i) for i in range(N)]


def made_up():
    rng = np.random.default_rng(4)
    r = rng.normal(0.0004, 0.01, (N, 3)) * [1.0, 0.5, 1.5]
    p = 1 / (1 + np.exp(-np.cumsum(rng.normal(0, 0.4, N)) * 0.5))
    return r, p


def looped(r, p, signal_days, min_train, recompute, cost=0.0005):
    """(day, gross, turnover) and the days that recompute; all state is kept in plain variables."""
    months = {}
    for d in signal_days:
        months[DAYS[d].year, DAYS[d].month] = d
    ends, even = set(months.values()), np.full(3, 1 / 3)
    w, states, last, out, redone = even, [even, even], 0, [], []
    for t, d in enumerate(signal_days):
        grown = w * np.exp(r[d])
        gross, turnover = np.log(grown.sum() / w.sum()), 0.0
        w = grown / grown.sum()
        if d in ends and d >= min_train:
            if t - last >= recompute or t == 0:
                last, states = t, []
                redone.append(d)
                for share in (1 - p[: d + 1], p[: d + 1]):
                    total = share.sum()
                    mu = share @ r[: d + 1] / total
                    x = r[: d + 1] - mu
                    states.append(even if total < 10 else quadratic.live_max_sharpe(mu * ANN_LIVE, (x * share[:, None]).T @ x / total * ANN_LIVE))
            target = (1 - p[d]) * states[0] + p[d] * states[1]
            target = target / target.sum()
            turnover = np.abs(target - w).sum() / 2
            w = target
        out.append((DAYS[d], gross, turnover, gross - cost * turnover))
    return out, redone


@pytest.mark.parametrize("case", ["early", "late", "late with gaps", "from a month's end"])
def test_path_is_that_of_the_loop(spark, case):
    r, p = made_up()
    first = {"early": 0, "late": 300, "late with gaps": 290, "from a month's end": 119}[case]  # 2015-04-30
    days = [d for d in range(first, N) if case != "late with gaps" or d % 7 and not 330 < d < 350]
    returns = spark.createDataFrame([(DAYS[i], a, float(r[i, k])) for i in range(N) for k, a in enumerate(ASSETS)], "dt date, asset string, r double").repartition(3)
    probs = spark.createDataFrame([(DAYS[i], k, float(x)) for i in range(N) for k, x in ((0, 1 - p[i]), (1, p[i]))], "dt date, k int, p double")
    signal = spark.createDataFrame([(DAYS[i], float(p[i])) for i in days] + [(DAYS[first], None)], "dt date, p_1 double")
    want, redone = looped(r, p, days, 100, 40)
    gate = portfolios.recompute_gate(portfolios.live_days(returns, signal), 100, 40).orderBy("dt").collect()
    assert [g["dt"] for g in gate if g["recomputed"]] == [DAYS[d] for d in redone] and len(redone) >= 2
    assert (gate[0]["portfolio_dt"] is None) == (gate[0]["dt"] != DAYS[redone[0]])
    got = sorted(portfolios.backtest_regimes(returns, probs, signal, 100, 40).collect(), key=lambda x: x["dt"])
    assert [x["dt"] for x in got] == [x[0] for x in want]
    for g, w in zip(got, want):
        assert np.allclose((g["gross"], g["turnover"], g["net"]), w[1:], atol=2e-6), (case, g, w)


def test_no_month_end_rebalances(spark):
    r, p = made_up()
    returns = spark.createDataFrame([(DAYS[i], a, float(r[i, k])) for i in range(50) for k, a in enumerate(ASSETS)], "dt date, asset string, r double")
    probs = spark.createDataFrame([(DAYS[i], 1, float(p[i])) for i in range(50)], "dt date, k int, p double")
    got = portfolios.backtest_regimes(returns, probs, probs.select("dt", "p").withColumnRenamed("p", "p_1"), 100).collect()
    assert len(got) == 50 and {x["turnover"] for x in got} == {0.0}
