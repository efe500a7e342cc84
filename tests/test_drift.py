"""Drift of parameters and scaling against loops over windows."""

import datetime as dt

import numpy as np
import pytest

from tidemark.functions.assignment import match
from tidemark.operators import drift

ASSETS = ("a", "b")


def fits_of(spark, configs):
    rows = []
    for name, means in configs.items():
        for w, m in enumerate(means):
            k = len(m)
            rows.append((name, w, dt.date(2020, 1, 1) + dt.timedelta(w), k, m, [[[w + 1.0 + i, 0.0], [0.0, w + 2.0 + i]] for i in range(k)], [1 / k] * k))
    return spark.createDataFrame(rows, "config_id string, w int, end_dt date, K int, means array<array<double>>, covs array<array<array<double>>>, weights array<double>").repartition(3)


def loop(means):
    """Names of the states of each window, one window after the other."""
    out, fresh, last, old = [], 0, [], None
    for m in means:
        m = np.array(m)
        names = [None] * len(m)
        if old is not None:
            for a, b in match(np.linalg.norm(m[:, None] - old[None], axis=2)):
                if a < len(m) and b < len(old):
                    names[a] = last[b]
        for i, n in enumerate(names):
            if n is None:
                names[i], fresh = fresh, fresh + 1
        out.append(names)
        last, old = names, m
    return out


@pytest.fixture(scope="module")
def configs():
    rng = np.random.default_rng(7)
    random = {f"r{i}": [rng.normal(0, 1, (int(k), 2)).tolist() for k in rng.integers(1, 6, 25)] for i in range(3)}
    planted = {"p": [[[0.0, 0.0], [9.0, 9.0]], [[9.1, 9.0], [0.1, 0.0], [50.0, 0.0]], [[0.0, 0.2]], [[0.0, 0.1], [50.0, 0.0]]]}
    return random | planted


def test_tracks_are_those_of_a_loop(spark, configs):
    got = {}
    for r in drift.state_tracks(fits_of(spark, configs)).collect():
        got[r.config_id, r.w, r.regime] = r.track
    want = {(c, w, k): n for c, m in configs.items() for w, names in enumerate(loop(m)) for k, n in enumerate(names)}
    assert got == want
    assert [got["p", 1, k] for k in range(3)] == [1, 0, 2] and got["p", 2, 0] == 0  # order changes, K grows, K shrinks
    assert [got["p", 3, k] for k in range(2)] == [0, 3]  # a state that comes back after a break is a new one


def test_summary(spark, configs):
    rows = {r.track: r for r in drift.track_summary(fits_of(spark, {"p": configs["p"]})).collect()}
    assert (rows[0].first_w, rows[0].last_w, rows[0].windows) == (0, 3, 4) and rows[0].max_gap == pytest.approx(np.hypot(0.1, 0.2))
    assert (rows[3].windows, rows[3].mean_gap) == (1, None)


def test_parameters(spark, configs):
    rows = drift.parameter_drift(fits_of(spark, configs), ASSETS).collect()
    assert len(rows) == sum(len(m) * max(map(len, m)) * 2 for m in configs.values())
    for r in rows:
        m = configs[r.config_id][r.w]
        if r.regime >= len(m):
            assert (r.track, r.mean, r.variance, r.weight) == (None, None, None, None)
        else:
            i = ASSETS.index(r.asset)
            assert (r.mean, r.variance, r.weight) == (m[r.regime][i], r.w + 1.0 + i + r.regime, 1 / len(m))
    assert drift.parameter_drift(fits_of(spark, configs).filter("w < 0"), ASSETS).count() == 0


def test_scaling(spark):
    rng = np.random.default_rng(1)
    x, start = rng.normal(0, 1, 40), dt.date(2020, 1, 1)
    days = [start + dt.timedelta(i) for i in range(40)]
    r = spark.createDataFrame([(d, a, float(v) if a == "a" else 0.5) for d, v in zip(days, x) for a in ASSETS], "dt date, asset string, r double").repartition(4)
    ends = spark.createDataFrame([(w, days[e]) for w, e in enumerate((0, 9, 39))], "w int, end_dt date")
    got = {(g.w, g.asset): (g["mean"], g.sd) for g in drift.scaling_drift(r, ends).collect()}
    assert got[1, "a"] == pytest.approx((x[:10].mean(), x[:10].std(ddof=1))) and got[2, "a"] == pytest.approx((x.mean(), x.std(ddof=1)))
    assert got[2, "b"] == (0.5, 1.0) and got[0, "a"] == (x[0], None)
