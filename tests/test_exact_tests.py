"""Exact p-values by listing all orders of a pooled sample, and tests of normality against published figures."""

import itertools
import math

import numpy as np
import pytest

from tidemark.functions import tails
from tidemark.operators import inference


def gap_of(order: tuple[int, ...], n1: int, n2: int) -> int:
    """The greatest difference of the distribution functions in an order of n1 noughts and n2 ones, times lcm."""
    unit = math.lcm(n1, n2)
    i = j = most = 0
    for x in order:
        i, j = i + (x == 0), j + (x == 1)
        most = max(most, abs(i * unit // n1 - j * unit // n2))
    return most


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 5), (3, 3), (4, 6), (5, 7), (6, 6), (2, 9), (7, 4)])
def test_kolmogorov_exact_counts_all_orders(n1, n2):
    gaps = []
    for ones in itertools.combinations(range(n1 + n2), n2):
        gaps.append(gap_of(tuple(int(k in ones) for k in range(n1 + n2)), n1, n2))
    for gap in range(math.lcm(n1, n2) + 2):
        assert np.isclose(tails.kolmogorov_exact(n1, n2, gap), np.mean([g >= gap for g in gaps]), rtol=1e-12, atol=1e-15)


def test_kolmogorov_exact_is_symmetric_and_nears_the_limit_law():
    assert np.isclose(tails.kolmogorov_exact(40, 60, 33), tails.kolmogorov_exact(60, 40, 33), rtol=1e-12)
    n, m = 1500, 1300
    unit = math.lcm(n, m)
    gap = round(0.05 * unit)
    assert abs(tails.kolmogorov_exact(n, m, gap) - float(tails.kolmogorov_sf(np.array([math.sqrt(n * m / (n + m)) * gap / unit]))[0])) < 0.004
    assert 0 < tails.kolmogorov_exact(n, m, unit // 2) < 1e-100  # far tails keep their digits


def frame(spark, samples):
    return spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v], "asset string, r double").repartition(3)


def test_kolmogorov_by_size(spark):
    rng = np.random.default_rng(3)
    rows = [("a", k, float(x)) for k, n in ((0, 60), (1, 75), (2, 60)) for x in rng.normal(k / 4, 1, n)]
    sample = spark.createDataFrame(rows, "asset string, regime int, r double")
    got = {(r["regime1"], r["regime2"]): r for r in inference.kolmogorov(sample).collect()}
    for (a, b), r in got.items():
        assert np.isclose(r["p_value"], tails.kolmogorov_exact(r["n1"], r["n2"], round(r["statistic"] * math.lcm(r["n1"], r["n2"]))), rtol=1e-12)
    limit = {(r["regime1"], r["regime2"]): r["p_value"] for r in inference.kolmogorov(sample, exact=70).collect()}
    assert limit[0, 2] == got[0, 2]["p_value"] and limit[0, 1] != got[0, 1]["p_value"] and abs(limit[0, 1] - got[0, 1]["p_value"]) < 0.05


#: Weights of eleven men (Shapiro and Wilk, 1965), whose W is published as 0.79 and by algorithm R 94 is 0.78881 with p 0.006704.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_shapiro_wilk_golden(spark):
    r = {x["asset"]: x for x in inference.shapiro_wilk(frame(spark, {"men": MEN, "three": [1, 2, 3.5], "flat": [1] * 9, "two": [1, 2]})).collect()}
    assert abs(r["men"]["statistic"] - 0.7888147) < 2e-6 and abs(r["men"]["p_value"] - 0.0067038) < 2e-6
    x = np.array([1, 2, 3.5])
    assert np.isclose(r["three"]["statistic"], (x[2] - x[0]) ** 2 / 2 / ((x - x.mean()) ** 2).sum()) and "flat" not in r and "two" not in r


def test_shapiro_wilk_falls_with_contamination_and_does_not_see_scale(spark):
    from statistics import NormalDist

    scores = [NormalDist().inv_cdf((i + 0.5) / 200) for i in range(200)]
    samples = {f"far {k:02d}": scores[:-3] + [3 + k] * 3 for k in range(0, 12, 3)}
    samples |= {"scaled": [5 - 7 * x for x in samples["far 03"]], "four": [1, 2, 3, 9], "six": [1, 2, 3, 4, 5, 6]}
    r = {x["asset"]: x for x in inference.shapiro_wilk(frame(spark, samples)).collect()}
    far = [r[f"far {k:02d}"] for k in range(0, 12, 3)]
    assert all(a["statistic"] > b["statistic"] and a["p_value"] > b["p_value"] for a, b in zip(far, far[1:])) and far[0]["p_value"] > 0.5
    assert np.isclose(r["scaled"]["statistic"], far[1]["statistic"], atol=1e-9) and r["six"]["p_value"] > 0.9 and 0 < r["four"]["p_value"] < 0.2


def test_p_of_normal_samples_is_even(spark):
    rng = np.random.default_rng(5)
    data = frame(spark, {f"{n} {k}": rng.normal(size=n) for n in (8, 25, 300) for k in range(120)})
    for test in (inference.shapiro_wilk, inference.dagostino):
        p = np.array([r["p_value"] for r in test(data).filter("n > 20").collect()])
        assert len(p) == 240 and abs(np.mean(p < 0.5) - 0.5) < 0.12 and 0.01 < np.mean(p < 0.1) < 0.19


def test_dagostino_golden_and_frames(spark):
    # The weights above; their published z of skewness (D'Agostino, 1970) and of kurtosis (Anscombe and Glynn, 1983).
    r = inference.dagostino(frame(spark, {"men": MEN, "flat": [1] * 9, "short": [1, 2, 4]})).collect()
    assert [x["asset"] for x in r] == ["men"]
    r = r[0]
    assert np.isclose(r["statistic"], r["z_skew"] ** 2 + r["z_kurtosis"] ** 2) and np.isclose(r["p_value"], math.exp(-r["statistic"] / 2))
    assert abs(r["z_skew"] - 2.7788580) < 1e-6 and abs(r["z_kurtosis"] - 2.3048235) < 1e-6 and abs(r["statistic"] - 13.0342631) < 1e-6
    back = inference.dagostino(frame(spark, {"men": [-x for x in MEN]})).first()
    assert np.isclose(back["z_skew"], -r["z_skew"]) and np.isclose(back["z_kurtosis"], r["z_kurtosis"])
    for method in ("jarque_bera", "shapiro", "dagostino"):
        rows = {x["asset"]: x for x in inference.normality(frame(spark, {"men": MEN, "short": [1, 2]}), method).collect()}
        assert rows["men"]["p_value"] < 0.05 and np.isclose(rows["men"]["std"], np.std(MEN, ddof=1)) and "short" in rows
    with pytest.raises(ValueError):
        inference.normality(frame(spark, {"men": MEN}), "other")
