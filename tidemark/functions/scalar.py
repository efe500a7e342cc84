"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def logit(p: Column, eps: float = EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def inv_logit(y: Column) -> Column:
    return 1 / (1 + F.exp(-y))


def hard_label(p: Column) -> Column:
    """Place of the greatest probability in an array; of ties the first."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def high_label(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, 1).when(p.isNotNull(), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a, b)


def format_pct(x: Column, decimals: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.format_string(f"%.{decimals}f%%", x * 100))


def format_number(x: Column, decimals: int = 3, missing: str = "-") -> Column:
    return F.when(x.isNull() | F.isnan(x), missing).otherwise(F.format_string(f"%.{decimals}f", x))


def format_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def stars(q: Column) -> Column:
    """Three tiers on adjusted values: under .01, .05 and .10; else a dash."""
    return F.when(q < 0.01, "***").when(q < 0.05, "**").when(q < 0.10, "*").otherwise("-")


def kappa_from_prior_weight(p: Column | float, n: float = 568.0) -> Column:
    p = p if isinstance(p, Column) else F.lit(p)
    return F.try_divide(n * p, 1 - p)


def num_params(model: Column, k: Column, d: Column) -> Column:
    """Free parameters of a mixture of k Gaussians in d dimensions, for the ten covariance families.

    Weights and means have k - 1 and k d; then volume, shape and orientation, each shared (E), own (V) or none (I).
    """
    full, turn = d * (d + 1) / 2, d * (d - 1) / 2
    cov = (
        F.when(model == "EII", F.lit(1.0)).when(model == "VII", k).when(model == "EEI", d).when(model == "VEI", k + d - 1).when(model == "EVI", 1 + k * (d - 1))
        .when(model == "VVI", k * d).when(model == "EEE", full).when(model == "EEV", d + k * turn).when(model == "VEV", k + d - 1 + k * turn).when(model == "VVV", k * full)
    )
    return (k - 1 + k * d + cov).cast("double")
