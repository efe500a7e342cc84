"""Mixtures of tables of points: fits of windows too long for one task, and many starts side by side.

A round of the fit is an aggregation: each task turns its points into shares of the states and gives their sums, sums of
points and of products; these few numbers are added up and become the next parameters. No task sees more than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assignment import kmeans
from .mixture import Config, State, component_order, fit_em, from_labels, n_params, posterior


def _points(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(points: DataFrame, stats, width: int) -> np.ndarray:
    """Sums over all tasks of ``stats(x)``, a vector for each batch of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += stats(_points(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    rows = points.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # `width` rows
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def moments_of(points: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of points (x), in two passes so that large means cost no digits."""
    sums = _summed(points, lambda x: np.r_[len(x), x.sum(0)], 1 + d)
    n, mean = int(sums[0]), sums[1:] / max(sums[0], 1)
    scatter = _summed(points, lambda x: ((x - mean).T @ (x - mean)).ravel(), d * d).reshape(d, d)
    return n, mean, scatter / max(n - 1, 1)


def fit_em_table(points: DataFrame, start: State, cfg: Config) -> State:
    """As :func:`.mixture.fit_em` without its priors of an earlier window, on points (x array<double>) of any number; the
    shares of single points are not kept. Points with a null or odd entry are for the caller to leave out."""
    k, d = start.means.shape
    n, grand, spread = moments_of(points, d)
    s = State(start.means.copy(), start.covs.copy(), start.weights / start.weights.sum())
    nu0, lam0, last, ridge, history = d + cfg.nu_extra, cfg.lambda_scale * spread / k ** (2 / d), -np.inf, cfg.reg * np.eye(d), []
    for it in range(1, cfg.max_iter + 1):
        at = State(s.means, s.covs, s.weights)

        def stats(x: np.ndarray, at: State = at) -> np.ndarray:
            resp, level = posterior(x, at, cfg.reg)
            z = x - grand
            return np.r_[level.sum(), resp.sum(0), (resp.T @ z).ravel(), np.einsum("nk,ni,nj->kij", resp, z, z).ravel()]

        sums = _summed(points, stats, 1 + k + k * d + k * d * d)
        level, nk = float(sums[0] / n), sums[1 : 1 + k] + 1e-15
        first, second = sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
        history.append(level)
        means, covs = np.empty((k, d)), np.empty((k, d, d))
        for j in range(k):
            z = first[j] / nk[j]
            scatter = second[j] - nk[j] * np.outer(z, z)
            if not cfg.regularise:
                means[j], covs[j] = grand + z, scatter / nk[j] + ridge
            elif nk[j] < 1e-10:
                means[j], covs[j] = grand, lam0
            else:
                means[j] = grand + nk[j] * z / (nk[j] + cfg.kappa)
                covs[j] = (lam0 + scatter + cfg.kappa * nk[j] / (cfg.kappa + nk[j]) * np.outer(z, z)) / (nu0 + nk[j] + d + 2) + ridge
        w = np.maximum(nk + cfg.alpha - 1, 1e-15) if cfg.regularise else nk
        order = component_order(covs, w, cfg.order)
        s.means, s.covs, s.weights = means[order], covs[order], (w / w.sum())[order]
        s.loglik, s.n_iter = level, it
        if abs(level - last) < cfg.tol:
            s.converged = True
            break
        last = level
    s.history = tuple(history)
    return s


FITS = "k int, start int, loglik double, bic double, n_iter int, weights array<double>, means array<array<double>>, covs array<array<array<double>>>"


def fit_starts(days: DataFrame, ks: Sequence[int], cfg: Config, n_starts: int = 5, init: str = "kmeans", seed: int = 0) -> DataFrame:
    """A row and a task for each number of states and start: the fit of one window of days (t, x) from it.

    Starts are k-means with a seed of their own, or points drawn at random. Numbers of states beyond the days have no row.
    """
    dealt = days.select("t", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("start")) for k in ks for i in range(n_starts)))).alias("s")).select("t", "x", "s.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, i = key
        x = np.array(pdf.sort_values("t")["x"].tolist(), float)
        if k > len(x):
            return pd.DataFrame([], columns=[c.split()[0] for c in FITS.split(", ")])
        if init == "kmeans":
            start = from_labels(x, kmeans(x, k, seed + i), k, cfg.reg)
        else:
            at = np.random.default_rng(seed + i).choice(len(x), k, replace=False)
            start = State(x[at], np.repeat((np.cov(x, rowvar=False) + cfg.reg * np.eye(x.shape[1]))[None], k, 0), np.full(k, 1 / k))
        f = fit_em(x, start, cfg)
        bic = 2 * f.loglik * len(x) - n_params(k, x.shape[1]) * np.log(len(x))
        return pd.DataFrame([(k, i, f.loglik, bic, f.n_iter, f.weights.tolist(), f.means.tolist(), f.covs.tolist())], columns=[c.split()[0] for c in FITS.split(", ")])

    return dealt.groupBy("k", "start").applyInPandas(run, FITS)


def best_of_starts(fits: DataFrame) -> DataFrame:
    """A row for each number of states, the start of greatest likelihood (of equal ones the first); ``selected`` marks the
    greatest criterion (of equal ones the fewest states)."""
    one = fits.groupBy("k").agg(F.max_by(F.struct(*(c for c in fits.columns if c != "k")), F.struct("loglik", -F.col("start"))).alias("f")).select("k", "f.*")
    best = one.agg(F.max_by("k", F.struct("bic", -F.col("k"))).alias("best"))
    return one.join(F.broadcast(best), one["k"] == best["best"], "left").select(one["*"], F.col("best").isNotNull().alias("selected"))
