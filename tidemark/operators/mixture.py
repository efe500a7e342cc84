"""Prior-regularised Gaussian mixtures on rolling windows.

A configuration's windows form one ordered fold: each window's prior and start come from the window before. The
fold is one grouped task per configuration, and configurations (prior strengths, asset sets, window grids) run in
parallel. Windows between which nothing passes (grand-mean prior, no smoothing, no decay) start anew in that task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import kmeans, match, ward
from .regimes import one_sided_serving

FITS = (
    "config_id string, w int, s long, e long, end_dt date, K int, means array<array<double>>, covs array<array<array<double>>>, weights array<double>, "
    "n_iter int, converged boolean, loglik double, bic double, bic_grid map<int,double>, neff array<double>, neff_min double, ages array<int>, max_age int, prior_coverage double, resp array<array<double>>"
)


@dataclass(frozen=True)
class Config:
    """One specification. The defaults are the headline ones."""

    config_id: str = "headline"
    k_candidates: tuple[int, ...] = (2, 3, 4, 5, 6, 7)
    window: int = 1250
    step: int = 63
    scale: str = "none"
    max_iter: int = 200
    tol: float = 1e-4
    reg: float = 1e-6
    regularise: bool = True
    target: str = "previous_epoch"
    kappa: float = 63.1
    kappa_age_scale: bool = False
    nu_extra: float = 2
    lambda_scale: float = 1.0
    alpha: float = 0.5
    ewma_decay: float | None = 0.97
    init_decay: float | None = None
    order: str = "trace"
    partial: bool = False
    assets: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.scale not in ("none", "rolling", "expanding") or self.target not in ("previous_epoch", "grand_mean") or self.order not in ("trace", "det", "weight", "none"):
            raise ValueError("unknown scale, target or order")

    @property
    def independent(self) -> bool:
        """Whether windows do not need each other."""
        return self.target == "grand_mean" and self.ewma_decay is None and self.init_decay is None and not self.kappa_age_scale


HEADLINE = Config()
FORECAST = replace(HEADLINE, config_id="forecast", k_candidates=(2,))
ROBUSTNESS = tuple(replace(HEADLINE, config_id=f"{w}_{s}", window=w, step=s) for w, s in ((1000, 63), (1250, 21), (1250, 63), (1250, 126), (1500, 63)))
KAPPAS = (0.01, 29.9, 63.1, 100.2, 189.3, 568.0)
SHRINKAGE = tuple(replace(HEADLINE, config_id=f"{m}_{k}", target="grand_mean" if m == "grand_mean" else "previous_epoch", kappa_age_scale=m == "age_scaled", kappa=k) for m in ("grand_mean", "previous_epoch", "age_scaled") for k in KAPPAS)


class NotImplementedCovariance(ValueError):
    """Only the unconstrained family (VVV) can be fitted."""


def covariance_family(name: str) -> str:
    if name != "VVV":
        raise NotImplementedCovariance(name)
    return name


@dataclass
class State:
    """Parameters of a mixture, and of its fit."""

    means: np.ndarray
    covs: np.ndarray
    weights: np.ndarray
    resp: np.ndarray | None = None
    loglik: float = -np.inf
    n_iter: int = 0
    converged: bool = False
    ages: np.ndarray | None = None
    history: tuple[float, ...] = ()


def log_joint(x: np.ndarray, s: State, reg: float) -> np.ndarray:
    """log weight + log density of each row under each component; the ridge is added to the covariances here too."""
    n, d = x.shape
    out = np.empty((n, len(s.weights)))
    for k, (m, c) in enumerate(zip(s.means, s.covs)):
        c = c + reg * np.eye(d)
        sign, logdet = np.linalg.slogdet(c)
        if sign <= 0:
            raise np.linalg.LinAlgError("a covariance is not positive definite")
        z = x - m
        out[:, k] = -0.5 * (np.einsum("ij,ij->i", z, np.linalg.solve(c, z.T).T) + d * np.log(2 * np.pi) + logdet) + np.log(s.weights[k] + 1e-15)
    return out


def posterior(x: np.ndarray, s: State, reg: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, log density) of each row."""
    l = log_joint(x, s, reg)
    top = l.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(l - top).sum(1))
    return np.exp(l - total[:, None]), total


def fit_em(x: np.ndarray, start: State, cfg: Config, mu_prior: np.ndarray | None = None, kappa: np.ndarray | float | None = None) -> State:
    """Maximum a posteriori fit. Responsibilities and likelihood are those before the last update of parameters."""
    n, d = x.shape
    k = len(start.weights)
    s = State(start.means.copy(), start.covs.copy(), start.weights / start.weights.sum(), ages=None if start.ages is None else start.ages.copy())
    grand, spread = x.mean(0), np.atleast_2d(np.cov(x, rowvar=False))
    mu0 = np.tile(grand, (k, 1)) if mu_prior is None else np.where(np.isnan(mu_prior).any(1, keepdims=True), grand, mu_prior)
    kap = np.broadcast_to(np.asarray(cfg.kappa if kappa is None else kappa, float), (k,)).copy()
    nu0, lam0 = d + cfg.nu_extra, cfg.lambda_scale * spread / k ** (2 / d)
    alpha = np.broadcast_to(np.asarray(cfg.alpha, float), (k,))
    if (alpha <= 0).any():
        raise ValueError("Dirichlet parameters must be positive")
    last, ridge, history = -np.inf, cfg.reg * np.eye(d), []
    for it in range(1, cfg.max_iter + 1):
        resp, dens = posterior(x, s, cfg.reg)
        level = float(dens.mean())
        history.append(level)
        nk = resp.sum(0) + 1e-15
        means, covs = np.empty_like(s.means), np.empty_like(s.covs)
        if cfg.regularise:
            w = np.maximum(nk + alpha - 1, 1e-15) / (nk.sum() + (alpha - 1).sum())
        else:
            w = nk / n
        for j in range(k):
            ybar = resp[:, j] @ x / nk[j]
            z = x - ybar
            scatter = (resp[:, j, None] * z).T @ z
            if not cfg.regularise:
                means[j], covs[j] = ybar, scatter / nk[j] + ridge
            elif nk[j] < 1e-10:
                means[j], covs[j] = mu0[j], lam0
            else:
                gap = ybar - mu0[j]
                means[j] = (nk[j] * ybar + kap[j] * mu0[j]) / (nk[j] + kap[j])
                covs[j] = (lam0 + scatter + kap[j] * nk[j] / (kap[j] + nk[j]) * np.outer(gap, gap)) / (nu0 + nk[j] + d + 2) + ridge
        order = component_order(covs, w, cfg.order)
        s.means, s.covs, s.weights, resp, mu0, kap = means[order], covs[order], (w / w.sum())[order], resp[:, order], mu0[order], kap[order]
        if s.ages is not None:
            s.ages = s.ages[order]
        s.resp, s.loglik, s.n_iter = resp, level, it
        if abs(level - last) < cfg.tol:
            s.converged = True
            break
        last = level
    s.history = tuple(history)
    return s


def component_order(covs: np.ndarray, weights: np.ndarray, mode: str) -> np.ndarray:
    key = {"trace": lambda: np.trace(covs, axis1=1, axis2=2), "det": lambda: np.linalg.slogdet(covs)[1], "weight": lambda: -weights, "none": lambda: np.arange(len(weights))}[mode]()
    return np.argsort(key, kind="stable")


def from_labels(x: np.ndarray, labels: np.ndarray, k: int, reg: float = 1e-6) -> State:
    """Means, covariances and shares of clusters; a cluster of under two rows has the whole sample's."""
    d = x.shape[1]
    means, covs, weights = np.empty((k, d)), np.empty((k, d, d)), np.empty(k)
    for j in range(k):
        mine = x[labels == j]
        few = len(mine) < 2
        means[j], weights[j] = (x.mean(0), 1 / k) if few else (mine.mean(0), len(mine) / len(x))
        covs[j] = np.cov(x if few else mine, rowvar=False) + reg * np.eye(d)
    return State(means, covs, weights / weights.sum())


def n_params(k: int, d: int) -> int:
    return k - 1 + k * d + k * d * (d + 1) // 2


def select_by_bic(x: np.ndarray, ks: Sequence[int], cfg: Config, n_starts: int = 5, init: str = "kmeans", seed: int = 0) -> tuple[State, dict[int, float]]:
    """The best of several starts for each number of states, and the number with the greatest BIC (of equal ones the first)."""
    best, grid = None, {}
    for k in ks:
        fits = []
        for i in range(n_starts):
            if init == "kmeans":
                start = from_labels(x, kmeans(x, k, seed + i), k, cfg.reg)
            else:
                at = np.random.default_rng(seed + i).choice(len(x), k, replace=False)
                start = State(x[at], np.repeat((np.cov(x, rowvar=False) + cfg.reg * np.eye(x.shape[1]))[None], k, 0), np.full(k, 1 / k))
            fits.append(fit_em(x, start, cfg))
        one = max(fits, key=lambda f: f.loglik)
        grid[k] = 2 * one.loglik * len(x) - n_params(k, x.shape[1]) * np.log(len(x))
        if best is None or grid[k] > best[0]:
            best = grid[k], one
    return best[1], grid


class Fold:
    """What passes from one window to the next."""

    def __init__(self, cfg: Config):
        self.cfg, self.previous, self.smooth, self.by_k = cfg, None, {}, {}

    def step(self, x: np.ndarray) -> tuple[State, dict[int, float], float]:
        """(selected fit, BIC of each number of states, share of states whose prior was matched)."""
        cfg, n, d = self.cfg, *x.shape
        top = max(cfg.k_candidates)
        tree = from_labels(x, ward(x, top), top)
        best = None
        grid: dict[int, float] = {}
        for k in sorted(cfg.k_candidates):
            start = State(tree.means[:k].copy(), tree.covs[:k].copy(), tree.weights[:k] / tree.weights[:k].sum())
            if cfg.ewma_decay is not None and k in self.smooth:
                self._blend(start, self.smooth[k], 0.5)
            if cfg.init_decay is not None and k in self.by_k:
                self._blend(start, self.by_k[k], cfg.init_decay)
            mu, kappa, coverage = None, cfg.kappa, 0.0
            ages = np.ones(k, np.int64)
            if self.previous is not None and cfg.target == "previous_epoch":
                mu = np.full((k, d), np.nan)
                gaps = np.linalg.norm(start.means[:, None] - self.previous.means[None], axis=2)
                for a, b in match(gaps):
                    mu[a] = self.previous.means[b]
                    ages[a] = self.previous.ages[b] + 1
                    coverage += 1 / k
                if cfg.kappa_age_scale:
                    kappa = cfg.kappa * ages
            start.ages = ages
            f = fit_em(x, start, cfg, mu, kappa)
            grid[k] = 2 * n * f.loglik - n_params(k, d) * np.log(n)
            if best is None or grid[k] > best[0]:
                best = grid[k], f, coverage
        self._keep(best[1])
        return best[1], grid, best[2]

    @staticmethod
    def _blend(start: State, old: State, share: float) -> None:
        start.means = share * old.means + (1 - share) * start.means
        start.covs = share * old.covs + (1 - share) * start.covs
        w = share * old.weights + (1 - share) * start.weights
        start.weights = w / w.sum()

    def _keep(self, f: State) -> None:
        k, lam = len(f.weights), self.cfg.ewma_decay
        if lam is not None:
            old = self.smooth.get(k)
            new = State(f.means.copy(), f.covs.copy(), f.weights.copy())
            if old is not None:
                self._blend(new, old, lam)
            self.smooth[k] = new
        self.by_k[k] = f
        self.previous = f


def window_bounds(total: int, size: int, step: int, partial: bool = False) -> list[tuple[int, int]]:
    """(first, last + 1) of each window."""
    return [(a, min(a + size, total)) for a in range(0, total if partial else total - size + 1, step)]


def scaled(x: np.ndarray, a: int, b: int, how: str) -> np.ndarray:
    if how == "none":
        return x[a:b]
    base = x[a:b] if how == "rolling" else x[:b]
    sd = base.std(0, ddof=1)
    return (x[a:b] - base.mean(0)) / np.where(sd == 0, 1, sd)


def _row(cfg: Config, w: int, a: int, b: int, dt, f: State, grid: dict[int, float], coverage: float, n: int) -> dict:
    neff = f.resp.sum(0)
    ages = np.ones(len(f.weights), np.int64) if f.ages is None else f.ages
    return {
        "config_id": cfg.config_id, "w": w, "s": a, "e": b - 1, "end_dt": dt, "K": len(f.weights), "means": f.means.tolist(), "covs": f.covs.tolist(), "weights": f.weights.tolist(), "n_iter": f.n_iter,
        "converged": f.converged, "loglik": f.loglik * n, "bic": grid[len(f.weights)], "bic_grid": grid, "neff": neff.tolist(), "neff_min": float(neff.min()), "ages": ages.tolist(), "max_age": int(ages.max()),
        "prior_coverage": coverage, "resp": f.resp.tolist(),
    }


def fit_rolling(days: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """Fits of every configuration on the vectors (t, dt, x, and names of x in ``assets`` where a configuration picks some).

    The panel of daily vectors goes to each configuration's task: it has a row per day. Panels shorter than a window
    give no fits.
    """
    by_id = {c.config_id: c for c in configs}
    names = "assets" in days.columns
    every = days.withColumn("config_id", F.explode(F.array(*map(F.lit, by_id))))
    columns = [c.split()[0] for c in FITS.replace("map<int,double>", "map").split(", ")]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cfg = by_id[pdf["config_id"].iloc[0]]
        pdf = pdf.sort_values("t")
        x = np.array(pdf["x"].tolist(), float)
        if cfg.assets and names:
            x = x[:, [list(pdf["assets"].iloc[0]).index(a) for a in cfg.assets]]
        state, rows = Fold(cfg), []
        for w, (a, b) in enumerate(window_bounds(len(x), cfg.window, cfg.step, cfg.partial)):
            xw = scaled(x, a, b, cfg.scale)
            if cfg.independent:
                state = Fold(cfg)
            f, grid, coverage = state.step(xw)
            rows.append(_row(cfg, w, a, b, pdf["dt"].iloc[b - 1], f, grid, coverage, len(xw)))
        return pd.DataFrame(rows, columns=columns)

    # A number of partitions that is asked for stays: the days are few, and adaptive plans would put all folds in one task.
    return every.repartition(len(by_id), "config_id").groupBy("config_id").applyInPandas(fold, FITS)


def state_of(row: pd.Series) -> State:
    return State(np.array([list(m) for m in row["means"]], float), np.array([[list(r) for r in c] for c in row["covs"]], float), np.array(row["weights"], float))


def filtered_probabilities(days: DataFrame, fits: DataFrame, reg: float = 1e-6, align: bool = False) -> DataFrame:
    """One-sided (config_id, t, dt, w, k, p): each day under its configuration's latest model whose window ended before it.

    ``align`` renames each model's components to the first model's, matched one model after the other.
    """
    served = one_sided_serving(days, fits.select("config_id", "w", "e"), ("config_id",)).join(days.select("t", "x"), "t")
    renamed = aligned_names(fits) if align else fits.select("config_id", "w", F.sequence(F.lit(0), F.col("K") - 1).alias("names"))
    models = fits.select("config_id", "w", "means", "covs", "weights").join(renamed, ["config_id", "w"]).select(F.col("config_id").alias("config"), F.col("w").alias("model"), "means", "covs", "weights", "names")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("config_id", "object"), ("t", "int64"), ("dt", "object"), ("w", "int32"), ("k", "int32"), ("p", "float64"))})
        r = right.iloc[0]
        p, _ = posterior(np.array(left["x"].tolist(), float), state_of(r), reg)
        k = p.shape[1]
        return pd.DataFrame({"config_id": r["config"], "t": np.repeat(left["t"].to_numpy(), k), "dt": np.repeat(left["dt"].to_numpy(), k), "w": r["model"], "k": np.tile(np.array(r["names"]), len(left)), "p": p.ravel()})

    return served.groupBy("config_id", "w").cogroup(models.groupBy("config", "model")).applyInPandas(score, "config_id string, t long, dt date, w int, k int, p double")


def aligned_names(fits: DataFrame) -> DataFrame:
    """(config_id, w, names): for each component of each window the slot it takes, by matching means along the windows."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ref, rows = None, []
        for _, r in pdf.sort_values("w").iterrows():
            m = np.array([list(x) for x in r["means"]], float)
            names = np.full(len(m), -1)
            if ref is None:
                names = np.arange(len(m))
            else:
                for a, b in match(np.linalg.norm(m[:, None] - ref[None], axis=2)):
                    if b < len(m):
                        names[a] = b
                free = iter(sorted(set(range(len(m))) - set(names.tolist())))
                names = np.array([n if n >= 0 else next(free) for n in names])
            ref = m[np.argsort(names)]
            rows.append({"config_id": r["config_id"], "w": r["w"], "names": names.tolist()})
        return pd.DataFrame(rows)

    return fits.select("config_id", "w", "means").groupBy("config_id").applyInPandas(walk, "config_id string, w int, names array<int>")


def window_probabilities(days: DataFrame, fits: DataFrame) -> DataFrame:
    """(config_id, w, t, dt, k, p): the responsibilities of every window, before the last update of its parameters."""
    r = fits.select("config_id", "w", "s", F.posexplode("resp").alias("i", "row")).select("config_id", "w", (F.col("s") + F.col("i")).alias("t"), F.posexplode("row").alias("k", "p"))
    return r.join(days.select("t", "dt"), "t").select("config_id", "w", "t", "dt", "k", "p")


def implied_moments(fits: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(config_id, w, end_dt, K, regime, asset, mean, vol, weight): what the models imply, by state and asset.

    ``weight`` is the state's mean responsibility over the window's days.
    """
    names = F.array(*map(F.lit, assets))
    parts = fits.select("config_id", "w", "end_dt", "K", (F.col("e") - F.col("s") + 1).alias("n"), F.posexplode(F.arrays_zip("means", "covs", "neff")).alias("regime", "x"))
    each = parts.select("config_id", "w", "end_dt", "K", "regime", (F.col("x.neff") / F.col("n")).alias("weight"), F.col("x.covs").alias("c"), F.posexplode("x.means").alias("i", "mean"))
    return each.select("config_id", "w", "end_dt", "K", "regime", F.get(names, F.col("i")).alias("asset"), "mean", F.sqrt(F.get(F.get("c", F.col("i")), F.col("i"))).alias("vol"), "weight")


def pooled_fits(fits: DataFrame) -> DataFrame:
    """(config_id, k, i, j, mean_i, cov, long_run): means, covariances and long-run shares of the last window's states,
    averaged over all windows with equal weight; windows that lack a state count too."""
    each = Window.partitionBy("config_id")
    own = fits.withColumn("last", F.max_by("K", "w").over(each)).withColumn("n", F.count(F.lit(1)).over(each))
    states = own.select("config_id", "last", "n", F.posexplode(F.arrays_zip("means", "covs", "weights")).alias("k", "x")).filter("k < last")
    cells = states.select("config_id", "n", "k", "x.weights", "x.means", F.posexplode("x.covs").alias("i", "row")).select("config_id", "n", "k", "i", "weights", F.get("means", F.col("i")).alias("mean"), F.posexplode("row").alias("j", "cov"))
    n = F.first("n")
    sums = cells.groupBy("config_id", "k", "i", "j").agg((F.sum("mean") / n).alias("mean_i"), (F.sum("cov") / n).alias("cov"), F.sum("weights").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("config_id", "i", "j"))
    return sums.select("config_id", "k", "i", "j", "mean_i", "cov", (F.col("weight") / total).alias("long_run"))


def covariance_diagnostics(fits: DataFrame) -> DataFrame:
    """Least eigenvalue, greatest condition number and near-singular count over all covariances of a configuration."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, covs in zip(pdf["config_id"], pdf["covs"]):
                for c in covs:
                    e = np.linalg.eigvalsh(np.array([list(r) for r in c], float))
                    rows.append((name, e[0], e[-1] / e[0] if e[0] > 0 else np.inf))
            yield pd.DataFrame(rows, columns=["config_id", "least", "condition"])

    e = fits.select("config_id", "covs").mapInPandas(run, "config_id string, least double, condition double")
    return e.groupBy("config_id").agg(F.min("least").alias("min_eigenvalue"), F.max("condition").alias("max_condition_number"), F.count_if(F.col("least") < 1e-8).alias("near_singular_count"))


def mean_drift(fits: DataFrame) -> DataFrame:
    """(config_id, mean_drift): mean distance of matched component means of a configuration's neighbouring windows."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gaps, last = [], None
        for m in pdf.sort_values("w")["means"]:
            m = np.array([list(x) for x in m], float)
            if last is not None:
                d = np.linalg.norm(m[:, None] - last[None], axis=2)
                gaps.append(np.mean([d[a, b] for a, b in match(d)]))
            last = m
        return pd.DataFrame({"config_id": [pdf["config_id"].iloc[0]], "mean_drift": [float(np.mean(gaps)) if gaps else None]})

    return fits.select("config_id", "w", "means").groupBy("config_id").applyInPandas(walk, "config_id string, mean_drift double")


def diagnostics(fits: DataFrame) -> DataFrame:
    """Series behind the diagnostic charts: BIC, likelihood, iterations, K, effective sizes and coverage by window."""
    return fits.select("config_id", "w", "end_dt", "K", "bic", "loglik", "n_iter", "converged", "neff_min", "max_age", "prior_coverage")


def describe(cfg: Config) -> dict:
    return asdict(cfg)
