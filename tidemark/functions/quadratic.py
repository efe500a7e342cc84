"""Portfolio programmes: least variance, greatest Sharpe ratio, volatility targets, frontiers."""

from __future__ import annotations

import numpy as np


def minimise(cov: np.ndarray, mu: np.ndarray | None = None, target: float | None = None, low: float = 0.0, high: float = 1.0, linear: np.ndarray | None = None, tilt: float = 0.0) -> np.ndarray | None:
    """Weights of least w'Cw/2 - tilt w'linear with sum 1, bounds, and (``target``) w'mu = target; None if impossible.

    Active sets: bounds that a step meets become equations; an equation whose multiplier pulls inwards is released.
    """
    n = len(cov)
    c = cov + 1e-14 * np.trace(cov) / n * np.eye(n)
    a = np.ones((1, n)) if target is None else np.vstack([np.ones(n), mu])
    b = np.array([1.0]) if target is None else np.array([1.0, target])
    g = np.zeros(n) if linear is None else -tilt * linear
    w = feasible(a, b, low, high)
    if w is None:
        return None
    state = np.where(w <= low + 1e-12, -1, np.where(w >= high - 1e-12, 1, 0))
    for _ in range(50 * n):
        free = np.flatnonzero(state == 0)
        step = np.zeros(n)
        grad = c @ w + g
        k = len(free)
        if k:
            kkt = np.block([[c[np.ix_(free, free)], a[:, free].T], [a[:, free], np.zeros((len(a), len(a)))]])
            sol = np.linalg.lstsq(kkt, np.r_[-grad[free], np.zeros(len(a))], rcond=None)[0]
            step[free], lam = sol[:k], sol[k:]
        else:
            lam = np.linalg.lstsq(a.T, -grad, rcond=None)[0]
        if np.abs(step).max(initial=0) < 1e-12:
            pull = grad + a.T @ lam  # at the lower bound it must not be negative, at the upper not positive
            wrong = np.where(state == -1, -pull, np.where(state == 1, pull, 0.0))
            worst = int(wrong.argmax())
            if wrong[worst] <= 1e-11:
                return np.clip(w, low, high)
            state[worst] = 0
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 1e-15, (high - w) / step, np.where(step < -1e-15, (low - w) / step, np.inf))
        hit = int(room.argmin())
        t = min(1.0, max(0.0, room[hit]))
        w = w + t * step
        if t < 1.0:
            state[hit] = 1 if step[hit] > 0 else -1
            w[hit] = high if step[hit] > 0 else low
    return np.clip(w, low, high)


def feasible(a: np.ndarray, b: np.ndarray, low: float, high: float) -> np.ndarray | None:
    """Some weights within the bounds that meet the equations."""
    n = a.shape[1]
    if n * low > 1 + 1e-12 or n * high < 1 - 1e-12:
        return None
    if len(b) == 1:
        return np.full(n, 1 / n)
    ends = []
    for sign in (1, -1):  # the least and the greatest return: fill up in order
        w, left = np.full(n, low), 1 - n * low
        for i in np.argsort(sign * a[1], kind="stable"):
            more = min(high - low, left)
            w[i] += more
            left -= more
        ends.append(w)
    lo, hi = (float(a[1] @ w) for w in ends)
    if not lo - 1e-12 <= b[1] <= hi + 1e-12:
        return None
    share = 0.0 if hi == lo else np.clip((b[1] - lo) / (hi - lo), 0, 1)
    return (1 - share) * ends[0] + share * ends[1]


def max_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float = 0.0, low: float = 0.0, high: float = 1.0) -> np.ndarray | None:
    """Greatest (w'mu - rf) / sqrt(w'Cw): the best mean-variance portfolio over the price of risk.

    On the frontier the ratio has one maximum, found by golden section over the target return.
    """
    n = len(mu)
    start = minimise(cov, low=low, high=high)
    if start is None:
        return None
    order = np.argsort(-mu, kind="stable")
    top, left = np.full(n, low), 1 - n * low
    for i in order:
        more = min(high - low, left)
        top[i] += more
        left -= more
    a, b = float(mu @ start), float(mu @ top)

    def ratio(target: float) -> tuple[float, np.ndarray]:
        w = minimise(cov, mu, target, low, high)
        if w is None:
            return -np.inf, start
        return float((w @ mu - rf) / np.sqrt(max(w @ cov @ w, 1e-300))), w

    gold = (np.sqrt(5) - 1) / 2
    best = max((ratio(a), ratio(b)), key=lambda r: r[0])
    x, y = b - gold * (b - a), a + gold * (b - a)
    fx, fy = ratio(x), ratio(y)
    for _ in range(60):
        best = max(best, fx, fy, key=lambda r: r[0])
        if abs(b - a) < 1e-14 * max(1.0, abs(b)):
            break
        if fx[0] >= fy[0]:
            b, y, fy = y, x, fx
            x = b - gold * (b - a)
            fx = ratio(x)
        else:
            a, x, fx = x, y, fy
            y = a + gold * (b - a)
            fy = ratio(y)
    return best[1]


def target_volatility(mu: np.ndarray, cov: np.ndarray, vol: float, low: float = 0.0, high: float = 1.0) -> np.ndarray | None:
    """Greatest return with volatility at most ``vol``, by bisection along the frontier; the least-variance weights if none has."""
    w = minimise(cov, low=low, high=high)
    if w is None or np.sqrt(w @ cov @ w) >= vol:
        return w
    order, top, left = np.argsort(-mu, kind="stable"), np.full(len(mu), low), 1 - len(mu) * low
    for i in order:
        more = min(high - low, left)
        top[i] += more
        left -= more
    a, b = float(w @ mu), float(top @ mu)
    if np.sqrt(top @ cov @ top) <= vol:
        return top
    for _ in range(80):
        mid = (a + b) / 2
        one = minimise(cov, mu, mid, low, high)
        if one is not None and np.sqrt(one @ cov @ one) <= vol:
            a, w = mid, one
        else:
            b = mid
    return w


def frontier(mu: np.ndarray, cov: np.ndarray, n: int = 50, low: float = 0.0, high: float = 1.0) -> list[tuple[float, float, np.ndarray]]:
    """(return, volatility, weights) for targets from the least-variance portfolio's return to the greatest mean."""
    w = minimise(cov, low=low, high=high)
    out = []
    for target in np.linspace(float(w @ mu), float(mu.max()), n):
        one = minimise(cov, mu, target, low, high)
        if one is not None:
            out.append((float(one @ mu), float(np.sqrt(one @ cov @ one)), one))
    return out


def live_max_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 0.40) -> np.ndarray:
    """Long-only and capped; equal weights where the programme has no usable answer."""
    n = len(mu)
    try:
        w = max_sharpe(mu, cov, high=max(cap, 1 / n))
    except np.linalg.LinAlgError:
        w = None
    if w is None or not np.isfinite(w).all():
        return np.full(n, 1 / n)
    w = np.maximum(w, 0)
    return w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
