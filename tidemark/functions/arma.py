"""Autoregressive moving averages with differencing: exact Gaussian likelihood by the Kalman recursion of innovations.

A process z of orders (p, q) around a mean is the first entry of a state s with s' = T s + (1, theta) e. The recursion
gives each day's innovation and its variance; data enter linearly, so the series and a column of ones run through it
together and the mean is a weighted regression of one on the other. Once the variance has settled the innovations obey
the difference equation of the process itself. Many coefficients run side by side, so a gradient costs one pass.
"""

from __future__ import annotations

import numpy as np

#: How near to its limit an innovation's variance has to be before the recursion changes to the difference equation.
SETTLED = 1e-15


def of_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients (..., p) of stationary autoregressions with partial autocorrelations ``r`` (Durbin's recursion)."""
    r = np.asarray(r, float)
    phi = r[..., :0]
    for k in range(r.shape[-1]):
        x = r[..., k : k + 1]
        phi = np.concatenate([phi - x * phi[..., ::-1], x], axis=-1)
    return phi


def partial_of(phi: np.ndarray, most: float = 0.99) -> np.ndarray:
    """The recursion turned round; partial autocorrelations of no stationary process are cut to ``most``."""
    out = []
    while len(phi):
        x = float(np.clip(phi[-1], -most, most))
        out.append(x)
        phi = (phi[:-1] + x * phi[:-1][::-1]) / (1 - x * x)
    return np.array(out[::-1])


def _state(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, (1, theta), stationary covariance of the state) for each row of coefficients."""
    b, p, q = len(phi), phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    t = np.zeros((b, r, r))
    t[:, :p, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] = 1
    load = np.zeros((b, r))
    load[:, 0], load[:, 1 : q + 1] = 1, theta
    shock = load[:, :, None] * load[:, None, :]
    twice = np.einsum("bij,bkl->bikjl", t, t).reshape(b, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - twice, shock.reshape(b, r * r, 1)).reshape(b, r, r)
    return t, load, (cov + cov.transpose(0, 2, 1)) / 2


def innovations(z: np.ndarray, phi: np.ndarray, theta: np.ndarray, to_end: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(innovations (b, n, c), variances (b, n), T (b, r, r), next state (b, r, c)) of the columns of ``z`` (n, c), in units of
    a shock's variance. With ``to_end`` the recursion never changes, so that the state is exact."""
    n, c = z.shape
    t, load, cov = _state(phi, theta)
    b, p, q = len(phi), phi.shape[1], theta.shape[1]
    state = np.zeros((b, t.shape[1], c))
    v, f = np.empty((b, n, c)), np.ones((b, n))
    shock = load[:, :, None] * load[:, None, :]
    i = 0
    while i < n:
        f[:, i] = cov[:, 0, 0]
        if not to_end and i >= max(p, q) and (f[:, i] - 1 < SETTLED).all():
            break
        v[:, i] = z[i] - state[:, 0]
        moved = t @ cov
        gain = moved[:, :, 0] / f[:, i, None]
        state = t @ state + gain[:, :, None] * v[:, i, None, :]
        cov = moved @ t.transpose(0, 2, 1) + shock - gain[:, :, None] * gain[:, None, :] * f[:, i, None, None]
        i += 1
    if i < n:
        f[:, i:] = 1
        rest = np.broadcast_to(z[i:], (b, n - i, c)).copy()
        for j in range(1, p + 1):
            rest -= phi[:, j - 1, None, None] * z[i - j : n - j]
        for k in range(i, n):
            x = rest[:, k - i]
            for j in range(1, q + 1):
                x = x - theta[:, j - 1, None] * v[:, k - j]
            v[:, k] = x
    return v, f, t, state


class ARIMA:
    """Orders (p, d, q) on a series. Differenced series have no mean, others one, which is profiled out as the variance is."""

    def __init__(self, y: np.ndarray, p: int = 1, d: int = 0, q: int = 0):
        self.y, self.p, self.d, self.q = np.asarray(y, float), p, d, q
        self.z = np.diff(self.y, d)
        if len(self.z) <= p + q + 2:
            raise np.linalg.LinAlgError("too few rows")
        if not np.ptp(self.z) > 0:
            raise np.linalg.LinAlgError("a flat history")
        self.u = None

    def coefficients(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phi, theta) of unbounded parameters: stationary and invertible whatever they are."""
        r = np.tanh(np.atleast_2d(u))
        return of_partial(r[:, : self.p]), -of_partial(-r[:, self.p :])

    def profile(self, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, variance, log likelihood) for each row of coefficients."""
        n = len(self.z)
        ones = self.d == 0
        v, f, _, _ = innovations(np.column_stack([self.z, np.ones(n)]) if ones else self.z[:, None], phi, theta)
        x = v[:, :, 0]
        mean = (x * v[:, :, 1] / f).sum(1) / (v[:, :, 1] ** 2 / f).sum(1) if ones else np.zeros(len(phi))
        if ones:
            x = x - mean[:, None] * v[:, :, 1]
        variance = np.maximum((x * x / f).sum(1) / n, 1e-300)
        return mean, variance, -n / 2 * (np.log(2 * np.pi * variance) + 1) - np.log(f).sum(1) / 2

    def _starts(self) -> list[np.ndarray]:
        """Nought, and regression on own lags and on residuals of a long autoregression (Hannan and Rissanen)."""
        p, q, z = self.p, self.q, self.z - (self.z.mean() if self.d == 0 else 0)
        out = [np.zeros(p + q)]
        m = min(max(10, 2 * (p + q)), len(z) // 4) if q else 0
        try:
            e = np.zeros(len(z))
            if q:
                x = np.column_stack([z[m - j : len(z) - j] for j in range(1, m + 1)])
                e[m:] = z[m:] - x @ np.linalg.lstsq(x, z[m:], rcond=None)[0]
            at = m + max(p, q)
            if p + q and len(z) - at > 2 * (p + q):
                x = np.column_stack([z[at - j : len(z) - j] for j in range(1, p + 1)] + [e[at - j : len(z) - j] for j in range(1, q + 1)])
                beta = np.linalg.lstsq(x, z[at:], rcond=None)[0]
                out.append(np.arctanh(np.r_[partial_of(beta[:p]), -partial_of(-beta[p:])]))
        except np.linalg.LinAlgError:
            pass
        return out

    def fit(self) -> ARIMA:
        f = lambda us: -self.profile(*self.coefficients(us))[2] / len(self.z)
        found = [least_of_many(f, u) for u in self._starts()] if self.p + self.q else [np.zeros(0)]
        self.u = min(found, key=lambda u: float(f(u[None])[0])) if len(found) > 1 else found[0]
        phi, theta = self.coefficients(self.u)
        mean, variance, level = self.profile(phi, theta)
        self.phi, self.theta, self.mean, self.variance, self.level = phi[0], theta[0], float(mean[0]), float(variance[0]), float(level[0])
        if not np.isfinite(self.level):
            raise np.linalg.LinAlgError("no finite likelihood")
        return self

    def forecast(self, steps: int) -> np.ndarray:
        """The next values' means given all before them; differences are summed up from the last values."""
        _, _, t, state = innovations((self.z - self.mean)[:, None], self.phi[None], self.theta[None], to_end=True)
        t, s, out = t[0], state[0, :, 0], np.empty(steps)
        for h in range(steps):
            out[h] = s[0] + self.mean
            s = t @ s
        for k in range(self.d - 1, -1, -1):
            out = np.diff(self.y, k)[-1] + np.cumsum(out)
        return out


def least_of_many(f, u: np.ndarray, rounds: int = 100, h: float = 1e-5) -> np.ndarray:
    """Where a smooth function is least, by quasi-Newton steps; ``f`` takes rows of points, so a gradient is one call."""
    n, steps = len(u), 0.5 ** np.arange(0, 12)

    def both(at: np.ndarray) -> tuple[float, np.ndarray]:
        x = f(np.vstack([at[None], at + h * np.eye(n), at - h * np.eye(n)]))
        return float(x[0]), (x[1 : n + 1] - x[n + 1 :]) / (2 * h)

    value, g = both(u)
    inverse = np.eye(n)
    for _ in range(rounds):
        if not np.isfinite(value) or np.abs(g).max() < 1e-9:
            break
        move = -inverse @ g
        if g @ move >= 0:
            inverse, move = np.eye(n), -g
        size = min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        tried = size * steps
        with np.errstate(invalid="ignore"):
            good = np.flatnonzero(f(u + tried[:1, None] * move) <= value + 1e-4 * tried[0] * (g @ move))
            if not len(good):
                good = 1 + np.flatnonzero(f(u + tried[1:, None] * move) <= value + 1e-4 * tried[1:] * (g @ move))
        if not len(good):
            break
        to = u + tried[good[0]] * move
        value, after = both(to)
        d, y = to - u, after - g
        if d @ y > 1e-14:
            left = np.eye(n) - np.outer(d, y) / (d @ y)
            inverse = left @ inverse @ left.T + np.outer(d, d) / (d @ y)
        u, g = to, after
    return u


def least_of_each(f, u: np.ndarray, rounds: int = 100, h: float = 1e-5) -> np.ndarray:
    """Where each of many smooth functions is least, by quasi-Newton steps side by side. ``f(which, points)`` gives the values
    (m, k) of the functions number ``which`` (m) at their ``points`` (m, k, n); ``u`` (all, n) are starts."""
    total, n = u.shape
    u = u.copy()
    around = np.concatenate([np.zeros((1, n)), h * np.eye(n), -h * np.eye(n)])

    def both(which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = f(which, at[:, None] + around)
        return x[:, 0], (x[:, 1 : n + 1] - x[:, n + 1 :]) / (2 * h)

    which = np.arange(total)
    value, g = both(which, u)
    inverse = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for _ in range(rounds):
        going = np.isfinite(value) & (np.abs(g).max(1) >= 1e-9)
        which, value, g, inverse = which[going], value[going], g[going], inverse[going]
        if not len(which):
            break
        move = -np.einsum("mij,mj->mi", inverse, g)
        up = np.einsum("mi,mi->m", g, move) >= 0
        inverse[up], move[up] = np.eye(n), -g[up]
        size = np.minimum(1.0, 2.0 / np.maximum(np.abs(move).max(1), 1e-12))[:, None] * 0.5 ** np.arange(12)
        with np.errstate(invalid="ignore"):
            good = f(which, u[which, None] + size[:, :, None] * move[:, None]) <= value[:, None] + 1e-4 * size * np.einsum("mi,mi->m", g, move)[:, None]
        some = good.any(1)
        which, value, g, inverse, move, size, good = (x[some] for x in (which, value, g, inverse, move, size, good))
        step = size[np.arange(len(which)), good.argmax(1), None] * move
        u[which] += step
        value, after = both(which, u[which])
        y = after - g
        dy = np.einsum("mi,mi->m", step, y)
        curved = dy > 1e-14
        d, y, dy = step[curved], y[curved], dy[curved, None, None]
        left = np.eye(n) - d[:, :, None] * y[:, None, :] / dy
        inverse[curved] = left @ inverse[curved] @ left.transpose(0, 2, 1) + d[:, :, None] * d[:, None, :] / dy
        g = after
    return u
