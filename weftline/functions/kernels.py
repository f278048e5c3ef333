"""Numeric kernels for one pair of series; the pairs are what Spark distributes."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np


def discretise(x: np.ndarray, bins: int) -> np.ndarray:
    """Equal-frequency bins of ranks 1..n, ties by position."""
    rank = np.empty(len(x), np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(1, len(x) + 1)
    return np.minimum(rank * bins // len(x), bins - 1)


def _entropies(codes: np.ndarray, size: int) -> np.ndarray:
    """Shannon entropy (natural) of each row of codes."""
    rows = len(codes)
    count = np.bincount((codes + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)
    p = count / codes.shape[1]
    return -np.sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0), 1)


def _te(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Transfer entropy from each row of binned x to binned y."""
    now, past, source = y[None, 1:], y[None, :-1], x[:, :-1]
    own = _entropies(now * bins + past, bins**2) - _entropies(past, bins)
    both = _entropies((now * bins + past) * bins + source, bins**3) - _entropies(past * bins + source, bins**2)
    return np.maximum(0.0, own - both)


def transfer_entropy(source: np.ndarray, target: np.ndarray, bins: int = 4) -> float:
    if min(len(source), len(target)) < 3:
        return 0.0
    return float(_te(discretise(np.asarray(source), bins)[None], discretise(np.asarray(target), bins), bins)[0])


def circular_shifts(n: int, surrogates: int, seed: int | None) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(rng.integers(1, n)) for _ in range(surrogates)]


def te_significance(source: np.ndarray, target: np.ndarray, bins: int = 4, surrogates: int = 200, seed: int | None = None) -> tuple[float, float]:
    """(transfer entropy, p) against circular shifts of the source."""
    n = len(source)
    if n < 20:
        return 0.0, 1.0
    source = np.asarray(source, float)
    # ranks follow the shifted positions, which matters for tied values
    rows = np.stack([discretise(np.roll(source, k), bins) for k in (0, *circular_shifts(n, surrogates, seed))])
    te = _te(rows, discretise(np.asarray(target, float), bins), bins)
    return float(te[0]), float((np.sum(te[1:] >= te[0]) + 1) / (surrogates + 1))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, residuals, inverse of X'X)."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, y - x @ beta, np.linalg.pinv(x.T @ x)


def _lagged(u: np.ndarray, lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (level, lagged differences) and differences from position ``first``."""
    d = np.diff(u)
    columns = [u[first:-1], *(d[first - k : len(d) - k] for k in range(1, lags + 1))]
    return np.column_stack(columns), d[first:]


def adf_statistic(u: np.ndarray) -> float:
    """Augmented Dickey-Fuller t statistic without deterministic terms, lags by AIC."""
    n = len(u)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 1)
    best, lags = np.inf, 0
    for k in range(most + 1):
        x, y = _lagged(u, k, most)
        _, e, _ = _ols(x, y)
        m = len(y)
        aic = m * np.log(max(float(e @ e) / m, 1e-300)) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, k
    x, y = _lagged(u, lags, lags)
    beta, e, inv = _ols(x, y)
    return float(beta[0] / sqrt(float(e @ e) / (len(y) - x.shape[1]) * inv[0, 0]))


def mackinnon_p(tau: float) -> float:
    """Approximate p-value of the two-variable cointegration statistic with a constant."""
    if tau > 0.92:
        return 1.0
    if tau < -18.86:
        return 0.0
    z = 2.92 + 1.5012 * tau + 0.039796 * tau**2 if tau <= -2.62 else 2.1945 + 0.64695 * tau - 0.29198 * tau**2 - 0.042377 * tau**3
    return 0.5 * (1 + erf(z / sqrt(2)))


def engle_granger_p(y: np.ndarray, x: np.ndarray) -> float:
    """p-value of no cointegration of y on (1, x); the order matters."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    _, e, _ = _ols(np.column_stack([np.ones(len(x)), x]), y)
    spread = float(((y - y.mean()) ** 2).sum())
    if float(e @ e) <= 1e-13 * max(spread, 1e-300) * len(y):
        return 0.0  # collinear
    return mackinnon_p(adf_statistic(e))


def kalman_hedge(y: np.ndarray, x: np.ndarray, delta: float = 1e-4, obs_noise: float = 1e-3) -> np.ndarray:
    """(n, 4): alpha, beta, prior innovation and posterior residual of y on (1, x).

    The two-state recursion is written out in scalars.
    """
    q = delta / (1 - delta)
    alpha = beta = 0.0
    caa = cab = cba = cbb = 1.0
    out = np.empty((len(y), 4))
    for t in range(len(y)):
        caa, cbb = caa + q, cbb + q
        innovation = y[t] - alpha - beta * x[t]
        ga, gb = caa + cab * x[t], cba + cbb * x[t]
        va, vb = caa + x[t] * cba, cab + x[t] * cbb
        s = ga + x[t] * gb + obs_noise
        ka, kb = ga / s, gb / s
        alpha, beta = alpha + ka * innovation, beta + kb * innovation
        caa, cab, cba, cbb = caa - ka * va, cab - ka * vb, cba - kb * va, cbb - kb * vb
        out[t] = alpha, beta, innovation, y[t] - alpha - beta * x[t]
    return out
