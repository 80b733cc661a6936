"""Small dense helpers that run inside a task on one bounded group."""

from __future__ import annotations

import numpy as np


def solve_centred(gram: np.ndarray, cross: np.ndarray, tolerance: float = 1e-11) -> np.ndarray:
    """Least squares from sums. The last column of the design is the constant.

    Columns that do not vary get coefficient 0; further collinear directions are
    dropped by the eigenvalues of the correlation matrix.
    """
    n = gram[-1, -1]
    beta = np.zeros(len(cross))
    if n <= 0:
        return beta
    mean = gram[-1, :-1] / n
    cov = gram[:-1, :-1] / n - np.outer(mean, mean)
    target = cross[:-1] / n - mean * cross[-1] / n
    size = np.maximum(np.diag(gram)[:-1] / n, 1e-300)
    keep = np.flatnonzero(np.diag(cov) > 1e-12 * size)
    if len(keep):
        sd = np.sqrt(np.diag(cov)[keep])
        corr = cov[np.ix_(keep, keep)] / np.outer(sd, sd)
        values, vectors = np.linalg.eigh(corr)
        inverse = np.where(values > tolerance * values[-1], 1.0 / np.maximum(values, 1e-300), 0.0)
        beta[keep] = (vectors * inverse) @ (vectors.T @ (target[keep] / sd)) / sd
    beta[-1] = cross[-1] / n - mean @ beta[:-1]
    return beta


def lagged(x: np.ndarray, lags, start: int) -> np.ndarray:
    return np.column_stack([x[start - k:len(x) - k] for k in lags])


def lag_set(plain: int, seasonal: int, period: int) -> list[int]:
    """Lags of the product of an ordinary and a seasonal polynomial."""
    return sorted({i + period * j for i in range(plain + 1) for j in range(seasonal + 1)} - {0})


def stable(phi: np.ndarray, lags, limit: float = 0.999) -> np.ndarray:
    """Pull the roots of an autoregression inside the unit circle if one is beyond it."""
    if not len(lags):
        return phi
    companion = np.zeros((max(lags), max(lags)))
    companion[0, np.array(lags) - 1] = phi
    companion[1:, :-1] += np.eye(max(lags) - 1)
    radius = np.abs(np.linalg.eigvals(companion)).max()
    return phi if radius <= 1 + 1e-9 else phi * (limit / radius) ** np.array(lags, dtype=float)


def seasonal_arma_forecast(series: np.ndarray, horizon: int, order=(1, 0, 1), seasonal=(1, 0, 0),
                           period: int = 24, long_order: int = 8) -> np.ndarray:
    """Forecast of a seasonal ARMA fitted by two rounds of least squares.

    Round one is a long autoregression whose errors stand for the shocks; round
    two regresses on the lags of the series and of those shocks. Without moving
    average terms round one is skipped.
    """
    (p, d, q), (sp, sd, sq) = order, seasonal
    levels = [np.asarray(series, dtype=float)]
    steps = [period] * sd + [1] * d
    for k in steps:
        levels.append(levels[-1][k:] - levels[-1][:-k])
    w = levels[-1]
    mean = w.mean() if not steps and len(w) else 0.0
    x = w - mean
    ar, ma = lag_set(p, sp, period), lag_set(q, sq, period)
    shocks = np.zeros_like(x)
    start = max([0, *ar, *ma])
    if ma:
        wide = sorted({*range(1, long_order + 1), *([period, period + 1] if sp or sq else [])})
        if len(x) >= 3 * max(wide):
            design = lagged(x, wide, max(wide))
            shocks[max(wide):] = x[max(wide):] - design @ np.linalg.lstsq(design, x[max(wide):], rcond=None)[0]
        start += max(wide)
    out = np.zeros(horizon)
    if len(ar) + len(ma) and len(x) - start > 2 * (len(ar) + len(ma)):
        parts = ([lagged(x, ar, start)] if ar else []) + ([lagged(shocks, ma, start)] if ma else [])
        design = np.hstack(parts)
        coef = np.linalg.lstsq(design, x[start:], rcond=None)[0]
        shocks[start:] = x[start:] - design @ coef
        phi, theta = stable(coef[:len(ar)], ar), coef[len(ar):]
        past = np.concatenate([x, np.zeros(horizon)])
        noise = np.concatenate([shocks, np.zeros(horizon)])
        for t in range(len(x), len(x) + horizon):
            past[t] = sum(c * past[t - k] for c, k in zip(phi, ar)) + sum(c * noise[t - k] for c, k in zip(theta, ma))
        out = past[len(x):]
    out = out + mean
    for k, level in zip(reversed(steps), reversed(levels[:-1])):
        whole = np.concatenate([level, np.zeros(horizon)])
        for h in range(horizon):
            whole[len(level) + h] = out[h] + whole[len(level) + h - k]
        out = whole[len(level):]
    return out
