"""B-spline bases, least squares on them, and the local-level smoother."""

from __future__ import annotations

import numpy as np


def spline_basis(x: np.ndarray, knots: int = 4, degree: int = 3) -> np.ndarray:
    """B-splines of a degree on quantile knots: knots + degree - 1 columns (4 knots and degree 3: 6). Beyond the knots
    the end values hold."""
    x = np.asarray(x, float)
    inner = np.quantile(x, np.linspace(0, 1, knots))
    if inner[0] == inner[-1]:
        inner = inner[0] + np.linspace(0, 1e-9, knots)
    t = np.r_[np.full(degree, inner[0]), inner, np.full(degree, inner[-1])]
    v = np.clip(x, inner[0], inner[-1])
    # the last interval that is not empty takes the right end
    width = np.diff(t)
    last = np.flatnonzero(width > 0)[-1]
    at = np.clip(np.searchsorted(t, v, "right") - 1, 0, last)
    b = np.zeros((len(x), len(t) - 1))
    b[np.arange(len(x)), at] = 1.0
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(t) - 1 - d))
        for i in range(new.shape[1]):
            if (w := t[i + d] - t[i]) > 0:
                new[:, i] += (v - t[i]) / w * b[:, i]
            if (w := t[i + d + 1] - t[i + 1]) > 0:
                new[:, i] += (t[i + d + 1] - v) / w * b[:, i + 1]
        b = new
    return b


def tensor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def weighted_fit(basis: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Fitted values of (weighted) least squares."""
    w = np.ones(len(y)) if weight is None else np.sqrt(np.maximum(weight, 0))
    coefficients = np.linalg.lstsq(basis * w[:, None], y * w, rcond=None)[0]
    return basis @ coefficients


def kalman_smooth(y: np.ndarray, level: float = 0.1, observation: float = 1.0) -> np.ndarray:
    """A local level with the given noises: filtered forwards, then smoothed backwards; missing values are bridged."""
    y = np.asarray(y, float)
    n = len(y)
    if not n or np.isnan(y).all():
        return y.copy()
    mean, var, before = np.empty(n), np.empty(n), np.empty(n)
    m, p = float(y[~np.isnan(y)][0]), 1e4
    for t in range(n):
        p += level
        before[t] = p
        if not np.isnan(y[t]):
            gain = p / (p + observation)
            m, p = m + gain * (y[t] - m), (1 - gain) * p
        mean[t], var[t] = m, p
    for t in range(n - 2, -1, -1):
        mean[t] += var[t] / before[t + 1] * (mean[t + 1] - mean[t])
    return mean
