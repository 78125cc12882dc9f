"""Activity of a building: how far its consumption is from its least for the conditions, from 0 to 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.common import KEYS, TS
from .boosting import Booster
from .splines import kalman_smooth, spline_basis, tensor, weighted_fit

#: Quantiles, trees and rate of the two boundary models; the search's boxes and its price of steepness.
HIGH, LOW, TREES, RATE = 0.99, 0.01, {0.99: 600, 0.01: 200}, 0.01
C1, C2, PRICE, NOISE, ON = (5, 100), (0.1, 0.9), 0.005, 0.1, 1e-5


def round1(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10 + 0.5) / 10


def snap(x: np.ndarray, rounded: bool = False) -> np.ndarray:
    return np.where(x < 0.1, 0.0, np.where(x > 0.9, 1.0, round1(x) if rounded else x))


def squash(x: np.ndarray, c1: float, c2: float, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """A sigmoid, rescaled to [low, high]; a constant becomes low."""
    s = 1 / (1 + np.exp(-np.clip(c1 * (x - c2), -500, 500)))
    width = s.max() - s.min()
    return low + (s - s.min()) / width * (high - low) if width > 0 else np.full(len(x), low)


def _matrix(x: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    out = []
    for f in features:
        c = x[f]
        out.append(pd.factorize(c, sort=True)[0].astype(float) if c.dtype == object else c.to_numpy(float))
    return np.column_stack(out) if out else np.zeros((len(x), 0))


def with_time(x: pd.DataFrame, ts: str = TS) -> pd.DataFrame:
    t = pd.to_datetime(x[ts])
    return x.assign(_hour=t.dt.hour.astype(float), _weekday=t.dt.dayofweek.astype(float))


def extract_activity(conditions: np.ndarray, y: np.ndarray, scale: tuple[float, float] = (0.0, 1.0), trees: dict | None = None) -> np.ndarray:
    """Where y lies between the low and the high quantile for its conditions, on scale and clipped to it."""
    if conditions.shape[1] == 0:
        conditions = np.zeros((len(y), 1))
    bounds = []
    for q in (LOW, HIGH):
        model = Booster(iterations=(trees or TREES)[q], rate=RATE, quantile=q)
        model.fit(conditions, y)
        bounds.append(model.predict(conditions))
    a, b = scale
    width = bounds[1] - bounds[0]
    return np.clip(np.where(width > 0, (b - a) * (y - bounds[0]) / np.where(width > 0, width, 1) + a, a), a, b)


def trimmed(raw: np.ndarray, c1: float, c2: float, rounded: bool = False, high: float = 1.0) -> np.ndarray:
    """Raw activity squashed to [0, high], its ends set to 0 and 1."""
    return snap(squash(raw, c1, c2, 0.0, high), rounded)


def weighted_error(act: np.ndarray, basis: np.ndarray, y: np.ndarray) -> float:
    """Mean squared error of two regressions on the weather, mixed by activity."""
    fitted = act * weighted_fit(basis, y, act) + (1 - act) * weighted_fit(basis, y, 1 - act)
    return float(np.mean((y - fitted) ** 2))


def _cv(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.sqrt(np.mean((y - p) ** 2)) / np.mean(y))


def overfit_proxy(act: np.ndarray, exog: np.ndarray, y: np.ndarray, smooth: np.ndarray) -> float:
    """One regression of raw consumption on activity and weather: how far its errors against smoothed and against raw
    consumption lie apart, a sign of fitting noise."""
    p = weighted_fit(tensor(spline_basis(act, 3), spline_basis(exog, 4)), y)
    return abs(_cv(smooth, p) - _cv(y, p))


def raw_activity(x: pd.DataFrame, y: np.ndarray, conditions: Sequence[str], hurdle: bool, trees: dict | None = None) -> np.ndarray:
    """Rounded activity of all rows; under a hurdle rows without consumption are 0, and the others 0.05 at least before."""
    on, out = ~np.isnan(y) & ((y > ON) if hurdle else True), np.zeros(len(y))
    if on.any():
        out[on] = round1(extract_activity(_matrix(x[on], [c for c in conditions if c in x]), y[on], (0.05, 1.0) if hurdle else (0.0, 1.0), trees))
    return out


def estimate(x: pd.DataFrame, y: np.ndarray, conditions: Sequence[str] = ("temperature",), exog: str = "temperature", trials: int = 200, hurdle: bool = False, seed: int = 0, trees: dict | None = None) -> tuple[np.ndarray, dict]:
    """Activity of the rows, and the parameters chosen; rows without y are 0.

    Raw activity is squashed by a sigmoid; its centre c2 is searched for the least error of two weather regressions
    weighted by activity, its steepness c1 for the least sign of overfitting, on rows where nothing is missing. In each
    trial activity is rescaled to 0 to 1 and trimmed. The search draws from the same boxes by a fixed seed.
    """
    y = np.asarray(y, float)
    e = x[exog].to_numpy(float)
    known = ~np.isnan(y) & ~np.isnan(e)
    for c in conditions:
        if c in x:
            known &= x[c].notna().to_numpy()
    if known.sum() < 20:
        return np.zeros(len(y)), {}
    act = raw_activity(x, y, conditions, hurdle, trees)
    raw, yk, ek = act[known], y[known], e[known]
    r = np.random.default_rng(seed)
    basis = spline_basis(ek, 4)
    draws = [(int(r.integers(C1[0], C1[1] + 1)), float(r.uniform(*C2))) for _ in range(trials)]
    c2 = min(draws, key=lambda c: weighted_error(trimmed(raw, *c), basis, yk))[1]
    smooth = kalman_smooth(y, NOISE)[known]
    smooth[yk <= ON] = 0.0
    start = overfit_proxy(trimmed(raw, C1[0], c2, True), ek, yk, smooth)
    gain = lambda c: ((start - overfit_proxy(trimmed(raw, c, c2, True), ek, yk, smooth)) / start if start > 0 else 0.0) - PRICE * c
    c1 = max(sorted({int(v) for v in r.integers(C1[0], C1[1] + 1, size=trials)}), key=gain)
    return np.where(np.isnan(y), 0.0, trimmed(act, c1, c2, True)), {"c1": c1, "c2": c2}


def adjust(raw: np.ndarray, y: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], trials: int = 500, upper_bound: float = 2.0, seed: int = 0) -> tuple[np.ndarray, dict]:
    """Activity with which a trained predictor comes closest to y: a search over the bound of the scale and the sigmoid."""
    r, best = np.random.default_rng(seed), (np.inf, np.zeros(len(y)), {})
    for _ in range(trials):
        p = {"true_bound": float(r.uniform(0, upper_bound)), "c1": int(r.integers(5, 51)), "c2": float(r.uniform(*C2))}
        act = trimmed(raw, p["c1"], p["c2"], True, p["true_bound"])
        error = float(np.mean((y - predict(act)) ** 2))
        if error < best[0]:
            best = (error, act, p)
    return best[1], best[2]


def markov(y: np.ndarray, exog: np.ndarray, bins: int = 5, rounds: int = 40) -> np.ndarray:
    """Smoothed probability of the higher of two regimes: switching regression on binned exog, by Hamilton's filter, Kim's
    smoother and expectation-maximisation."""
    y, exog = np.asarray(y, float), np.asarray(exog, float)
    width = (exog.max() - exog.min()) / bins
    at = np.clip(((exog - exog.min()) / width).astype(int), 0, bins - 1) if width > 0 else np.zeros(len(y), int)
    x = np.eye(bins)[at]
    n = len(y)
    beta = np.array([np.full(bins, np.quantile(y, q)) for q in (0.25, 0.75)])
    var, trans = np.full(2, y.var() + 1e-9), np.array([[0.9, 0.1], [0.1, 0.9]])
    for _ in range(rounds):
        mu = x @ beta.T
        density = np.exp(-0.5 * (y[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        filtered, ahead, p = np.empty((n, 2)), np.empty((n, 2)), np.full(2, 0.5)
        for t in range(n):
            ahead[t] = p @ trans
            f = ahead[t] * density[t]
            p = filtered[t] = f / f.sum()
        smooth, joint = filtered.copy(), np.zeros((2, 2))
        for t in range(n - 2, -1, -1):
            ratio = smooth[t + 1] / np.maximum(ahead[t + 1], 1e-300)
            both = filtered[t][:, None] * trans * ratio
            joint += both
            smooth[t] = both.sum(1)
        trans = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        for k in range(2):
            w = smooth[:, k]
            beta[k] = (x * w[:, None]).T @ y / np.maximum(x.T @ w, 1e-9)
            var[k] = (w * (y - x @ beta[k]) ** 2).sum() / max(w.sum(), 1e-9) + 1e-9
    high = int(beta[1].mean() > beta[0].mean())
    return smooth[:, high]


def _per_site(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str]) -> DataFrame:
    from ..sources.session import ship

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(f, schema)


def _key_schema(df: DataFrame, keys: Sequence[str], ts: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, ts))


def estimate_activity(df: DataFrame, conditions: Sequence[str] = ("temperature",), exog: str = "temperature", column: str = "consumption", n_trials: int = 200, assume_hurdle: bool = False, seed: int = 0, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """keys, ts and activity of each site's rows. conditions may name _hour and _weekday besides df's columns."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = with_time(x.sort_values(ts), ts)
        act, _ = estimate(x, x[column].to_numpy(float), conditions, exog, n_trials, assume_hurdle, seed)
        return x[[*keys, ts]].assign(activity=act)

    return _per_site(df, run, _key_schema(df, keys, ts) + ", activity double", keys)


def estimate_activity_markov(df: DataFrame, exog: str = "temperature", column: str = "consumption", n_bins: int = 5, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(ts).dropna(subset=[exog, column])
        return x[[*keys, ts]].assign(activity=snap(markov(x[column].to_numpy(float), x[exog].to_numpy(float), n_bins)))

    return _per_site(df, run, _key_schema(df, keys, ts) + ", activity double", keys)


def smooth_consumption(df: DataFrame, column: str = "consumption", noise: float = NOISE, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """keys, ts and the local level of each site's column, 0 where nothing is used."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(ts)
        y = x[column].to_numpy(float)
        return x[[*keys, ts]].assign(smoothed=np.where(np.nan_to_num(y, nan=1.0) <= ON, 0.0, kalman_smooth(y, noise)))

    return _per_site(df, run, _key_schema(df, keys, ts) + ", smoothed double", keys)
