"""Gradient boosting of shallow trees on histograms, for squared and for quantile loss; in numpy, so that a fitted model
can be called inside a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Booster:
    """Trees of a depth fitted in turn to the loss's gradient; missing values have a bin of their own, the lowest."""

    iterations: int = 200
    depth: int = 3
    rate: float = 0.1
    quantile: float | None = None
    least: int = 5
    start: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "right") + 1)
        return out

    def _leaf(self, residual: np.ndarray) -> float:
        return float(np.quantile(residual, self.quantile)) if self.quantile is not None else float(residual.mean())

    def _tree(self, bins: np.ndarray, gradient: np.ndarray, residual: np.ndarray):
        """Nested (feature, bin, left, right), or a leaf's value; rows whose bin is at most the node's go left."""

        def grow(rows: np.ndarray, depth: int):
            if depth == self.depth or len(rows) < 2 * self.least:
                return self._leaf(residual[rows])
            g, best = gradient[rows], (1e-12, None, None)
            for j in range(bins.shape[1]):
                b = bins[rows, j]
                size = int(b.max()) + 1
                n, s = np.bincount(b, minlength=size).cumsum()[:-1], np.bincount(b, weights=g, minlength=size).cumsum()[:-1]
                m = len(rows) - n
                fine = (n >= self.least) & (m >= self.least)
                if fine.any():
                    total = g.sum()
                    gain = np.where(fine, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1) - total**2 / len(rows), -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                return self._leaf(residual[rows])
            left = bins[rows, best[1]] <= best[2]
            return best[1], best[2], grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

        return grow(np.arange(len(bins)), 0)

    def _apply(self, tree, bins: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        left = bins[:, tree[0]] <= tree[1]
        out = np.empty(len(bins))
        out[left], out[~left] = self._apply(tree[2], bins[left]), self._apply(tree[3], bins[~left])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 100) -> list[tuple[float, float]]:
        """Returns (learning, held-out) root mean squared errors by iteration; stops when patience iterations bring no gain."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.nanquantile(c[~np.isnan(c)], np.linspace(0, 1, BINS + 1)[1:-1])) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        bins, self.trees = self._bins(x), []
        self.start = float(np.quantile(y, self.quantile)) if self.quantile is not None else float(y.mean())
        f = np.full(len(y), self.start)
        other = None if held is None else (self._bins(np.asarray(held[0], float)), np.asarray(held[1], float), np.full(len(held[1]), self.start))
        scores, best = [], (np.inf, 0)
        for k in range(self.iterations):
            residual = y - f
            gradient = residual if self.quantile is None else np.where(residual > 0, self.quantile, self.quantile - 1)
            tree = self._tree(bins, gradient, residual)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, bins)
            error = lambda a, b: float(np.sqrt(np.mean((a - b) ** 2)))
            if other is not None:
                other[2].__iadd__(self.rate * self._apply(tree, other[0]))
                scores.append((error(y, f), error(other[1], other[2])))
                if scores[-1][1] < best[0]:
                    best = (scores[-1][1], k)
                elif k - best[1] >= patience:
                    break
        return scores

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(np.asarray(x, float))
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += self.rate * self._apply(tree, bins)
        return out


def train_boost(x: np.ndarray, y: np.ndarray, validation_size: float = 0.2, iterations: int = 10_000, floor: int = 100, patience: int = 100) -> tuple[Booster, dict[str, float]]:
    """Rows in order of time: the last share is held out, its best iteration (floor at least) is the number of trees, and
    the model is fitted again to all rows. Scores: errors of learning and held-out rows, and the latter's CVRMSE."""
    n = len(y) - int(np.ceil(round(validation_size * len(y), 9)))
    if n < 2 or n == len(y):
        model = Booster(iterations=floor)
        model.fit(x, y)
        return model, {"learn": float("nan"), "validation": float("nan"), "CVRMSE": float("nan")}
    trial = Booster(iterations=iterations)
    scores = trial.fit(x[:n], y[:n], (x[n:], y[n:]), patience)
    best = int(np.argmin([s for _, s in scores]))
    model = Booster(iterations=max(floor, best + 1))
    model.fit(x, y)
    return model, {"learn": scores[best][0], "validation": scores[best][1], "CVRMSE": scores[best][1] / float(np.mean(y[n:]))}
