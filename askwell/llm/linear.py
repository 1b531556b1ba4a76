"""Logistic regression in numpy for the small, bounded training sets that the classifiers use."""

from __future__ import annotations

import numpy as np


class Marks:
    """A matrix of ones in a few places (rows, columns), beside some dense columns, as far as fitting needs it."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, width: int, dense: np.ndarray):
        self.rows, self.cols, self.width, self.dense = rows, cols, width, dense
        self.shape, self.dtype = (len(dense), width + dense.shape[1]), np.dtype("f8")

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, v[self.cols], self.shape[0]) + self.dense @ v[self.width :]

    def against(self, u: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``u``."""
        return np.concatenate([np.bincount(self.cols, u[self.rows], self.width), self.dense.T @ u])

    def __getitem__(self, chosen: np.ndarray) -> Marks:
        own = chosen[self.rows]
        return Marks((np.cumsum(chosen) - 1)[self.rows[own]], self.cols[own], self.width, self.dense[chosen])


def _against(x: np.ndarray | Marks, u: np.ndarray) -> np.ndarray:
    return x.against(u) if isinstance(x, Marks) else x.T @ u


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray | Marks, y: np.ndarray, weight: np.ndarray | None = None, shrink: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights, then the constant; accelerated gradient descent on the mean loss with a ridge (the constant is not shrunk).

    No rows, or rows of one class, give the constant that fits them.
    """
    n, d = x.shape
    w = np.zeros(d + 1, x.dtype)
    if not n:
        return w
    weight = np.ones(n, x.dtype) if weight is None else weight.astype(x.dtype)
    weight = weight / weight.sum()
    rate = float(np.clip((weight @ y + 1 / n) / (1 + 2 / n), 1e-6, 1 - 1e-6))
    w[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    # A bound of the curvature: power iterations on the weighted second moments.
    v = np.ones(d + 1, x.dtype) / np.sqrt(d + 1)
    for _ in range(12):
        u = x @ v[:-1] + v[-1]
        v = np.append(_against(x, weight * u), weight @ u)
        norm = np.linalg.norm(v)
        v = v / norm
    step = 1.0 / (0.3 * norm + shrink)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        g = weight * (sigmoid(x @ ahead[:-1] + ahead[-1]) - y)
        new = ahead - step * np.append(_against(x, g) + shrink * ahead[:-1], g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and constant that turn logits into calibrated logits (Platt's way, with a slope that isn't negative)."""
    scale = float(np.std(z)) or 1.0
    w = fit_logistic((z / scale)[:, None], y.astype(float), weight, shrink=1e-4, rounds=300)
    return max(0.0, float(w[0]) / scale), float(w[1])


def combination(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic model of calibrated logits whose weights aren't negative: a view that would get a negative one is left out."""
    out, used = np.zeros(z.shape[1] + 1), [*range(z.shape[1])]
    while True:
        w = fit_logistic(z[:, used], y.astype(float), shrink=1e-4, rounds=300)
        if not used or w[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(w[:-1])))
    out[[*used, -1]] = w
    return out
