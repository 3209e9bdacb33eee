"""Histogram gradient-boosted trees in numpy, with monotonic constraints, as flat arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes).  Inner nodes send a row left if its
    feature is at most the threshold; leaves point at themselves and hold the value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows go down all trees together."""
        total = np.full(len(x), self.bias)
        each = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                goes_left = x[each, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(goes_left, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def constant_forest(probability: float) -> Forest:
    """The forest without trees: what there is to learn from one class, or from no rows."""
    p = min(max(probability, 1e-3), 1 - 1e-3)
    empty, whole = np.zeros((0, 1)), np.zeros((0, 1), np.int64)
    return Forest(whole, empty, whole, whole, empty, float(np.log(p / (1 - p))), 0)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Sequence[int] | None = None,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smoothing: float = 1.0,
    min_rows: int = 10,
) -> Forest:
    """Boosts the log-loss.  ``monotone`` has 1, -1 or 0 for each feature: the score never
    falls, never rises, or may do either as that feature grows.  A split against its
    direction is refused, and the two sides' middle bounds all values below it."""
    n, features = x.shape
    if n == 0 or y.min() == y.max():
        return constant_forest(float(y.mean()) if n else 0.5)
    signs = np.zeros(features, int) if monotone is None else np.asarray(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features)]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = codes + np.arange(features) * bins
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, bias)
    size = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, size), np.int64)
    threshold = np.zeros((trees, size))
    left = np.tile(np.arange(size), (trees, 1))
    right = left.copy()
    value = np.zeros((trees, size))

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + smoothing), low), high)

    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        open_nodes = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while open_nodes:
            node, rows, low, high, level = open_nodes.pop()
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            value[t, node] = rate * leaf(g_all, h_all, low, high)
            found = None
            if level < depth and len(rows) >= 2 * min_rows:
                found = _best_split(
                    flat[rows], grad[rows], hess[rows], features, bins, signs, low, high, smoothing, min_rows
                )
            if found is None:
                raw[rows] += value[t, node]
                continue
            j, cut, low_value, high_value = found
            goes = codes[rows, j] <= cut
            feature[t, node], threshold[t, node] = j, cuts[j][cut]
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            middle = (low_value + high_value) / 2
            bounds = [(low, high), (low, high)]
            if signs[j] > 0:
                bounds = [(low, middle), (middle, high)]
            elif signs[j] < 0:
                bounds = [(middle, high), (low, middle)]
            open_nodes.append((2 * node + 1, rows[goes], *bounds[0], level + 1))
            open_nodes.append((2 * node + 2, rows[~goes], *bounds[1], level + 1))
    return Forest(feature, threshold, left, right, value, bias, depth)


def _best_split(flat, grad, hess, features, bins, signs, low, high, smoothing, min_rows):
    """Feature, last bin of the left side and the sides' values with most gain, or None."""
    where = flat.ravel()

    def histogram(weights: np.ndarray | None) -> np.ndarray:
        w = None if weights is None else np.repeat(weights, features)
        return np.bincount(where, w, minlength=features * bins).reshape(features, bins)

    g, h, c = (np.cumsum(histogram(w), axis=1) for w in (grad, hess, None))
    gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
    gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
    vl = np.clip(-gl / (hl + smoothing), low, high)
    vr = np.clip(-gr / (hr + smoothing), low, high)

    def loss(gs, hs, v):
        return gs * v + 0.5 * (hs + smoothing) * v * v

    whole = np.clip(-g[0, -1] / (h[0, -1] + smoothing), low, high)
    gain = loss(g[0, -1], h[0, -1], whole) - loss(gl, hl, vl) - loss(gr, hr, vr)
    wrong = (cl < min_rows) | (cr < min_rows) | ((vr - vl) * signs[:, None] < 0)
    gain[wrong] = -np.inf
    best = int(np.argmax(gain))
    j, cut = divmod(best, bins - 1)
    if not gain[j, cut] > 1e-9:
        return None
    return j, cut, vl[j, cut], vr[j, cut]
