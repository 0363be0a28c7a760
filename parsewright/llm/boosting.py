"""Small gradient-boosted trees for two classes, on binned features; fitted on the driver on bounded rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    cuts: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature (-1: leaf), cut, value; heap order
    depth: int = 4

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class one for each row."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 8) -> Boosted:
    """Second-order boosting of the logistic loss, exact over at most BINS bins a feature."""
    n, width = x.shape
    model = Boosted(depth=depth)
    binned = np.zeros((n, width), np.int64)
    for j in range(width):
        values = np.unique(x[:, j])
        cuts = (values[1:] + values[:-1]) / 2
        if len(cuts) >= BINS:
            cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.cuts.append(cuts)
        binned[:, j] = np.searchsorted(cuts, x[:, j], side="left")
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model.bias = float(np.log(share / (1 - share)))
    f = np.full(n, model.bias)
    shift = np.arange(width) * BINS
    size = (1 << (depth + 1)) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(size, -1, np.int64), np.zeros(size), np.zeros(size)
        held = {0: np.arange(n)}
        for node in range(size):
            rows = held.pop(node, None)
            if rows is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + ridge)
            f_best = None
            if node < size // 2 and len(rows) >= 2 * least:
                where = (binned[rows] + shift).ravel()
                sums = [np.bincount(where, w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (np.repeat(g[rows], width), np.repeat(h[rows], width), np.ones(len(where)))]
                gl, hl, nl = sums
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6 and b < len(model.cuts[j]):
                    f_best = (int(j), int(b))
            if f_best is None:
                f[rows] += value[node]
                continue
            j, b = f_best
            feature[node], cut[node] = j, model.cuts[j][b]
            right = binned[rows, j] > b
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
        model.trees.append((feature, cut, value))
    return model
