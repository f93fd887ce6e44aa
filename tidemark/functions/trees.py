"""Gradient-boosted trees and logistic regression on small tables, in NumPy: what one fold's task fits."""

from __future__ import annotations

from math import factorial

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Boosted:
    """Trees of a fixed depth on binned features, logistic loss, second-order gains with a ridge on leaf weights."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8, ridge: float = 1.0, least: float = 1.0, bins: int = 16, seed: int = 42):
        self.trees, self.depth, self.rate, self.rows, self.columns = trees, depth, rate, rows, columns
        self.ridge, self.least, self.bins, self.seed = ridge, least, bins, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1) if x.shape[1] else np.zeros((len(x), 0), dtype=int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng, (n, width) = np.random.default_rng(self.seed), x.shape
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], at)) for f in range(width)]
        binned, score = self._binned(x), np.zeros(n)
        inner = 2**self.depth - 1
        self.feature, self.cut = np.full((self.trees, inner), -1), np.zeros((self.trees, inner), dtype=int)
        self.leaf = np.zeros((self.trees, inner + 1))
        self.cover = np.zeros((self.trees, 2 * inner + 1))  # sums of second derivatives, by node, leaves last
        cells = width * self.bins
        place = binned + np.arange(width) * self.bins
        for t in range(self.trees):
            p = _sigmoid(score)
            used = rng.random(n) < self.rows
            g, h = np.where(used, p - y, 0.0), np.where(used, p * (1 - p), 0.0)
            allowed = np.zeros(width, dtype=bool)
            allowed[rng.choice(width, max(1, round(self.columns * width)), replace=False)] = True
            node = np.zeros(n, dtype=int)
            for level in range(self.depth):
                many = 2**level
                flat = (node[:, None] * cells + place).ravel()
                both = [np.bincount(flat, weights=np.repeat(v, width), minlength=many * cells).reshape(many, width, self.bins).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (gt, ht) = both, [v[:, :1, -1:] for v in both]
                self.cover[t, many - 1 : 2 * many - 1] = ht[:, 0, 0]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least) | (hr < self.least) | ~allowed[None, :, None]] = -np.inf
                best = gain.reshape(many, -1).argmax(axis=1)
                split = gain.reshape(many, -1)[np.arange(many), best] > 1e-12
                feature, cut = best // self.bins, best % self.bins
                self.feature[t, many - 1 : 2 * many - 1] = np.where(split, feature, -1)
                self.cut[t, many - 1 : 2 * many - 1] = cut
                right = split[node] & (binned[np.arange(n), feature[node]] > cut[node])
                node = 2 * node + right
            gs, hs = (np.bincount(node, weights=v, minlength=inner + 1) for v in (g, h))
            self.leaf[t], self.cover[t, inner:] = -self.rate * gs / (hs + self.ridge), hs
            score += self.leaf[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        binned, score, at = self._binned(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=int)
            for level in range(self.depth):
                here = 2**level - 1 + node
                f = feature[here]
                node = 2 * node + ((f >= 0) & (binned[at, f] > cut[here]))
            score += leaf[node]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        """P(class 1)."""
        return _sigmoid(self.margin(x))

    def _leaves(self, t: int) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, int, bool]]]]]]:
        """Of each leaf that can be reached: its value, and by feature of its path the share of the training weight that goes the
        path's way at the feature's nodes, and those ways (feature, cut, right)."""
        out = []
        for leaf in range(2**self.depth):
            ways: dict[int, tuple[float, list]] = {}
            for level in range(self.depth):
                node, right = leaf >> (self.depth - level), bool(leaf >> (self.depth - level - 1) & 1)
                here = 2**level - 1 + node
                f, below = int(self.feature[t, here]), 2 ** (level + 1) - 1 + 2 * node + right
                if f < 0:
                    if right:
                        break
                    continue
                share, steps = ways.get(f, (1.0, []))
                ways[f] = (share * self.cover[t, below] / self.cover[t, here], [*steps, (f, int(self.cut[t, here]), right)])
            else:
                out.append((float(self.leaf[t, leaf]), ways))
        return out

    def attributions(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Shapley values of the margin by feature, and the expected margin, which they add up to the margin with. What a tree
        gives without a feature is its two branches, weighted by the training rows that went there (Lundberg et al., 2018)."""
        binned, base, out = self._binned(x), 0.0, np.zeros(x.shape)
        for t in range(self.trees):
            for value, ways in self._leaves(t):
                names = list(ways)
                none = np.array([ways[f][0] for f in names])
                base += value * float(none.prod())
                has = [np.logical_and.reduce([(binned[:, f] > cut) == right for f, cut, right in ways[f][1]]).astype(float) for f in names]
                m = len(names)
                for j, f in enumerate(names):
                    sums = [np.ones(len(x))]  # by the number of other features that are known
                    for i in range(m):
                        if i != j:
                            sums = [(sums[d] * none[i] if d < len(sums) else 0) + (sums[d - 1] * has[i] if d else 0) for d in range(len(sums) + 1)]
                    weighted = sum(c * (factorial(d) * factorial(m - 1 - d) / factorial(m)) for d, c in enumerate(sums))
                    out[:, f] += value * (has[j] - none[j]) * weighted
        return base, out


class Logistic:
    """Logistic regression on standardised features, by Newton's method."""

    def __init__(self, ridge: float = 1e-2):
        self.ridge = ridge

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.centre) / self.spread])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.centre, spread = x.mean(axis=0), x.std(axis=0)
        self.spread = np.where(spread > 0, spread, 1.0)
        d, self.w = self._design(x), np.zeros(x.shape[1] + 1)
        penalty = self.ridge * np.r_[0.0, np.ones(x.shape[1])]
        for _ in range(50):
            p = _sigmoid(d @ self.w)
            step = np.linalg.solve((d.T * (p * (1 - p))) @ d + np.diag(penalty + 1e-9), d.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-9:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._design(x) @ self.w)

    def attributions(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Each feature's term of the log odds, from the training mean, whose log odds come first."""
        return float(self.w[0]), self._design(x)[:, 1:] * self.w[1:]


def stump(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Cut (NaN: none), accuracy, and share of ones at or under and above it, of the one split with the least Gini impurity.

    The cut is the middle between two neighbouring values; of equally good ones the lowest."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    v, ones = x[order], np.cumsum(y[order])
    ends = np.flatnonzero(v[1:] > v[:-1])
    if not n or not len(ends) or ones[-1] in (0, n):
        share = float(ones[-1] / n) if n else np.nan
        return np.nan, max(share, 1 - share), np.nan, np.nan
    left, a = ends + 1.0, ones[ends]
    right, b = n - left, ones[-1] - a
    impurity = 2 * a * (1 - a / left) + 2 * b * (1 - b / right)
    k = int(np.argmin(np.round(impurity, 9)))
    right_of = max(a[k], left[k] - a[k]) + max(b[k], right[k] - b[k])
    return float((v[ends[k]] + v[ends[k] + 1]) / 2), float(right_of / n), float(a[k] / left[k]), float(b[k] / right[k])
