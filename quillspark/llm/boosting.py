"""Gradient-boosted trees on binned features, in numpy: small enough to be trained where they are used."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), bin, value of each node; children of k: 2k+1, 2k+2
    slope: float = 1.0
    shift: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                go = f >= 0
                right = b[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(go, 2 * at + 1 + right, at)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fits slope and shift of the logistic curve on rows that the trees haven't seen."""
        z = self.raw(x)
        self.slope, self.shift = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            w = p * (1 - p) + 1e-6
            g = np.array([np.sum((p - y) * z) + 1e-2 * (self.slope - 1), np.sum(p - y) + 1e-2 * self.shift])
            h = np.array([[np.sum(w * z * z) + 1e-2, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-2]])
            step = np.linalg.solve(h, g)
            self.slope, self.shift = max(0.05, self.slope - step[0]), self.shift - step[1]
            if np.abs(step).max() < 1e-6:
                break


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, part: float = 0.25, seed: int = 5) -> Boosted:
    """Logistic loss, second-order gains, the best split of each node by histogram, over a random ``part`` of the rows each round."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mid = (values[1:] + values[:-1]) / 2
        edges.append(mid if len(mid) < BINS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])))
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(edges, float(np.log(p / (1 - p))), [])
    b = model.binned(x).astype(np.int64)
    nf, z = b.shape[1], np.full(len(y), model.base)
    offset = np.arange(nf) * BINS
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        drawn = rng.random(len(y)) < part
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        n = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        at = np.zeros(len(y), np.int64)
        for node in range(n):
            here = np.flatnonzero(at == node)
            rows = here[drawn[here]]
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -rate * gs / (hs + l2)
            if node >= 2**depth - 1 or len(rows) < 10:
                continue
            flat = (b[rows] + offset).ravel()
            hg = np.bincount(flat, np.repeat(g[rows], nf), nf * BINS).reshape(nf, BINS).cumsum(1)
            hh = np.bincount(flat, np.repeat(h[rows], nf), nf * BINS).reshape(nf, BINS).cumsum(1)
            gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2)
            gain[(hh < 1e-2) | (hs - hh < 1e-2)] = -1
            k = int(gain.argmax())
            if gain.ravel()[k] <= gs**2 / (hs + l2) + 1e-3:
                continue
            feature[node], cut[node] = divmod(k, BINS)
            at[here] = 2 * node + 1 + (b[here, feature[node]] > cut[node])
        model.trees.append((feature, cut, value))
        z += value[at]
    return model
