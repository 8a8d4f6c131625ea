"""Gradient-boosted trees on dense features, and isotonic calibration, in NumPy.

Features are cut into bins once; trees of one fixed depth grow level by level on histograms of gradients. Equal binned
rows of equal label are one row with a weight, so a fit costs what its distinct rows cost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 12


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Rising upper edges of the bins of every feature: midpoints between its quantiles among the distinct values."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        out.append(np.unique(np.concatenate((mid[:1], np.quantile(v, np.linspace(0, 1, bins)[1:-1])))) if len(mid) >= bins else mid)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bin numbers; a value on an edge belongs below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


@dataclass
class Boosted:
    """Log-odds = prior + sum of leaves. A tree of depth d has 2**d - 1 splits (feature, bin) in heap order and 2**d leaves."""

    edges: list[np.ndarray]
    prior: float
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def used(self) -> list[int]:
        """The features that any tree splits on."""
        return sorted({int(j) for f, c in zip(self.feature, self.cut, strict=True) for j, b in zip(f, c, strict=True) if b < 255})

    def _sum(self, xb: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(xb), self.prior), np.arange(len(xb))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(xb), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (xb[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row; rows that no split tells apart are looked up once."""
        columns = self.used()
        if not columns or not len(x):
            return np.full(len(x), self.prior + sum(float(v[0]) for v in self.leaf))
        xb = np.zeros((len(x), len(self.edges)), dtype=np.uint8)
        key = np.zeros(len(x), dtype=np.uint64)
        for j in columns:
            cuts = np.unique([b for f, c in zip(self.feature, self.cut, strict=True) for k, b in zip(f, c, strict=True) if k == j and b < 255])
            rank = np.searchsorted(self.edges[j][cuts], x[:, j], side="left")
            xb[:, j] = np.append(cuts, 254)[rank]
            key = (key ^ rank.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return self._sum(xb[first])[inverse]


def boost(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 24, rate: float = 0.3, depth: int = 3, min_weight: float = 1.0, ridge: float = 1.0
) -> Boosted:
    """Logistic gradient boosting with row weights; one class alone gives no trees.

    A leaf holds ``min_weight`` of the weight at least.
    """
    w = np.ones(len(y)) if weight is None else weight.astype(np.float64)
    total, good = w.sum(), (w * y).sum()
    model = Boosted(bin_edges(x), float(np.log((good + 0.5) / (total - good + 0.5))), depth)
    if not len(y) or y.min() == y.max():
        return model
    xb = binned(x, model.edges)
    key = y.astype(np.uint64)
    for j in range(xb.shape[1]):
        key = (key ^ xb[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    w = np.bincount(inverse, weights=w, minlength=len(first))
    y, xb = y[first].astype(np.float64), xb[first]
    n, width = xb.shape
    bins = int(xb.max(initial=0)) + 1
    cells = width * bins
    at = xb.astype(np.int64) + np.arange(width) * bins
    live = np.array([len(e) > 0 for e in model.edges])
    f = np.full(n, model.prior)
    for _ in range(rounds):
        p = sigmoid(f)
        g, h = w * (p - y), w * p * (1 - p)
        features, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255, dtype=np.int64)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            size = 2**level
            key = (node[:, None] * cells + at).ravel()
            gs, hs, ws = (np.bincount(key, weights=np.repeat(v, width), minlength=size * cells).reshape(size, width, bins).cumsum(axis=2) for v in (g, h, w))
            gt, ht, wt = (v[:, :1, -1:] for v in (gs, hs, ws))
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ws < min_weight) | (wt - ws < min_weight)] = -np.inf
            gain[:, ~live] = -np.inf
            best = gain.reshape(size, -1).argmax(axis=1)
            offset = size - 1
            ok = gain.reshape(size, -1)[np.arange(size), best] > 1e-6
            features[offset : offset + size] = np.where(ok, best // bins, 0)
            cuts[offset : offset + size] = np.where(ok, best % bins, 255)
            heap = node + offset
            node = 2 * node + (xb[np.arange(n), features[heap]] > cuts[heap])
        leaf = -rate * np.bincount(node, weights=g, minlength=2**depth) / (np.bincount(node, weights=h, minlength=2**depth) + ridge)
        model.feature.append(features)
        model.cut.append(cuts)
        model.leaf.append(leaf)
        f += leaf[node]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, negative_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): the non-decreasing step fit of y by score, pooled over adjacent violators.

    Every negative counts ``negative_weight`` times. One positive and one negative are added at the ends, so that probabilities stay off 0 and 1.
    """
    order = np.argsort(score, kind="stable")
    s = np.concatenate(([score.min(initial=0) - 1], score[order], [score.max(initial=0) + 1]))
    v = np.concatenate(([0.0], y[order], [1.0]))
    blocks: list[list[float]] = []  # first score, last score, sum, count
    for a, b in zip(s.tolist(), v.tolist(), strict=True):
        weight = b + (1.0 - b) * negative_weight
        blocks.append([a, a, b, weight])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = np.array([e for b in blocks for e in (b[0], b[1])])
    ps = np.array([b[2] / b[3] for b in blocks for _ in range(2)])
    return xs, ps


def calibrate(score: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities of scores, linear between the steps."""
    return np.interp(score, steps[0], steps[1])
