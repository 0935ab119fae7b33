"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Perfect binary trees of one depth: inner node k has children 2k+1 and 2k+2; `value` holds the leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # go right where the feature is above it
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees at once: one gather a level."""
        n, (trees, inner) = len(x), self.feature.shape
        if not n or not trees:
            return np.full(n, self.base)
        row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        node = np.zeros((n, trees), np.int32)
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.bound[tree, node])
        return self.base + self.value[tree, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for k in range(0, len(x), 4096):
            out[k : k + 4096] = 1 / (1 + np.exp(-np.clip(self.margin(x[k : k + 4096]), -35, 35)))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.15, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Newton boosting on log loss. Without rows, or with one class, the model is the (smoothed) rate of label 1."""
    inner, leaves = 2**depth - 1, 2**depth
    rate1 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate1 / (1 - rate1)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.int32)  # bin k: up to cuts[k]
    place = code + np.arange(width, dtype=np.int32) * bins
    open_cut = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    score = np.full(n, base)
    features, bounds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int32)
        feature, bound = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            slot = ((node - first) * (width * bins))[:, None] + place
            hg, hh = (np.bincount(slot.ravel(), np.repeat(v, width), wide * width * bins).reshape(wide, width, bins) for v in (g, h))
            lg, lh = hg.cumsum(2), hh.cumsum(2)
            tg, th = lg[:, :1, -1:], lh[:, :1, -1:]
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain = np.where(open_cut & (lh >= least * 0.1) & (th - lh >= least * 0.1), gain, -np.inf).reshape(wide, -1)
            best = gain.argmax(1)
            good = gain[np.arange(wide), best] > 1e-6
            at = first + np.arange(wide)
            feature[at] = np.where(good, best // bins, 0)
            split = np.where(good, best % bins, bins)
            bound[at] = [cuts[f][s] if ok else np.inf for f, s, ok in zip(feature[at], split, good, strict=True)]
            k = node - first
            node = 2 * node + 1 + (code[np.arange(n), feature[node]] > split[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score += value[leaf]
        features.append(feature), bounds.append(bound), values.append(value)
    return Trees(base, np.stack(features), np.stack(bounds), np.stack(values))
