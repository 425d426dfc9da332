"""Gradient-boosted regression trees for two classes, small and in numpy: trained on the driver, applied in tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ledgerwork.llm.labelled import sigmoid

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Trees of equal depth: node k has the children 2k+1 and 2k+2; leaves hold log-odds."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - inner]
        return out


def train(x: np.ndarray, label: np.ndarray, trees: int, depth: int, rate: float, least: float = 5.0) -> Trees:
    """Newton boosting on binned features; a split needs `least` rows' worth of curvature on either side."""
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(b, column, "left") for b, column in zip(bounds, x.T, strict=True)])
    n, columns = binned.shape
    flat = binned + np.arange(columns) * BINS
    mean = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    odds = np.full(n, start)
    inner = 2**depth - 1
    feature, bound = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = sigmoid(odds)
        slope, curve = label - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                split = _best_split(flat[rows], slope[rows], curve[rows], columns, least)
                if split is not None:
                    column, cut = split
                    if cut < len(bounds[column]):
                        feature[t, node], bound[t, node] = column, bounds[column][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > bound[t, at])
        g = np.bincount(at - inner, slope, inner + 1)
        h = np.bincount(at - inner, curve, inner + 1)
        leaf[t] = rate * g / (h + 1)
        odds += leaf[t, at - inner]
    return Trees(start, feature, bound, leaf)


def _best_split(flat: np.ndarray, slope: np.ndarray, curve: np.ndarray, columns: int, least: float):
    if len(flat) < 2:
        return None
    where = flat.ravel()
    g = np.bincount(where, np.repeat(slope, columns), columns * BINS).reshape(columns, BINS).cumsum(axis=1)
    h = np.bincount(where, np.repeat(curve, columns), columns * BINS).reshape(columns, BINS).cumsum(axis=1)
    all_g, all_h = g[:, -1:], h[:, -1:]
    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
    gain[(h < least * 0.25) | (all_h - h < least * 0.25)] = -1
    best = int(np.argmax(gain))
    return divmod(best, BINS) if gain.flat[best] > 1e-6 else None
