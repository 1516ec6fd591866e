"""Gradient-boosted trees for a binary target, trained in numpy on binned features and scored as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees, one row a tree; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values: every row walks down all trees at once, a level a step."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                go = part[rows, self.feature[trees, node]] <= self.threshold[trees, node]
                node = np.where(go, self.left[trees, node], self.right[trees, node])
            out[at : at + 8192] = self.start + self.value[trees, node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0, monotone: dict[int, int] | None = None) -> Trees:
    """Trees for P(y = 1) under logistic loss.

    monotone gives features in which the score may only rise (1) or fall (-1): a split against it is not taken, and
    the midpoint of its sides' values bounds what lies below either side.
    """
    x, y, monotone = np.asarray(x, float), np.asarray(y, float), monotone or {}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    width = max((len(c) for c in cuts), default=0) + 1
    flat = binned + width * np.arange(x.shape[1])
    cut_here = np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None]
    ways = np.array([monotone.get(f, 0) for f in range(x.shape[1])])[:, None]
    rate_of_one = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(rate_of_one / (1 - rate_of_one)))
    score, size = np.full(len(y), start), 2 ** (depth + 1) - 1
    out = Trees(np.zeros((trees, size), np.int64), np.zeros((trees, size)), np.tile(np.arange(size), (trees, 1)), np.tile(np.arange(size), (trees, 1)), np.zeros((trees, size)), depth, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        todo = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            own = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) > 1:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                at = flat[rows].ravel()
                sum_g = np.cumsum(np.bincount(at, np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width), 1)[:, :-1]
                sum_h = np.cumsum(np.bincount(at, np.repeat(h[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width), 1)[:, :-1]
                lv = np.clip(-sum_g / (sum_h + l2), low, high)
                rv = np.clip(-(total_g - sum_g) / (total_h - sum_h + l2), low, high)
                gain = sum_g**2 / (sum_h + l2) + (total_g - sum_g) ** 2 / (total_h - sum_h + l2) - total_g**2 / (total_h + l2)
                ok = cut_here & (sum_h >= least) & (total_h - sum_h >= least) & (ways * (rv - lv) >= 0)
                gain = np.where(ok, gain, -1)
                f, k = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, k] > best[0]:
                    best = float(gain[f, k]), (int(f), int(k), float(lv[f, k]), float(rv[f, k]))
            if best[1] is None:
                out.value[t, node] = rate * own
                score[rows] += rate * own
                continue
            f, k, lv, rv = best[1]
            out.feature[t, node], out.threshold[t, node] = f, cuts[f][k]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            middle, way = (lv + rv) / 2, monotone.get(f, 0)
            go = binned[rows, f] <= k
            todo.append((2 * node + 1, rows[go], level + 1, middle if way < 0 else low, middle if way > 0 else high))
            todo.append((2 * node + 2, rows[~go], level + 1, middle if way > 0 else low, middle if way < 0 else high))
    return out
