"""Gradient-boosted trees with monotonic constraints, flattened into node arrays.

Histogram splits on quantile bins, second-order logistic loss. For a constrained feature a split is
allowed only if the two values keep its direction, and the midpoint bounds all values below, so
the whole ensemble is monotone in the feature. Scoring walks all trees of all rows level by level
with array indexing; no row or tree is visited by a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees: a leaf is its own child, so walking ``depth`` steps ends at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(np.asarray(x, float))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Fit to labels 0/1; ``monotone`` has -1, 0 or 1 per feature. One class or no rows give a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        coded = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
        raw = np.full(n, bias)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            g, h = grad[rows], hess[rows]
            total_g, total_h = g.sum(), h.sum()
            nodes.append([0, np.inf, me, me, rate * float(np.clip(-total_g / (total_h + ridge), low, high))])
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for f in range(width):
                    size = len(edges[f]) + 1
                    if size < 2:
                        continue
                    code = coded[rows, f]
                    gl = np.cumsum(np.bincount(code, g, size))[:-1]
                    hl = np.cumsum(np.bincount(code, h, size))[:-1]
                    nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                    vl = np.clip(-gl / (hl + ridge), low, high)
                    vr = np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
                    score = lambda gg, hh, v: -(gg * v + 0.5 * (hh + ridge) * v * v)
                    gain = score(gl, hl, vl) + score(total_g - gl, total_h - hl, vr) - score(total_g, total_h, np.clip(-total_g / (total_h + ridge), low, high))
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    if monotone[f]:
                        ok &= (vr - vl) * monotone[f] >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            if best[1] >= 0:
                _, f, k, vl, vr = best
                mask = coded[rows, f] <= k
                mid = (vl + vr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[f])]
                nodes[me][0], nodes[me][1] = f, float(edges[f][k])
                nodes[me][2] = grow(rows[mask], level + 1, *bounds[0])
                nodes[me][3] = grow(rows[~mask], level + 1, *bounds[1])
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            first = len(nodes)
            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            tree = _flat(nodes, [first], depth, 0.0)
            raw = raw + tree.raw(x)
    return _flat(nodes, roots, depth, bias)


def _flat(nodes: list, roots: list[int], depth: int, bias: float) -> Forest:
    table = np.array(nodes, float).reshape(-1, 5)
    whole = lambda k: table[:, k].astype(np.int64)
    return Forest(whole(0), table[:, 1], whole(2), whole(3), table[:, 4], np.array(roots, np.int64), depth, bias)
