"""Gradient-boosted trees for a yes-no label, fitted on a bounded table and applied to arrays in tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # of each inner node, children of node i are 2i+1 and 2i+2
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.leaf)))):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return self.leaf[node - len(self.feature)]


@dataclass
class Boosted:
    bias: float
    trees: list[Tree]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes."""
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += tree(x)
        return out


def _tree(codes, flags, cuts, grad, hess, depth, rate, ridge) -> tuple[Tree, np.ndarray]:
    """``flags`` are the columns with two values, whose sums per node are one matrix product."""
    n, f = codes.shape
    bins = max((len(c) for c in cuts), default=0) + 1
    two = np.array([len(c) == 1 for c in cuts], bool)
    flag_at, other = np.flatnonzero(two), [j for j in range(f) if len(cuts[j]) > 1]
    node = np.zeros(n, np.int64)
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)

    def gains(gl, hl, gt, ht):
        won = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        won[(hl < 1) | (ht - hl < 1)] = 0
        return won

    for level in range(depth):
        first, width = 2**level - 1, 2**level
        local = node - first
        here = np.zeros((n, 2 * width))
        here[np.arange(n), local], here[np.arange(n), width + local] = grad, hess
        gt, ht = np.split(here.sum(0), 2)
        gain, split = np.full(width, 1e-9), [(0, bins)] * width
        if len(flag_at):
            up = flags.T @ here
            won = gains(gt - up[:, :width], ht - up[:, width:], gt, ht)
            best = won.argmax(0)
            for w in np.flatnonzero(won[best, np.arange(width)] > gain):
                gain[w], split[w] = won[best[w], w], (int(flag_at[best[w]]), 0)
        for j in other:
            key = local * bins + codes[:, j]
            gl = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)
            hl = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(1)
            won = gains(gl, hl, gt[:, None], ht[:, None])
            best = won.argmax(1)
            for w in np.flatnonzero(won[np.arange(width), best] > gain):
                gain[w], split[w] = won[w, best[w]], (j, int(best[w]))
        go = np.zeros(n, bool)
        for w, (j, b) in enumerate(split):
            if b < len(cuts[j]):
                at = local == w
                feature[first + w], cut[first + w] = j, cuts[j][b]
                go[at] = codes[at, j] > b
        node = 2 * node + 1 + go
    place = node - (2**depth - 1)
    leaf = -rate * np.bincount(place, grad, 2**depth) / (np.bincount(place, hess, 2**depth) + ridge)
    return Tree(feature, cut, leaf), leaf[place]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, bins: int = 16) -> Boosted:
    """Logistic loss, second-order leaves, splits at quantiles of the values that occur."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        mid = (values[1:] + values[:-1]) / 2
        cuts.append(mid if len(mid) < bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins - 1))))
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)
    flags = codes[:, [len(c) == 1 for c in cuts]].astype(np.float64)
    share = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    score = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree, step = _tree(codes, flags, cuts, p - y, p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        score += step
    return model
