"""Gradient-boosted trees for small feature tables: logistic loss, binned splits. Trained on bounded samples."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST, PENALTY = 40, 3, 0.3, 24, 4.0, 1.0


def _grow(x: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
    g, h = grad[rows].sum(), curve[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST:
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            bin_ = np.searchsorted(cuts, x[rows, f], "left")
            gs, hs, n = (np.bincount(bin_, w, len(cuts) + 1).cumsum()[:-1] for w in (grad[rows], curve[rows], None))
            gain = gs**2 / (hs + PENALTY) + (g - gs) ** 2 / (h - hs + PENALTY) - g**2 / (h + PENALTY)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, cuts[i])
    if best[1] is None:
        return (-RATE * g / (h + PENALTY),)
    left = x[rows, best[1]] <= best[2]
    return (best[1], float(best[2]), _grow(x, edges, grad, curve, rows[left], depth - 1), _grow(x, edges, grad, curve, rows[~left], depth - 1))


def _leaf(tree: tuple, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += tree[0]
    elif len(rows):
        left = x[rows, tree[0]] <= tree[1]
        _leaf(tree[2], x, out, rows[left])
        _leaf(tree[3], x, out, rows[~left])


def margins(model: tuple, x: np.ndarray) -> np.ndarray:
    base, trees = model
    out = np.full(len(x), base)
    for t in trees:
        _leaf(t, x, out, np.arange(len(x)))
    return out


def probabilities(model: tuple, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(model, x), -35, 35)))


def train(x: np.ndarray, y: np.ndarray) -> tuple:
    """(base, trees) for features x and labels y (0 or 1, both present)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    trees: list[tuple] = []
    out = np.full(len(x), base)
    rows = np.arange(len(x))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        tree = _grow(x, edges, p - y, p * (1 - p), rows, DEPTH)
        trees.append(tree)
        _leaf(tree, x, out, rows)
    return base, trees
