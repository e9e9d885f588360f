"""Gradient-boosted regression trees of depth two for binary labels, small enough to be fitted on the driver.

Fitted on bounded samples only; a fitted model is a list of plain tuples and travels with the function that uses it.
"""

from __future__ import annotations

import math

import numpy as np

Node = tuple  # (feature, threshold, left, right) or a float


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], penalty: float) -> tuple[float, int, float]:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + penalty)
    best = (1e-6, -1, 0.0)
    for f, edges in enumerate(cuts):
        place = np.searchsorted(edges, x[rows, f], side="right")
        left_g = np.cumsum(np.bincount(place, g[rows], len(edges) + 1))[:-1]
        left_h = np.cumsum(np.bincount(place, h[rows], len(edges) + 1))[:-1]
        gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - base
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float(edges[k]))
    return best


def _grow(x, g, h, rows, cuts, depth, penalty):
    leaf = float(-g[rows].sum() / (h[rows].sum() + penalty))
    if not depth or len(rows) < 8:
        return leaf
    _, f, edge = _best(x, g, h, rows, cuts, penalty)
    if f < 0:
        return leaf
    low = x[rows, f] < edge
    if not low.any() or low.all():
        return leaf
    return (f, edge, _grow(x, g, h, rows[low], cuts, depth - 1, penalty), _grow(x, g, h, rows[~low], cuts, depth - 1, penalty))


def fit(x: list[list[float]], y: list[int], rounds: int = 40, depth: int = 2, rate: float = 0.3, bins: int = 24, penalty: float = 1.0) -> list[Node]:
    """Trees whose sum is the log odds of label 1. No rows or a single label give a constant."""
    if not y:
        return [0.0]
    a, b = np.asarray(x, float), np.asarray(y, float)
    share = min(max(b.mean(), 1e-3), 1 - 1e-3)
    trees: list[Node] = [math.log(share / (1 - share))]
    if b.min() == b.max():
        return trees
    cuts = [np.unique(np.quantile(a[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(a.shape[1])]
    cuts = [np.unique(np.concatenate([c, [np.nextafter(v, np.inf) for v in c]])) for c in cuts]
    score = np.full(len(b), trees[0])
    rows = np.arange(len(b))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _shrink(_grow(a, p - b, p * (1 - p) + 1e-9, rows, cuts, depth, penalty), rate)
        trees.append(tree)
        score += np.array([_walk(tree, r) for r in a])
    return trees


def _shrink(node: Node, rate: float) -> Node:
    return node * rate if not isinstance(node, tuple) else (node[0], node[1], _shrink(node[2], rate), _shrink(node[3], rate))


def _walk(node: Node, row) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node


def probability(trees: list[Node], row) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(_walk(t, row) for t in trees)))))
