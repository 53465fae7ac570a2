"""A small binary decision tree on numeric features, by Gini impurity."""

from __future__ import annotations

import numpy as np

Tree = tuple  # (feature, cut, below, above), or (share of ones,)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """Fits a tree; ties go to the first feature and lowest cut, so equal tables give equal trees."""
    n, ones = len(y), int(y.sum())
    if depth == 0 or n < 2 * least or ones in (0, n):
        return (ones / n,)
    best = (1e-12, None, 0.0)
    whole = 2 * ones * (n - ones) / n
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hit = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        size = cut + 1
        ok = (size >= least) & (n - size >= least)
        cut, size = cut[ok], size[ok]
        if not len(cut):
            continue
        a, b = hit[cut], ones - hit[cut]
        gain = whole - 2 * a * (size - a) / size - 2 * b * (n - size - b) / (n - size)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[1] is None:
        return (ones / n,)
    _, f, c = best
    low = x[:, f] <= c
    return (f, c, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def share(tree: Tree, row) -> float:
    """The share of ones in the leaf of ``row``."""
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]
