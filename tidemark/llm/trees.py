"""Small classification trees for models that are fitted on the driver from bounded tables."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int, leaf: int = 1,
         features: np.ndarray | None = None):
    """A nested tuple (feature, threshold, left, right), or a leaf's mean of ``y``.

    Rows with ``x[feature] <= threshold`` go left. Splits lower the Gini impurity most; ties go to
    the first feature and lowest threshold.
    """
    mean = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * leaf or mean in (0.0, 1.0):
        return mean
    best = (1e-12, None, None)
    whole = mean * (1 - mean) * len(y)
    for f in range(x.shape[1]) if features is None else features:
        order = np.argsort(x[:, f], kind="stable")
        v, cum = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = cum[:-1] / n, (cum[-1] - cum[:-1]) / (len(y) - n)
        gain = whole - left * (1 - left) * n - right * (1 - right) * (len(y) - n)
        gain[(v[1:] <= v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = -1
        if len(gain) and gain[k := int(gain.argmax())] > best[0]:
            best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
    _, f, t = best
    if f is None:
        return mean
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], depth - 1, leaf, features),
            grow(x[~low], y[~low], depth - 1, leaf, features))


def predict(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, tuple):
            out[at] = node
            continue
        low = x[at, node[0]] <= node[1]
        todo += [(node[2], at[low]), (node[3], at[~low])]
    return out


def paths(tree, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root, inner ones too, as conditions (feature, threshold, is above)."""
    if not isinstance(tree, tuple):
        return []
    f, t, low, high = tree
    out = []
    for side, above in ((low, False), (high, True)):
        here = (*so_far, (f, t, above))
        out += [here, *paths(side, here)]
    return out
