"""Gradient-boosted regression trees for the logistic loss on small, bounded training sets, with Platt calibration."""

from __future__ import annotations

import numpy as np


def _grow(x, g, h, depth: int, least: float) -> list:
    """A tree as nested [feature, cut, left, right], leaves as their value."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return [value]
    best, total_g, total_h = (1e-6, None, None), g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        ok = (v[1:] > v[:-1]) & (ch >= least) & (total_h - ch >= least)
        if ok.any():
            gain = np.where(ok, cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return [value]
    left = x[:, best[1]] < best[2]
    return [best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, least), _grow(x[~left], g[~left], h[~left], depth - 1, least)]


def _tree(node: list, x) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), node[0])
    left, out = x[:, node[0]] < node[1], np.empty(len(x))
    out[left], out[~left] = _tree(node[2], x[left]), _tree(node[3], x[~left])
    return out


def raw(model: dict, x) -> np.ndarray:
    return model["base"] + model["rate"] * sum((_tree(t, x) for t in model["trees"]), np.zeros(len(x)))


def probability(model: dict, x) -> np.ndarray:
    """Calibrated probability of each row of features."""
    a, b = model["platt"]
    return 1 / (1 + np.exp(-(a * raw(model, x) + b)))


def fit(x, y, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0, seed: int = 10) -> dict:
    """Trees on three quarters of the rows, the calibration on the rest."""
    rest = np.random.default_rng(seed).permutation(len(x)) % 4 == 0
    tx, ty = x[~rest], y[~rest]
    base = float(np.log((ty.sum() + 1) / (len(ty) - ty.sum() + 1)))
    model = {"base": base, "rate": rate, "trees": [], "platt": (1.0, 0.0)}
    score = np.full(len(tx), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        model["trees"].append(t := _grow(tx, p - ty, p * (1 - p), depth, least))
        score += rate * _tree(t, tx)
    s, a, b = raw(model, x[rest]), 1.0, 0.0
    soft = (y[rest] * (y[rest].sum() + 1) + (1 - y[rest])) / (y[rest].sum() + 2)  # Platt's smoothed targets
    for _ in range(200):
        d = 1 / (1 + np.exp(-(a * s + b))) - soft
        a, b = a - 0.05 * float((d * s).mean()), b - 0.05 * float(d.mean())
    return model | {"platt": (a, b), "held": (x[rest], y[rest])}
