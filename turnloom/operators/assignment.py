"""Linear assignment for small dense matrices, with a fixed choice among equal optima."""

from __future__ import annotations

import numpy as np


def _least(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least cost; rows <= columns. Shortest augmenting paths with potentials, O(n^2 m)."""
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while True:
            gap = cost[row] - u[row] - v
            base = 0.0 if col < 0 else reach[col]
            better = ~done & (base + gap < reach)
            reach[better], via[better] = base + gap[better], col
            col = int(np.where(done, np.inf, reach).argmin())
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        end = reach[col]
        settled = done & (np.arange(m) != col)
        u[i] += end
        u[row_of[settled]] += end - reach[settled]
        v[settled] -= end - reach[settled]
        while col >= 0:
            prev = via[col]
            row_of[col] = i if prev < 0 else row_of[prev]
            col = prev
    out = np.empty(n, int)
    for c in np.flatnonzero(row_of >= 0):
        out[row_of[c]] = c
    return out


def assign(cost: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Column of each row (rows <= columns), least cost in total; of equal optima the first in lexicographic order."""
    n, m = cost.shape
    if not n:
        return []
    cost = np.asarray(cost, float)
    total = cost[np.arange(n), _least(cost)].sum()
    chosen: list[int] = []
    spent = 0.0
    for i in range(n):
        for c in range(m):
            if c in chosen:
                continue
            free = [k for k in range(m) if k != c and k not in chosen]
            rest = cost[i + 1 :][:, free]
            low = rest[np.arange(len(rest)), _least(rest)].sum() if len(rest) else 0.0
            if spent + cost[i, c] + low <= total + tolerance:
                chosen.append(c)
                spent += cost[i, c]
                break
    return chosen


def best_mapping(overlap: dict[tuple[str, str], float]) -> dict[str, str]:
    """Second to first speakers, one to one, with the most overlap in total; only speakers that overlap someone take part."""
    first, second = sorted({a for a, _ in overlap}), sorted({b for _, b in overlap})
    if not first:
        return {}
    gain = np.array([[overlap.get((a, b), 0.0) for b in second] for a in first])
    if len(second) <= len(first):
        return {second[j]: first[i] for j, i in enumerate(assign(-gain.T))}
    return {second[j]: first[i] for i, j in enumerate(assign(-gain))}
