"""Small numeric helpers for per-session tasks: optimal assignment and average linkage."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairs (row, column) of least total cost; all of the shorter side is matched.

    Shortest augmenting paths with potentials.
    """
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # of each column, counted from 1; 0 is none
    for row in range(1, n + 1):
        owner[0], col = row, 0
        dist, done, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[col]:
            done[col] = True
            r = owner[col]
            slack = cost[r - 1] - u[r] - v[1:]
            open_ = ~done[1:]
            better = open_ & (slack < dist[1:])
            dist[1:][better], way[1:][better] = slack[better], col
            nxt = 1 + int(np.where(open_, dist[1:], np.inf).argmin())
            step = dist[nxt]
            u[owner[done]] += step
            v[done] -= step
            dist[1:][open_] -= step
            col = nxt
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def gated(cost: np.ndarray, gate: float) -> dict[int, int]:
    """As many one-to-one pairs (row to column) of at most ``gate`` as there can be, and of these pairings the cheapest."""
    if cost.size == 0:
        return {}
    beyond = 1.0 + gate * min(cost.shape)
    return {r: c for r, c in assignment(np.where(cost <= gate, cost, beyond)) if cost[r, c] <= gate}


def linkage_cuts(distances: np.ndarray, most: int, members: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Labels of average-linkage clusterings into 1 .. ``most`` clusters, numbered by first member; ``members`` a point stands for, 1 each by default."""
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if members is None else members.astype(float), np.arange(n)
    out = {}
    for left in range(n, 0, -1):
        if left <= most:
            out[left] = np.unique(label, return_inverse=True)[1]
        if left == 1:
            break
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        d[a] = d[:, a] = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        d[a, a] = d[b] = d[:, b] = np.inf
        label[label == b] = a
    return out
