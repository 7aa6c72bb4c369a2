"""Maximum-weight assignment on a small dense matrix."""

from __future__ import annotations

import numpy as np


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the greatest total weight.

    Every row of the shorter dimension is assigned; pairs of weight 0 are left
    out of the result. Shortest augmenting paths with potentials, O(n^2 m).
    """
    w = np.asarray(weights, dtype=float)
    if w.size == 0:
        return []
    flipped = w.shape[0] > w.shape[1]
    if flipped:
        w = w.T
    n, m = w.shape
    cost = w.max() - w
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    way = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            free = ~used[1:]
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (cur < best[1:])
            best[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.where(free, best[1:], np.inf).argmin()) + 1
            delta = best[j1]
            u[match[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and w[match[j] - 1, j - 1] > 0]
    return sorted((b, a) for a, b in pairs) if flipped else sorted(pairs)
