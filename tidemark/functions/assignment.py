"""Small exact solvers: minimum-cost matching and Ward clustering."""

from __future__ import annotations

import numpy as np


def match(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of min(rows, columns) pairs with least total cost, by rows.

    Dynamic programming over subsets of the shorter side; meant for a handful of states.
    """
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in match(cost.T))
    rows, cols = cost.shape
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for r in range(rows):
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for c in range(cols):
                if not used >> c & 1:
                    x = total + cost[r, c]
                    key = used | 1 << c
                    if key not in new or x < new[key][0]:
                        new[key] = x, (*chosen, c)
        best = new
    return list(enumerate(min(best.values())[1])) if rows else []


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of the Ward tree cut into k clusters, numbered by the tree from its left (earlier) branches on.

    Nearest-neighbour chains on squared distances with the Lance-Williams update: O(n^2) time and memory.
    """
    n = len(x)
    k = min(k, n)
    if n == 1 or k == n:
        return np.arange(n)
    sq = (x**2).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    active = np.ones(n, bool)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        while True:
            a = chain[-1]
            row = np.where(active, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((d[a, b], a, b))
        other = active.copy()
        other[[a, b]] = False
        na, nb, no = size[a], size[b], size[other]
        new = ((na + no) * d[a, other] + (nb + no) * d[b, other] - no * d[a, b]) / (na + nb + no)
        d[b, other] = new
        d[other, b] = new
        size[b] += na
        active[a] = False
        d[a, :] = d[:, a] = np.inf
    merges.sort(key=lambda m: m[0])
    parent = list(range(n))
    node = list(range(n))  # name of the tree node that a set is: leaves 0..n-1, merges from n on

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    children: dict[int, tuple[int, int]] = {}
    for step, (_, a, b) in enumerate(merges):
        ra, rb = root(a), root(b)
        children[n + step] = tuple(sorted((node[ra], node[rb])))
        parent[ra] = rb
        node[rb] = n + step
    labels, number = np.empty(n, np.int64), -1
    todo = [(2 * n - 2, False)]
    while todo:
        i, inside = todo.pop()
        if not inside and i < 2 * n - k:  # nodes of the first n - k merges, and leaves, are whole clusters
            number += 1
            inside = True
        if i < n:
            labels[i] = number
        else:
            a, b = children[i]
            todo += [(b, inside), (a, inside)]
    return labels


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 10, max_iter: int = 300) -> np.ndarray:
    """Labels of the best of ``n_init`` runs from spread-out starts."""
    best, out = np.inf, None
    for i in range(n_init):
        rng = np.random.default_rng([seed, i])
        centres = x[rng.integers(len(x))][None]
        while len(centres) < k:
            gap = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            pick = rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[pick]])
        for _ in range(max_iter):
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            labels = d.argmin(1)
            new = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres, rtol=0, atol=1e-12):
                break
            centres = new
        inertia = d.min(1).sum()
        if inertia < best:
            best, out = inertia, labels
    return out
