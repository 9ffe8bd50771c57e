"""Cluster features: mergeable summaries of vectors, their trees and Ward's agglomeration of the leaves."""

from __future__ import annotations

import numpy as np


class FeatureTree:
    """A cluster-feature tree over unit vectors with at most ``most`` leaves, each a count and a sum of vectors.

    A vector joins the nearest leaf if it lies within ``radius`` of its mean, else it opens a leaf. With too many leaves the radius grows and
    the leaves are inserted anew, so trees of any two parts of the data merge into one of the same size.
    """

    def __init__(self, dims: int, most: int = 2048, radius: float = 0.35) -> None:
        self.most, self.radius = most, radius
        self.n = np.zeros(0)
        self.sums = np.zeros((0, dims))

    def add(self, n: np.ndarray, sums: np.ndarray) -> None:
        """Insert summaries; a vector is a summary of count 1."""
        for s in range(0, len(n), 1024):
            self._add(n[s : s + 1024], sums[s : s + 1024])

    def _add(self, n: np.ndarray, sums: np.ndarray) -> None:
        if len(self.n):
            means = (sums / n[:, None]).astype(np.float32)
            c = (self.sums / self.n[:, None]).astype(np.float32)
            d = (c * c).sum(1)[None] - 2 * means @ c.T
            k = d.argmin(1)
            near = d[np.arange(len(k)), k] + (means * means).sum(1) <= self.radius**2
            np.add.at(self.n, k[near], n[near])
            np.add.at(self.sums, k[near], sums[near])
            n, sums = n[~near], sums[~near]
        if not len(n):
            return
        means = (sums / n[:, None]).astype(np.float32)
        g = means @ means.T
        q = np.diag(g)
        close = q[:, None] + q[None] - 2 * g <= self.radius**2
        left, owner = np.ones(len(n), bool), np.full(len(n), -1)
        heads = []
        for i in range(len(n)):
            if left[i]:
                mine = close[i] & left
                mine[i] = True
                owner[mine] = len(heads)
                left &= ~mine
                heads.append(i)
        new_n, new_s = np.zeros(len(heads)), np.zeros((len(heads), sums.shape[1]))
        np.add.at(new_n, owner, n)
        np.add.at(new_s, owner, sums)
        self.n, self.sums = np.concatenate([self.n, new_n]), np.concatenate([self.sums, new_s])
        while len(self.n) > self.most:
            self.radius *= 1.15
            n, sums = self.n, self.sums
            order = np.argsort(-n, kind="stable")  # full leaves first, so that they stay
            self.n, self.sums = np.zeros(0), np.zeros((0, sums.shape[1]))
            most, self.most = self.most, len(n)
            self.add(n[order], sums[order])
            self.most = most


def ward(n: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """Ward's agglomeration of summaries down to ``k`` groups, by nearest-neighbour chains; the group of each summary."""
    m = len(n)
    if m <= k:
        return np.arange(m)
    n, c = n.astype(np.float64).copy(), (sums / n[:, None]).astype(np.float64)
    alive = np.ones(m, bool)
    joins: list[tuple[float, int, int]] = []
    chain: list[int] = []

    def costs(i: int) -> np.ndarray:
        d = ((c - c[i]) ** 2).sum(1) * (n * n[i] / (n + n[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            d = costs(chain[-1])
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        a, b = chain.pop(), chain.pop()
        joins.append((float(d[b]), a, b))
        keep, gone = min(a, b), max(a, b)
        c[keep] = (c[a] * n[a] + c[b] * n[b]) / (n[a] + n[b])
        n[keep] = n[a] + n[b]
        alive[gone] = False
    group = np.arange(m)
    joins.sort(key=lambda x: x[0])  # chains find the joins of the dendrogram, not their order
    for _, a, b in joins[: m - k]:
        ra, rb = a, b
        while group[ra] != ra:
            ra = group[ra]
        while group[rb] != rb:
            rb = group[rb]
        group[max(ra, rb)] = min(ra, rb)
    for i in range(m):
        group[i] = group[group[i]]
    return np.unique(group, return_inverse=True)[1]
