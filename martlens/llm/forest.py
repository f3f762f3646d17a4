"""Random-projection trees and their joint search, in numpy.

A tree is complete: node k has the children 2k + 1 and 2k + 2.  A node splits by the
projection on a random direction, at the median of the sample rows that reach it.
"""

from __future__ import annotations

import heapq

import numpy as np


class Forest:
    def __init__(self, directions: np.ndarray, cuts: np.ndarray):
        self.directions, self.cuts = directions, cuts  # trees x nodes (x dimensions)
        self.trees, self.nodes = cuts.shape
        self.leaves = self.nodes + 1

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 7) -> Forest:
        depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf_rows))))
        nodes, dim = 2**depth - 1, sample.shape[1]
        random = np.random.default_rng(seed)
        directions = random.standard_normal((trees, nodes, dim))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cuts = np.zeros((trees, nodes))
        for t in range(trees):
            rows = {0: np.arange(len(sample))} if nodes else {}
            for k in range(nodes):
                own = rows.pop(k)
                shadow = sample[own] @ directions[t, k]
                cuts[t, k] = np.median(shadow) if len(own) else 0.0
                right = shadow > cuts[t, k]
                rows[2 * k + 1], rows[2 * k + 2] = own[~right], own[right]
        return cls(directions, cuts)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, trees x vectors."""
        out = np.zeros((self.trees, len(vectors)), np.int64)
        for t in range(self.trees):
            at = out[t]
            while self.nodes and at[0] < self.nodes if len(at) else False:
                shadow = np.einsum("ij,ij->i", vectors, self.directions[t, at])
                at = 2 * at + 1 + (shadow > self.cuts[t, at])
            out[t] = at - self.nodes
        return out

    def search(self, query: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """The ``budget`` first leaves of all trees, from one queue.

        A branch waits with the sum of the squared distances to the cuts that it lies
        beyond; the nearest branch of any tree is opened first.
        """
        offsets = (self.directions @ query - self.cuts).tolist() if self.nodes else []
        queue = [(0.0, t, 0) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        nodes = self.nodes
        while queue and len(out) < budget:
            beyond, t, k = heapq.heappop(queue)
            own = offsets[t] if nodes else []
            while k < nodes:
                offset = own[k]
                near = 2 * k + 1 + (offset > 0)
                heapq.heappush(queue, (beyond + offset * offset, t, 4 * k + 3 - near))
                k = near
            out.append((t, k - nodes))
        return out
