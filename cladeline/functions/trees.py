"""Rooted trees as arrays: children by parent, levels, shape statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Tree:
    """parents[v] is v's parent (-1 at the root); lengths[v] belongs to the edge into v."""

    parents: np.ndarray
    lengths: np.ndarray
    labels: list[str] | None = None

    def __post_init__(self):
        self.parents = np.asarray(self.parents, np.int64)
        self.lengths = np.asarray(self.lengths, float)
        roots = np.flatnonzero(self.parents < 0)
        if len(roots) != 1:
            raise ValueError("a tree has one root")
        if len(self.lengths) != self.size:
            raise ValueError("one length for each node")
        self.root = int(roots[0])
        if len(self.topological) != self.size:
            raise ValueError("not a tree")

    @property
    def size(self) -> int:
        return len(self.parents)

    @cached_property
    def children(self) -> tuple[np.ndarray, np.ndarray]:
        """(nodes sorted by parent, where each parent's begin): node v's children are nodes[at[v]:at[v + 1]]."""
        nodes = np.argsort(self.parents, kind="stable")[1:]
        return nodes, np.searchsorted(self.parents[nodes], np.arange(self.size + 1))

    @cached_property
    def topological(self) -> np.ndarray:
        """Nodes by depth, the root first."""
        nodes, at = self.children
        level, out = np.array([self.root]), []
        while len(level):
            out.append(level)
            counts = at[level + 1] - at[level]
            level = nodes[np.repeat(at[level] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
        return np.concatenate(out)

    @cached_property
    def heights(self) -> np.ndarray:
        """Edges to the farthest leaf below."""
        h = np.zeros(self.size, np.int64)
        for v in self.topological[::-1]:
            p = self.parents[v]
            if p >= 0:
                h[p] = max(h[p], h[v] + 1)
        return h

    @cached_property
    def depths(self) -> np.ndarray:
        d = np.zeros(self.size, np.int64)
        for v in self.topological[1:]:
            d[v] = d[self.parents[v]] + 1
        return d

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bottom-up: (inner nodes of one height, their children, where each one's children begin)."""
        nodes, at = self.children
        out = []
        for h in range(1, int(self.heights[self.root]) + 1):
            inner = np.flatnonzero(self.heights == h)
            counts = at[inner + 1] - at[inner]
            begins = np.r_[0, np.cumsum(counts)[:-1]]
            out.append((inner, nodes[np.repeat(at[inner] - begins, counts) + np.arange(counts.sum())], begins))
        return out

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.heights == 0)

    def root_to_tip(self) -> np.ndarray:
        out = np.zeros(self.size)
        for v in self.topological[1:]:
            out[v] = out[self.parents[v]] + self.lengths[v]
        return out

    def shape(self) -> dict[str, float]:
        """binary, height, sackin, colless and normalised colless."""
        nodes, at = self.children
        below = (self.heights == 0).astype(np.int64)
        for v in self.topological[::-1]:
            if self.parents[v] >= 0:
                below[self.parents[v]] += below[v]
        counts = np.diff(at)
        inner = np.flatnonzero(counts > 0)
        two = inner[counts[inner] == 2]
        colless = int(np.abs(below[nodes[at[two]]] - below[nodes[at[two] + 1]]).sum())
        n = len(self.leaves)
        most = (n - 1) * (n - 2) // 2
        return {
            "leaves": n,
            "binary": bool((counts[inner] == 2).all()),
            "height": int(self.heights[self.root]),
            "sackin": int(self.depths[self.leaves].sum()),
            "colless": colless,
            "normalized_colless": colless / most if most else 0.0,
        }

    def clock_like(self, height: float) -> np.ndarray:
        """Branch lengths under which every longest path from the root to a tip has length ``height``."""
        h = self.heights
        out = np.zeros(self.size)
        v = np.flatnonzero(self.parents >= 0)
        out[v] = height * (h[self.parents[v]] - h[v]) / max(1, h[self.root])
        return out


def floor_lengths(lengths: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Lengths raised to ``least``, and how many were."""
    lengths = np.asarray(lengths, float)
    return np.maximum(lengths, least), int((lengths < least).sum())
