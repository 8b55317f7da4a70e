"""Shortest paths of a block of searches over one mesh, on arrays inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Edges relaxed at once, and distances held at once.
EDGES, CELLS = 1 << 20, 1 << 24


@dataclass
class Mesh:
    """Outgoing edges by vertex: those of ``ids[i]`` lie at ``offsets[i]:offsets[i + 1]``."""

    ids: np.ndarray
    offsets: np.ndarray
    to: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray, w: np.ndarray, others: np.ndarray) -> Mesh:
        """``others`` are vertices that belong to the mesh even without an edge."""
        if (w < 0).any():
            raise ValueError("an edge has a negative length")
        ids = np.unique(np.concatenate([src, dst, others]))
        s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.argsort(s, kind="stable")
        return cls(ids, np.searchsorted(s[order], np.arange(len(ids) + 1)), d[order], np.asarray(w, float)[order])

    def place(self, vertices: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, vertices)


def search(mesh: Mesh, rows: np.ndarray, starts: np.ndarray, n_rows: int, wanted: np.ndarray | None = None, limit: float = np.inf) -> tuple[np.ndarray, int]:
    """Distances ``(n_rows, vertices)`` from each row's start places, and how many edges were relaxed.

    All rows advance together in buckets one mean edge wide: a bucket is worked
    until nothing below its upper end improves, so what lies below is final and is
    never visited again. ``wanted`` (places) ends a row once those are final; its
    other entries may then be too large or infinite. Places beyond ``limit`` stay
    infinite. Besides the distances a search holds its open places and ``EDGES``
    edges, however many hops the mesh is wide.
    """
    n = len(mesh.ids)
    dist, waiting = np.full(n_rows * n, np.inf), np.zeros(n_rows * n, bool)
    queue = np.unique(rows * n + starts)
    dist[queue], waiting[queue] = 0.0, True
    usual = mesh.cost[np.isfinite(mesh.cost) & (mesh.cost > 0)]
    width = usual.mean() if len(usual) else 1.0
    asked = np.zeros(n, bool)
    left = np.full(n_rows, n + 1)
    if wanted is not None:
        asked[wanted] = True
        left[:] = asked.sum()
        queue = queue[left[queue // n] > 0]
    relaxed = 0
    while len(queue):
        low = dist[queue].min()
        bound, passed = max(low + width, np.nextafter(low, np.inf)), []
        while True:
            near = dist[queue] < bound
            now, queue = queue[near], queue[~near]
            if not len(now):
                break
            waiting[now] = False
            passed.append(now)
            better, used = _relax(mesh, dist, now, n, limit)
            relaxed += used
            better = better[~waiting[better]]
            waiting[better] = True
            queue = np.concatenate([queue, better])
        if wanted is not None:
            final = np.unique(np.concatenate(passed))
            left -= np.bincount(final[asked[final % n]] // n, minlength=n_rows)
            queue = queue[left[queue // n] > 0]
    return dist.reshape(n_rows, n), relaxed


def _relax(mesh: Mesh, dist: np.ndarray, now: np.ndarray, n: int, limit: float) -> tuple[np.ndarray, int]:
    """Lower what the edges out of ``now`` reach; returns the places that improved."""
    degree = mesh.offsets[now % n + 1] - mesh.offsets[now % n]
    total = np.cumsum(degree)
    improved = []
    for part in np.split(np.arange(len(now)), np.unique(np.searchsorted(total, np.arange(EDGES, total[-1], EDGES)))):
        if not len(part):
            continue
        at, k = now[part], degree[part]
        first = mesh.offsets[at % n] - (np.cumsum(k) - k)
        edge = np.repeat(first, k) + np.arange(k.sum())
        target = np.repeat(at - at % n, k) + mesh.to[edge]
        d = np.repeat(dist[at], k) + mesh.cost[edge]
        ok = (d < dist[target]) & (d <= limit)
        np.minimum.at(dist, target[ok], d[ok])
        improved.append(target[ok])
    return np.unique(np.concatenate(improved)), int(total[-1])
