"""The assignment of one subject's vertices, as arrays over its mesh.

A mesh bounds these arrays whatever the size of the cohort: candidate cells,
neighbour links and coordinates of one subject. Tasks hold one subject at a time;
the observations never come here, only their products with the centroids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from surfparc.functions.special import cdln
from surfparc.functions.vectors import LOG_FLOOR


@dataclass
class Mesh:
    """Vertices in id order; ``src, dst`` are places of the ends of edges between active vertices."""

    ids: np.ndarray
    xyz: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    gradient: np.ndarray

    @classmethod
    def from_row(cls, row: pd.Series) -> Mesh:
        ids = np.asarray(row["ids"], np.int64)
        xyz = np.stack([np.asarray(row[c], float) for c in "xyz"], 1)
        return cls(ids, xyz, np.asarray(row["src"], np.int64), np.asarray(row["dst"], np.int64), np.asarray(row["gradient"], float).reshape(len(ids), -1))

    def sphere(self) -> np.ndarray:
        r = np.linalg.norm(self.xyz, axis=1, keepdims=True)
        return np.divide(self.xyz, r, out=np.zeros_like(self.xyz), where=r > 0)


class Cells:
    """Candidate cells sorted by vertex and parcel, with links between cells of one parcel at neighbouring vertices."""

    def __init__(self, mesh: Mesh, v: np.ndarray, parcel: np.ndarray) -> None:
        self.parcels, self.l = np.unique(parcel, return_inverse=True)
        self.v = np.searchsorted(mesh.ids, v)
        self.mesh, self.n = mesh, len(mesh.ids)
        wide = len(self.parcels)
        self.key = self.v * wide + self.l
        self.starts = np.flatnonzero(np.concatenate([[True], self.v[1:] != self.v[:-1]]))
        self.row = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.v))))
        # Every cell looks at its parcel's cell across each edge that ends at its vertex.
        into = np.argsort(mesh.dst, kind="stable")
        source, ends = mesh.src[into], np.searchsorted(mesh.dst[into], np.arange(self.n + 1))
        degree = np.diff(ends)[self.v]
        cell = np.repeat(np.arange(len(self.v)), degree)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(degree) - degree, degree)
        other = source[ends[self.v[cell]] + nth] * wide + self.l[cell]
        at = np.minimum(np.searchsorted(self.key, other), max(len(self.key) - 1, 0))
        there = self.key[at] == other if len(self.key) else np.zeros(0, bool)
        self.cell, self.across = cell[there], at[there]

    def potts(self, lam: np.ndarray) -> np.ndarray:
        """Neighbours' mass outside the cell's own parcel."""
        total = np.bincount(self.v, lam, self.n)
        around = np.bincount(self.mesh.dst, total[self.mesh.src], self.n)
        return around[self.v] - np.bincount(self.cell, lam[self.across], len(self.v))

    def softmax(self, score: np.ndarray) -> np.ndarray:
        """Over each vertex's cells; a row without a finite sum becomes zeros."""
        clean = np.where(np.isnan(score), -np.inf, score)
        top = np.maximum.reduceat(clean, self.starts)
        with np.errstate(invalid="ignore", over="ignore"):
            e = np.where(score == -np.inf, 0.0, np.exp(score - top[self.row]))
        total = np.add.reduceat(e, self.starts)
        good = (total > 0) & ~np.isnan(total)
        return np.where(good[self.row], e / np.where(good, total, 1.0)[self.row], 0.0)

    def labels(self, lam: np.ndarray) -> np.ndarray:
        """Label of every vertex of the mesh: its largest cell, the lowest parcel on ties, 0 without mass."""
        out = np.zeros(self.n, np.int64)
        order = np.lexsort((self.l, -lam, self.v))
        first = order[self.starts]
        some = np.add.reduceat(lam, self.starts) != 0
        out[self.v[first[some]]] = self.parcels[self.l[first[some]]]
        return out

    def by_parcel(self, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Weighted sums per parcel of each column of ``values`` (by vertex)."""
        return np.stack([np.bincount(self.l, weight * values[self.v, k], len(self.parcels)) for k in range(values.shape[1])], 1)


def gradient_prior(cells: Cells, lam: np.ndarray) -> np.ndarray:
    """``-|g - u|^2`` with ``u`` the mean gradient of a parcel; minus infinity where there is none."""
    g = cells.mesh.gradient
    mass = np.bincount(cells.l, lam, len(cells.parcels))
    # Rows without mass take no part, so a missing gradient there spoils nothing.
    with np.errstate(all="ignore"):
        u = cells.by_parcel(lam, np.where(lam_any(cells, lam)[:, None], g, 0.0)) / mass[:, None]
        out = -((g[cells.v] - u[cells.l]) ** 2).sum(1)
    return np.where(np.isnan(out) | (mass[cells.l] <= 0), -np.inf, out)


def lam_any(cells: Cells, lam: np.ndarray) -> np.ndarray:
    return np.bincount(cells.v, lam != 0, cells.n) > 0


def sphere_prior(cells: Cells, lam: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """``Cdln(gamma, 3) + gamma cos`` with a parcel's mean direction; undefined is 0."""
    unit = cells.mesh.sphere()
    mean = cells.by_parcel(lam, unit)
    with np.errstate(all="ignore"):
        cos = (unit[cells.v] * mean[cells.l]).sum(1) / np.linalg.norm(mean, axis=1)[cells.l]
        out = cdln(gamma, 3)[cells.l] + gamma[cells.l] * cos
    return np.where(np.isnan(out), 0.0, out)


def pieces(mesh: Mesh, labels: np.ndarray) -> np.ndarray:
    """Connected pieces of equal non-zero labels, named by their first vertex; -1 where the label is 0."""
    same = (labels[mesh.src] == labels[mesh.dst]) & (labels[mesh.src] != 0)
    a, b = mesh.src[same], mesh.dst[same]
    comp = np.arange(len(labels))
    while True:
        low = comp.copy()
        np.minimum.at(low, a, comp[b])
        np.minimum.at(low, b, comp[a])
        np.minimum.at(low, comp, low.copy())
        while (low[low] != low).any():
            low = low[low]
        if (low == comp).all():
            return np.where(labels != 0, comp, -1)
        comp = low


def without_small_pieces(mesh: Mesh, labels: np.ndarray, smallest: int) -> np.ndarray:
    """Pieces below a size take the label most of their edges lead to, the smallest on ties."""
    comp = pieces(mesh, labels)
    size = np.bincount(comp[comp >= 0], minlength=len(labels))
    few = (comp >= 0) & (size[comp] < smallest)
    votes = few[mesh.src] & (labels[mesh.dst] != 0) & (labels[mesh.dst] != labels[mesh.src])
    pairs, count = np.unique(np.stack([comp[mesh.src[votes]], labels[mesh.dst[votes]]], 1), axis=0, return_counts=True)
    out = labels.copy()
    if len(pairs):
        order = np.lexsort((pairs[:, 1], -count, pairs[:, 0]))
        first = order[np.concatenate([[True], np.diff(pairs[order, 0]) != 0])]
        winner = np.full(len(labels), -1, np.int64)
        winner[pairs[first, 0]] = pairs[first, 1]
        moved = few & (winner[comp] >= 0)
        out[moved] = winner[comp[moved]]
    return out


def piece_gaps(mesh: Mesh, labels: np.ndarray, n_labels: int) -> dict[int, tuple[int, float]]:
    """Per label its number of pieces and the largest gap between one and its nearest sibling, rim to rim."""
    comp = pieces(mesh, labels)
    heads = np.unique(comp[comp >= 0])
    names, counts = np.unique(labels[heads], return_counts=True)
    split = np.isin(labels, names[counts > 1])
    seen = np.where(split, labels, 2 * n_labels + 1)
    rim = split & (np.bincount(mesh.src, seen[mesh.dst] - seen[mesh.src], len(labels)) != 0)
    out = {}
    for name, many in zip(names.tolist(), counts.tolist(), strict=True):
        gap = 0.0
        if many > 1:
            at = np.flatnonzero(rim & (labels == name))
            gap = largest_gap(mesh.xyz[at], comp[at])
        out[name] = (many, gap)
    return out


def largest_gap(points: np.ndarray, piece: np.ndarray, block: int = 1024) -> float:
    """Largest over pieces of the distance to the nearest point of another one, some points at a time."""
    _, piece = np.unique(piece, return_inverse=True)
    best = np.full(int(piece.max(initial=-1)) + 1, np.inf)
    for at in range(0, len(points), block):
        d = ((points[at : at + block, None] - points[None]) ** 2).sum(2)
        d[piece[at : at + block, None] == piece[None]] = np.inf
        np.minimum.at(best, piece[at : at + block], d.min(1))
    best = best[np.isfinite(best)]
    return float(np.sqrt(best.max())) if len(best) else 0.0


def scattered(mesh: Mesh, labels: np.ndarray, n_labels: int, far: float, most: int, smallest: int | None) -> set[int]:
    """Labels with a piece further than ``far`` from the rest or with more than ``most`` pieces."""
    if smallest is not None:
        labels = without_small_pieces(mesh, labels, smallest)
    return {name for name, (n, gap) in piece_gaps(mesh, labels, n_labels).items() if gap > far or n > most}


@dataclass
class Posterior:
    lam: np.ndarray
    sxv: np.ndarray
    scv: np.ndarray
    gamma: np.ndarray
    v_potts: np.ndarray
    rounds: int


def expectation(cells: Cells, base: np.ndarray, dead: np.ndarray, lam: np.ndarray, sxv: np.ndarray, gamma: np.ndarray, variant, s, em_round: int) -> Posterior:
    """All assignment rounds of one EM round: priors, the Potts loop to its end, and the piece check around it.

    ``dead`` flags cells, ``gamma`` has one entry per parcel of ``cells``.
    """
    scv, rounds = np.zeros(len(base)), 0
    if variant.gradient_prior:
        scv = gradient_prior(cells, lam)
    elif variant.sphere_prior:
        sxv = sphere_prior(cells, lam, gamma)
    beta = s.beta * variant.beta_scale
    checks = variant.check_pieces and em_round >= variant.first_check
    for _ in range(s.max_pieces_rounds if checks else 1):
        with np.errstate(invalid="ignore"):
            score0 = base + beta * scv + sxv if variant.gradient_prior else base + beta * sxv if variant.sphere_prior else base
        last = None
        for i in range(1, s.max_lambda + 2):
            v_potts = cells.potts(lam)
            new = np.where(dead, 0.0, cells.softmax(score0 - 2.0 * s.c * v_potts))
            drift = np.abs(new - lam).sum() / (s.n_vertices * s.n_labels)
            lam, rounds = new, rounds + 1
            if abs(drift - (last or 0.0)) <= s.epsilon or i > s.max_lambda:
                break
            last = drift
        if not checks:
            break
        far = variant.connect_distance if s.connect_distance is None else s.connect_distance
        bad = scattered(cells.mesh, cells.labels(lam), s.n_labels, far, variant.max_pieces, s.isolated_below if variant.clean_before_check else None)
        gamma = gamma + np.where(np.isin(cells.parcels, list(bad)), 1000.0, 0.0)
        sxv = sphere_prior(cells, lam, gamma)
        if not bad:
            break
    return Posterior(lam, sxv, scv, gamma, v_potts, rounds)


def cost_of(cells: Cells, acc: np.ndarray, theta: np.ndarray, kappa: float, dim: int, got: Posterior, variant, s) -> float:
    """Expected complete log likelihood; logs of zero and non-finite spatial terms take the floor."""
    with np.errstate(divide="ignore"):
        log = lambda x: np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), LOG_FLOOR)
        body = s.sessions * cdln(kappa, dim)[0] + kappa * acc + log(theta) - s.w * log(got.lam) - s.c * got.v_potts
        if variant.cost_uses_prior:
            body = body + s.beta * variant.beta_scale * np.where(np.isfinite(got.scv), got.scv, LOG_FLOOR)
        return float((got.lam * body).sum())
