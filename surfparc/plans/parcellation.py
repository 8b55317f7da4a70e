"""Individual parcellation: the nested EM loops over all subjects at once.

Subjects are independent here. They run side by side in the same tables and each
leaves a loop when it converges, so a slow subject never holds the others' rows
in play. A subject whose observations are one block goes through all loops in one
task (``whole_subjects``): the number of Spark jobs is fixed. Passes over larger
observations run on bounded blocks; what a mesh bounds, a subject's candidate
cells, comes together once per EM round: the assignment loop and the piece check
around it run on its arrays in one task, so Spark jobs are as many as EM rounds,
not as assignment rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.functions.special import cdln, cdln_column, initial_concentration
from surfparc.functions.vectors import dot, scale
from surfparc.operators import em, subject
from surfparc.operators.blocks import renewed
from surfparc.operators.graph import remove_isolated
from surfparc.operators.ranking import argmax_labels
from surfparc.session import cut, forget, pin


@dataclass(frozen=True)
class Variant:
    """What a model variant switches on."""

    name: str
    gradient_prior: bool = False
    sphere_prior: bool = False
    check_pieces: bool = False
    first_check: int = 1
    max_pieces: int = 0
    clean_before_check: bool = False
    cost_uses_prior: bool = False
    clean_labels: bool = False
    beta_scale: float = 0.0
    connect_distance: float = 0.0


VARIANTS = {
    "gradient": Variant(
        "gradient", gradient_prior=True, sphere_prior=True, check_pieces=True, first_check=2, max_pieces=3,
        cost_uses_prior=True, beta_scale=1000.0, connect_distance=15.0,
    ),
    "contiguous": Variant(
        "contiguous", sphere_prior=True, check_pieces=True, max_pieces=1, clean_before_check=True, clean_labels=True, beta_scale=1.0
    ),
    "distributed": Variant("distributed"),
}


@dataclass(frozen=True)
class Settings:
    sessions: int
    n_labels: int
    n_vertices: int
    w: float = 50.0
    c: float = 10.0
    beta: float = 5.0
    epsilon: float = 1e-4
    max_intra: int = 50
    max_em: int = 100
    max_lambda: int = 50
    max_m: int = 50
    max_pieces_rounds: int = 15
    isolated_below: int = 5
    spacing: float = 15.0
    connect_distance: float | None = None


def starting_concentration(dim: int) -> float:
    # Fixed value: the concentration used for profiles of dimension 1482.
    return 650.0 if dim == 1482 else initial_concentration(dim)


STATE = "sub long, v long, l int, theta double, lam double, sxv double, gamma double, cost double, cost_em double, done boolean"


def mesh_rows(vertices: DataFrame, edges: DataFrame, gradient: DataFrame | None) -> DataFrame:
    """One row of arrays per subject: its mesh, the edges between active vertices and the gradients, pinned by subject."""
    g = vertices.withColumn("grad", F.lit(None).cast("array<double>")) if gradient is None else vertices.join(
        gradient.select("sub", "v", F.col("grad").cast("array<double>").alias("grad")), ["sub", "v"], "left"
    )

    def build(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame(columns=["sub", "ids", "x", "y", "z", "src", "dst", "gradient"])
        v = v.sort_values("v", ignore_index=True)
        ids = v["v"].to_numpy()
        known = [g for g in v["grad"] if g is not None]
        missing = np.full(len(known[0]) if known else 1, np.nan)
        grad = np.concatenate([missing if g is None else g for g in v["grad"]])
        ends = [np.searchsorted(ids, e[c].to_numpy(dtype=np.int64)).astype(np.int32) for c in ("src", "dst")]
        return pd.DataFrame({"sub": [v["sub"].iloc[0]], "ids": [ids], **{c: [v[c].to_numpy(dtype=float)] for c in "xyz"}, "src": [ends[0]], "dst": [ends[1]], "gradient": [grad]})

    kind = dict(vertices.dtypes)["sub"]
    schema = f"sub {kind}, ids array<long>, x array<double>, y array<double>, z array<double>, src array<int>, dst array<int>, gradient array<double>"
    rows = g.groupBy("sub").cogroup(renewed(edges).groupBy("sub")).applyInPandas(build, schema).withColumn("sub", F.col("sub").cast("long"))
    return pin(rows, ["sub"], int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def settled(cost: float, before: float) -> bool:
    """A cost that moved by at most 1e-4 of the last one; NaN, and zero after zero, count as settled."""
    if np.isnan(cost) or np.isnan(before):
        return True
    return abs((cost - before) / before) <= 1e-4 if before != 0 else cost == 0


def assign(mine: subject.Cells, acc: np.ndarray, theta: np.ndarray, lam: np.ndarray, sxv: np.ndarray, gamma: np.ndarray, kappa: float, v: Variant, s: Settings, dim: int, em_round: int) -> tuple[subject.Posterior, float]:
    """One subject's posterior, priors and cost of an EM round; ``gamma`` by parcel, the rest by cell."""
    dead = (np.bincount(mine.l, acc != 0, len(mine.parcels)) == 0)[mine.l]
    with np.errstate(divide="ignore"):
        base = kappa * acc + np.where(dead, 0.0, s.sessions * cdln(kappa, dim)[0]) + s.w * np.where(theta > 0, np.log(np.where(theta > 0, theta, 1.0)), -np.inf)
    got = subject.expectation(mine, base, dead, lam, sxv, gamma, v, s, em_round)
    return got, subject.cost_of(mine, acc, theta, kappa, dim, got, v, s)


def expectation_round(cells: DataFrame, mesh: DataFrame, v: Variant, s: Settings, dim: int, em_round: int) -> DataFrame:
    """Posterior, priors and cost of every subject; the whole assignment loop runs on one subject's arrays in a task."""

    def step(c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(m):
            return pd.DataFrame(columns=[x.split()[0] for x in STATE.split(", ")])
        c = c.sort_values(["v", "l"], ignore_index=True)
        mine = subject.Cells(subject.Mesh.from_row(m.iloc[0]), c["v"].to_numpy(), c["l"].to_numpy())
        acc, theta, lam, sxv = (c[k].to_numpy() for k in ("acc", "theta", "lam", "sxv"))
        kappa, before = float(c["kappa"].iloc[0]), 0.0 if em_round == 1 else float(c["cost"].iloc[0])
        gamma = np.zeros(len(mine.parcels))
        gamma[mine.l] = c["gamma"].to_numpy()
        got, cost = assign(mine, acc, theta, lam, sxv, gamma, kappa, v, s, dim, em_round)
        stop = settled(cost, before)
        return c[["sub", "v", "l", "theta"]].assign(
            lam=got.lam, sxv=got.sxv, gamma=got.gamma[mine.l], cost=cost, cost_em=before if stop else cost, done=stop or em_round > s.max_em
        )

    return cells.groupBy("sub").cogroup(mesh.groupBy("sub")).applyInPandas(step, STATE)


def whole_subjects(obs: DataFrame, cells: DataFrame, mesh: DataFrame, parcel: DataFrame, v: Variant, s: Settings, dim: int) -> tuple[DataFrame, DataFrame]:
    """Both EM loops of subjects whose observations are one block, a subject in a task: (cells, ``sub, round, cost``)."""
    columns = [c.split()[0] for c in STATE.split(", ")] + ["round"]

    def solve(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(m):
            return pd.DataFrame(columns=columns)
        x, row = x.sort_values("v", ignore_index=True), m.iloc[0]
        mat, vertex, theta = em.dense(x), np.asarray(row["cell_v"], np.int64), np.asarray(row["cell_theta"], float)
        mine = subject.Cells(subject.Mesh.from_row(row), vertex, np.asarray(row["cell_l"], np.int64))
        place = {int(k): i for i, k in enumerate(row["l"])}
        pick = [place[k] for k in mine.parcels.tolist()]
        mu, sigma, eps = np.stack(row["mu"])[pick], np.asarray(row["sigma"], float)[pick], np.asarray(row["eps"], float)[pick]
        where, weight = np.searchsorted(x["v"].to_numpy(), vertex), np.zeros((len(pick), len(x)))
        lam, sxv, gamma, psi, costs, before = theta, np.zeros(len(theta)), np.zeros(len(pick)), mu, [], 0.0
        for i in range(1, s.max_intra + 1):
            nu, kappa, last = np.tile(mu, (1, s.sessions)), starting_concentration(dim), 0.0
            for em_round in range(1, s.max_em + 2):
                weight[mine.l, where] = lam
                nu, kappa = em.m_step(nu, weight @ mat, sigma[:, None] * psi, kappa, lam.sum() * s.sessions, s.sessions, dim, s.epsilon, s.max_m)
                got, cost = assign(mine, (mat @ nu.T)[where, mine.l], theta, lam, sxv, gamma, kappa, v, s, dim, em_round)
                lam, sxv, gamma = got.lam, got.sxv, got.gamma
                if settled(cost, last):
                    break
                last = cost
            total = nu.reshape(len(pick), s.sessions, -1).sum(1)
            raw = sigma[:, None] * total + eps[:, None] * mu
            size = np.linalg.norm(raw, axis=1, keepdims=True)
            psi = raw / np.where(size > 0, size, 1.0)
            each = sigma * (psi * total).sum(1) + s.sessions * cdln(sigma, dim) + eps * (mu * psi).sum(1) + cdln(eps, dim)
            costs.append(float(each.sum() + last))
            if settled(costs[-1], before):
                break
            before = costs[-1]
        sub = row["sub"]
        final = pd.DataFrame({"sub": sub, "v": vertex, "l": mine.parcels[mine.l], "theta": theta, "lam": lam, "sxv": sxv, "gamma": gamma[mine.l], "cost": cost, "cost_em": last, "done": True})
        story = pd.DataFrame({"sub": sub, "cost": costs, "round": np.arange(1, len(costs) + 1)})
        return pd.concat([final, story], ignore_index=True).reindex(columns=columns).astype({"v": "Int64", "l": "Int64", "round": "Int64", "done": "boolean"})

    listed = cells.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("v", "l", "theta"))).alias("_c")).select("sub", *[F.col(f"_c.{c}").alias(f"cell_{c}") for c in ("v", "l", "theta")])
    model = parcel.agg(F.collect_list(F.struct("l", "mu", "sigma", "eps")).alias("_p")).select(*[F.col(f"_p.{c}").alias(c) for c in ("l", "mu", "sigma", "eps")])
    each = renewed(mesh.join(listed, "sub").crossJoin(model).withColumn("block", F.lit(0)))
    found = cut(obs.groupBy("sub", "block").cogroup(each.groupBy("sub", "block")).applyInPandas(solve, STATE + ", round int"))
    return found.filter("round is null").drop("round"), found.filter("round is not null").select("sub", "round", "cost")


def em_rounds(state: DataFrame, psi: DataFrame, obs: DataFrame, sizes: DataFrame, parcel: DataFrame, mesh: DataFrame, v: Variant, s: Settings, dim: int) -> tuple[DataFrame, DataFrame]:
    """Inner EM of all subjects: (cells, centroids), each subject as it was when its cost settled.

    A round writes two tables, centroids and cells; the next one deletes those
    that no finished subject is in.
    """
    zero = F.array_repeat(F.lit(0.0), s.sessions * (dim + 1))
    nu = psi.select("sub", "l").join(parcel.select("l", "mu"), "l").select("sub", "l", F.flatten(F.array_repeat("mu", s.sessions)).alias("nu"), F.lit(starting_concentration(dim)).alias("kappa"))
    pulls = psi.join(parcel, "l").select("sub", "l", scale(F.col("psi"), F.col("sigma")).alias("pull"))
    cells, spent, out = state, [], []
    for i in range(1, s.max_em + 2):
        mass = cells.groupBy("sub").agg(F.sum("lam").alias("mass"))
        cent = nu.join(em.weighted_sums(obs, cells, sizes), ["sub", "l"], "left").join(pulls, ["sub", "l"]).join(mass, "sub").withColumn("xdot", F.coalesce("xdot", zero))
        turned = cut(em.m_step_by_subject(cent, s.sessions, dim, s.epsilon, s.max_m))
        moved = cut(expectation_round(em.products_for(obs, cells, turned, sizes), mesh, v, s, dim, i))
        for old in spent:
            forget(old)
        finished, rows = moved.agg(F.count_if("done"), F.count(F.lit(1))).first()
        if finished:
            fin = moved.filter("done")
            out.append((fin, turned.join(fin.select("sub").distinct(), "sub", "left_semi")))
        if finished == rows:
            break
        cells, spent = moved.filter("not done"), [] if finished else [moved, turned]
        nu = turned.join(cells.select("sub").distinct(), "sub", "left_semi") if finished else turned
    return tuple(reduce(DataFrame.unionByName, frames) for frames in zip(*out, strict=True))


def parcellate(
    profile: DataFrame, theta: DataFrame, parcel: DataFrame, vertices: DataFrame, edges: DataFrame, variant: str, s: Settings, dim: int, gradient: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Parcellate every subject of ``profile (sub, t, v, x)`` under a trained prior.

    ``theta (v, l, theta)``, ``parcel (l, mu, sigma, eps)``, ``vertices (sub, v, x,
    y, z)``, ``edges (sub, src, dst)``. Returns ``labels`` and the final tables.
    """
    v = VARIANTS[variant]
    vertices = vertices.select("sub", "v", "x", "y", "z")
    obs = em.observations(profile)
    sizes = cut(em.block_sizes(obs))
    present = obs.select("sub", "v")
    prior = theta.filter(F.col("theta") != 0)
    cells = cut(
        present.join(prior, "v").select(
            "sub", "v", F.col("l").cast("int").alias("l"), "theta", F.col("theta").alias("lam"), *[F.lit(0.0).alias(c) for c in ("sxv", "gamma", "cost", "cost_em")], F.lit(False).alias("done")
        )
    )
    active = cells.groupBy("sub", "v").agg(F.sum("lam").alias("_t")).filter("_t != 0").drop("_t")
    net = edges.select("sub", "src", "dst").join(active.withColumnRenamed("v", "src"), ["sub", "src"], "left_semi").join(active.withColumnRenamed("v", "dst"), ["sub", "dst"], "left_semi")
    mesh = mesh_rows(vertices, net, gradient if v.gradient_prior else None)
    parcel = cut(parcel.select(F.col("l").cast("int").alias("l"), "mu", "sigma", "eps"))
    one, several = obs.filter("n_blocks = 1"), obs.filter("n_blocks > 1")
    done, costs = whole_subjects(one, cells.join(sizes.filter("n_blocks = 1"), "sub", "left_semi"), mesh, parcel, v, s, dim)
    final, history, before = [done], [costs], None
    cells = cells.join(sizes.filter("n_blocks > 1"), "sub", "left_semi")
    psi = cut(cells.select("sub", "l").distinct().join(parcel, "l").select("sub", "l", F.col("mu").alias("psi")))
    for i in range(1, s.max_intra + 1):
        if psi.isEmpty():
            break
        mine = several if i == 1 else several.join(psi.select("sub").distinct(), "sub", "left_semi")
        cells, nu = em_rounds(cells, psi, mine, sizes, parcel, mesh, v, s, dim)
        psi_nu = em.subject_direction(nu.select("sub", "l", "nu"), parcel, s.sessions, dim + 1)
        each = (
            F.col("sigma") * dot(F.col("psi"), F.col("nu_total")) + s.sessions * cdln_column(F.col("sigma"), dim)
            + F.col("eps") * dot(F.col("mu"), F.col("psi")) + cdln_column(F.col("eps"), dim)
        )
        inner = cells.groupBy("sub").agg(F.max("cost_em").alias("cost_em"))
        cost = psi_nu.join(parcel, "l").groupBy("sub").agg(F.sum(each).alias("_c")).join(inner, "sub").select("sub", (F.col("_c") + F.col("cost_em")).alias("cost"))
        cost = cost.withColumn("before", F.lit(0.0)) if before is None else cost.join(before, "sub")
        gap = F.abs((F.col("cost") - F.col("before")) / F.when(F.col("before") != 0, F.col("before")))
        stop = F.isnan("cost") | F.isnan("before") | F.when(F.col("before") != 0, gap <= 1e-4).otherwise(F.col("cost") == 0)
        cost = cut(cost.withColumn("stop", stop if i < s.max_intra else F.lit(True)).withColumn("round", F.lit(i)))
        psi = cut(psi_nu.select("sub", "l", "psi").join(cost.filter(~F.col("stop")).select("sub"), "sub", "left_semi"))
        history.append(cost.select("sub", "round", "cost"))
        done, rest = em.frozen(cells, cost.filter("stop"))
        final.append(done)
        cells, before = rest, cost.select("sub", F.col("cost").alias("before"))
    cells = cut(reduce(DataFrame.unionByName, final))
    labels = argmax_labels(cells, ["sub", "v"], "l", "lam").select("sub", "v", "label")
    everyone = vertices.select("sub", "v").join(labels, ["sub", "v"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    if v.clean_labels:
        everyone = remove_isolated(cut(everyone), edges, ["sub"], s.isolated_below)
    return {"labels": everyone, "cells": cells, "cost": cut(reduce(DataFrame.unionByName, history))}
