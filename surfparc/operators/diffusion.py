"""Diffusion embedding of a distance table: meshes of one block in a task each, larger ones by distributed subspace iteration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.functions.vectors import vsum
from surfparc.operators.aggregates import sum_vectors
from surfparc.operators.blocks import block_apply
from surfparc.session import cut, forget


# Meshes of at most so many vertices are one block of the distributed product, so their matrix meets in one task.
WHOLE = 1024


def affinity(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``exp(-d / max d)`` on rows of ``(keys, src, dist array)``."""
    top = dist.groupBy(*keys).agg(F.max(F.array_max("dist")).alias("_top"))
    bad = F.raise_error(F.lit("all distances are zero")).cast("double")
    scale = F.when(F.col("_top") > 0, F.col("_top")).otherwise(bad)
    return dist.join(top, list(keys)).withColumn("_top", scale).select(*keys, "src", F.transform("dist", lambda d: F.exp(-d / F.col("_top"))).alias("row"))


def _row_vector(sums: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One array per key, ordered by vertex: the size of one mesh."""
    p = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("src", value))).alias("_p"))
    return p.select(*keys, F.transform("_p", lambda x: x[value]).alias("_vec"))


def normalized_affinity(aff: DataFrame, keys: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """Rows of the symmetric transition matrix, with ``root_d2`` of each row kept."""
    keys = list(keys)
    d = aff.select(*keys, "src", vsum(F.col("row")).alias("d"))
    a = aff.join(d, [*keys, "src"]).join(_row_vector(d, keys, "d"), keys)
    a = a.select(*keys, "src", F.zip_with("row", "_vec", lambda x, y: x * F.pow(y, F.lit(-alpha)) * F.pow(F.col("d"), F.lit(-alpha))).alias("row"))
    d2 = a.select(*keys, "src", F.sqrt(vsum(F.col("row"))).alias("root_d2"))
    b = a.join(d2, [*keys, "src"]).join(_row_vector(d2, keys, "root_d2"), keys)
    return b.select(*keys, "src", "root_d2", F.zip_with("row", "_vec", lambda x, y: x / (y * F.col("root_d2"))).alias("row"))


def _small(y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the blocks' small Gram matrices: one row per key."""
    parts = y.filter(F.col("g").isNotNull())
    return sum_vectors(parts, keys, "g", out="g").join(sum_vectors(parts, keys, "h", out="h"), list(keys))


def whole_map(dist: DataFrame, keys: Sequence[str], n_components: int, alpha: float) -> DataFrame:
    """The coordinates of ``diffusion_map`` for meshes of one block: the distances are shuffled once, no round follows."""
    keys = list(keys)
    kinds = dict(dist.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("src", ignore_index=True)
        d = np.stack(rows["dist"].to_list())
        if not d.max() > 0:
            raise ValueError("all distances are zero")
        a = np.exp(-d / d.max())
        degree = a.sum(1) ** -alpha
        a = a * degree[:, None] * degree[None]
        root = np.sqrt(a.sum(1))
        s = a / (root[:, None] * root[None])
        val, vec = np.linalg.eigh((s + s.T) / 2.0)
        order = np.argsort(-np.abs(val[::-1]), kind="stable")[: n_components + 1]
        ev, y = np.zeros(n_components + 1), np.zeros((len(d), n_components + 1))
        ev[: len(order)], y[:, : len(order)] = val[::-1][order], vec[:, ::-1][:, order]
        if (np.abs(y[:, 0] / root) < 1e-30).any():
            raise ValueError("stationary vector vanishes")
        c = y[:, 1:] / y[:, :1] * ev[1:] / (1.0 - ev[1:])
        lead = c[np.abs(c).argmax(0), np.arange(n_components)]
        return pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "v": rows["src"].to_numpy(), "emb": list(np.where(lead < 0, -c, c))})

    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return dist.groupBy(*keys).applyInPandas(solve, f"{typed}, v long, emb array<double>")


def diffusion_map(dist: DataFrame, keys: Sequence[str], n_components: int, alpha: float = 0.5, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """Leading non-trivial diffusion coordinates per vertex (array ``emb``).

    Meshes of at most ``WHOLE`` vertices are solved whole, one in a task; the rest
    by rounds over all of them (``iterated_map``). Coordinates are divided by the
    stationary vector and scaled by ``l / (1 - l)``; each is signed so that its
    entry of largest size is positive.
    """
    few = whole_map(dist.filter(F.size("dist") <= WHOLE), keys, n_components, alpha)
    large = dist.filter(F.size("dist") > WHOLE)
    return few if large.isEmpty() else few.unionByName(iterated_map(large, keys, n_components, alpha, tol, max_rounds))


def iterated_map(dist: DataFrame, keys: Sequence[str], n_components: int, alpha: float = 0.5, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """The same by subspace iteration.

    The similarity matrix stays distributed by rows. A thin basis is multiplied by
    it block by block, and its small Gram matrices are summed by Spark; a
    Rayleigh-Ritz step turns the basis into eigenvectors. Rounds stop when the
    wanted eigenvalues of every mesh settle; if they don't within ``max_rounds``,
    that is an error.
    """
    keys = list(keys)
    kinds = dict(dist.dtypes)
    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    s = cut(normalized_affinity(affinity(dist, keys), keys, alpha))
    k = n_components + 1
    width = k + max(6, k // 2)

    def start(batches):
        for pdf in batches:
            q = [np.r_[1.0, np.random.RandomState((int(v) * 7919 + 17) % (2**31)).standard_normal(width - 1)] for v in pdf["src"]]
            yield pdf.assign(y=q)

    q = s.select(*keys, "src").mapInPandas(start, f"{typed}, src long, y array<double>")

    def multiply(rows: pd.DataFrame, basis: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "src", "y", "sy", "g", "h"]
        if not len(rows):
            return pd.DataFrame(columns=cols)
        b = np.stack(basis.sort_values("src")["y"].to_list())
        own = np.stack(basis.set_index("src")["y"].loc[rows["src"]].to_list())
        out = np.stack(rows["row"].to_list()) @ b
        got = pd.DataFrame({**{c: rows[c].to_numpy() for c in keys}, "src": rows["src"].to_numpy(), "y": list(own), "sy": list(out)})
        first = [None] * (len(rows) - 1)
        got["g"] = [(own.T @ own).ravel(), *first]
        got["h"] = [(own.T @ out).ravel(), *first]
        return got[cols]

    def rotate(rows: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "src", "y", "ev"]
        if not len(rows):
            return pd.DataFrame(columns=cols)
        g = np.array(small["g"].iloc[0]).reshape(width, width)
        h = np.array(small["h"].iloc[0]).reshape(width, width)
        val, vec = np.linalg.eigh((g + g.T) / 2.0)
        good = val > val.max() * 1e-13
        white = vec[:, good] / np.sqrt(val[good])
        ev, rot = np.linalg.eigh(white.T @ ((h + h.T) / 2.0) @ white)
        order = np.argsort(-np.abs(ev), kind="stable")
        basis = np.zeros((width, width))
        basis[:, : good.sum()] = (white @ rot)[:, order]
        full = np.zeros(width)
        full[: good.sum()] = ev[order]
        y = np.stack(rows["sy" if rows["_advance"].iloc[0] else "y"].to_list()) @ basis
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in keys}, "src": rows["src"].to_numpy(), "y": list(y), "ev": [full] * len(rows)})[cols]

    product = f"{typed}, src long, y array<double>, sy array<double>, g array<double>, h array<double>"
    before = None
    for r in range(max_rounds):
        y = cut(block_apply(s.select(*keys, "src", "row"), q, keys, "src", multiply, product, 1024))
        small = _small(y, keys)
        if r:
            forget(q)
        q = cut(block_apply(y.drop("g", "h").withColumn("_advance", F.lit(True)), small, keys, "src", rotate, f"{typed}, src long, y array<double>, ev array<double>", 4096))
        forget(y)
        values = q.groupBy(*keys).agg(F.first("ev").alias("ev")).select(*keys, F.slice("ev", 1, k).alias("ev"))
        if before is not None:
            gap = before.join(values, keys).select(F.array_max(F.zip_with("old", "ev", lambda a, b: F.abs(a - b))).alias("g")).agg(F.max("g")).first()[0]
            if gap is None or gap < tol:
                break
            if r == max_rounds - 1:
                raise RuntimeError(f"eigenvalues still move by {gap:.3g} after {max_rounds} rounds; allow more rounds or ask for fewer components")
        before = cut(values.withColumnRenamed("ev", "old"))
        q = q.drop("ev")
    # One product more, this time keeping the basis itself, gives the eigenvectors.
    y = cut(block_apply(s.select(*keys, "src", "row"), q.select(*keys, "src", "y"), keys, "src", multiply, product, 1024))
    small = _small(y, keys)
    vec = cut(block_apply(y.drop("g", "h").withColumn("_advance", F.lit(False)), small, keys, "src", rotate, f"{typed}, src long, y array<double>, ev array<double>", 4096))
    psi = vec.join(s.select(*keys, "src", "root_d2"), [*keys, "src"])
    guard = F.when(F.abs(F.col("y")[0] / F.col("root_d2")) < 1e-30, F.raise_error(F.lit("stationary vector vanishes")).cast("double")).otherwise(F.col("y")[0])
    psi = psi.withColumn("_z", guard)
    coords = F.transform(
        F.sequence(F.lit(1), F.lit(n_components)),
        lambda i: F.get("y", i) / F.col("_z") * F.get("ev", i) / (1.0 - F.get("ev", i)),
    )
    emb = psi.select(*keys, "src", F.posexplode(coords).alias("pos", "c"))
    lead = emb.groupBy(*keys, "pos").agg(F.max(F.struct(F.abs("c").alias("a"), (-F.col("src")).alias("s"), F.col("c").alias("c"))).alias("_m"))
    signed = emb.join(lead, [*keys, "pos"]).withColumn("c", F.when(F.col("_m.c") < 0, -F.col("c")).otherwise(F.col("c")))
    packed = signed.groupBy(*keys, "src").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("_p"))
    return packed.select(*keys, F.col("src").alias("v"), F.transform("_p", lambda x: x["c"]).alias("emb"))
