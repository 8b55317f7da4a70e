"""Mesh-graph operators: components, bounded reach, isolated pieces, Potts term."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.operators import paths
from surfparc.operators.blocks import block_apply
from surfparc.operators.ranking import mode_smallest
from surfparc.session import cut, forget


def _ends(edges: DataFrame, vertices: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Edges with ``value`` of both ends (``own`` at src, ``other`` at dst)."""
    shared = [k for k in keys if k in edges.columns]
    own = vertices.select(*keys, F.col("v").alias("src"), F.col(value).alias("own"))
    other = vertices.select(*keys, F.col("v").alias("dst"), F.col(value).alias("other"))
    return edges.join(own, [*shared, "src"]).join(other, [*keys, "dst"])


def components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Connected components of equal non-zero labels; ``comp`` is the smallest vertex id.

    Every round lowers each vertex to the smallest id around it, passes that id
    on to its current root and follows the root's pointer twice, so the number of
    rounds grows with the logarithm of a component's extent. Updates to a root
    are reduced by ``min`` before they shuffle, so one giant component stays cheap.
    """
    keys = list(keys)
    live = vertices.filter(F.col(label) != 0).select(*keys, "v", label)
    same = cut(_ends(edges, live, keys, label).filter(F.col("own") == F.col("other")).select(*keys, "src", "dst"))
    state, spent = live.withColumn("comp", F.col("v")), None
    while True:
        near = (
            same.join(state.select(*keys, F.col("v").alias("dst"), F.col("comp").alias("c")), [*keys, "dst"])
            .groupBy(*keys, F.col("src").alias("v"))
            .agg(F.min("c").alias("near"))
        )
        low = state.join(near, [*keys, "v"], "left").withColumn("low", F.least("comp", F.coalesce("near", "comp")))
        low = cut(low.select(*keys, "v", label, "comp", "low"))
        if spent is not None:
            forget(spent)
        spent = low
        if low.filter(F.col("low") < F.col("comp")).isEmpty():
            return low.select(*keys, "v", label, "comp")
        # A root points at the lowest id its members or itself saw; follow the pointer twice.
        seen = low.select(*keys, F.col("comp").alias("root"), "low").unionByName(low.select(*keys, F.col("v").alias("root"), "low"))
        point = seen.groupBy(*keys, "root").agg(F.min("low").alias("to"))
        onward = point.select(*keys, F.col("root").alias("to"), F.col("to").alias("to2"))
        twice = point.join(onward, [*keys, "to"]).select(*keys, "root", F.least("to", "to2").alias("to"))
        renamed = low.withColumnRenamed("comp", "root")
        state = renamed.join(twice, [*keys, "root"]).select(*keys, "v", label, F.least("low", "to").alias("comp"))


def component_counts(comps: DataFrame, keys: Sequence[str], label: str = "label", parcels: DataFrame | None = None) -> DataFrame:
    """Number of components per parcel; NULL for parcels given but absent."""
    c = comps.select(*keys, label, "comp").distinct().groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_comp"))
    return c if parcels is None else parcels.join(c, [*keys, label], "left")


def component_sizes(comps: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return comps.groupBy(*keys, label, "comp").agg(F.count(F.lit(1)).alias("size"))


def boundary_vertices(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], label: str = "label", fake: int | None = None) -> DataFrame:
    """Vertices whose neighbour label differences do not sum to zero.

    Zero labels stand in as ``fake``. Differences of opposite sign can cancel;
    that is the operator, so the sum is kept rather than an any-different test.
    """
    own = vertices if fake is None else vertices.withColumn(label, F.when(F.col(label) == 0, fake).otherwise(F.col(label)))
    diff = _ends(edges, own.select(*keys, "v", label), keys, label).groupBy(*keys, F.col("src").alias("v")).agg(
        F.sum(F.col("other") - F.col("own")).alias("_d")
    )
    return vertices.join(diff.filter(F.col("_d") != 0).drop("_d"), [*keys, "v"], "left_semi")


def remove_isolated(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], threshold: int, label: str = "label") -> DataFrame:
    """Relabel components smaller than ``threshold`` by their neighbours' vote.

    Votes are counted per edge on the labels given, zero and the component's own
    label do not vote, the smallest label wins ties, and a component nobody
    votes on keeps its label.
    """
    keys = list(keys)
    comps = components(vertices, edges, keys, label)
    small = component_sizes(comps, keys, label).filter(F.col("size") < threshold).select(*keys, "comp")
    members = comps.join(small, [*keys, "comp"], "left_semi").withColumnRenamed("v", "src")
    shared = [k for k in keys if k in edges.columns]
    votes = (
        members.join(edges.select(*shared, "src", "dst"), [*shared, "src"])
        .join(vertices.select(*keys, F.col("v").alias("dst"), F.col(label).alias("vote")), [*keys, "dst"])
        .filter((F.col("vote") != 0) & (F.col("vote") != F.col(label)))
    )
    winner = mode_smallest(votes, [*keys, "comp"], "vote").select(*keys, "comp", F.col("mode").alias("winner"))
    moved = members.join(winner, [*keys, "comp"]).select(*keys, F.col("src").alias("v"), "winner")
    return vertices.join(moved, [*keys, "v"], "left").withColumn(label, F.coalesce("winner", label)).drop("winner")


def local_minima(values: DataFrame, neighbours: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Strictly below every neighbour; a vertex without neighbours qualifies."""
    pairs = _ends(neighbours, values.select(*keys, "v", value), keys, value)
    ok = pairs.groupBy(*keys, F.col("src").alias("v")).agg(F.bool_and(F.col("own") < F.col("other")).alias("is_min"))
    return values.join(ok, [*keys, "v"], "left").withColumn("is_min", F.coalesce("is_min", F.lit(True)))


def potts(cells: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``V[v,l] = sum over neighbours of (row sum - cell of the same parcel)``.

    Every cell travels along its edges and meets the cells of its target vertex in
    one exchange by vertex; both neighbour totals, and the softmax that follows in
    an assignment round, then need no further one.
    """
    keys = list(keys)
    shared = [k for k in keys if k in edges.columns]
    rest = [c for c in cells.columns if c not in (*keys, "v", "l")]
    kinds = dict(cells.dtypes)
    own = cells.select(*keys, "v", "l", *rest, F.lit(0.0).alias("_in"), F.lit(True).alias("_own"))
    sent = (
        cells.select(*keys, F.col("v").alias("src"), "l", F.col("lam").alias("_in"))
        .join(edges.select(*shared, "src", "dst"), [*shared, "src"])
        .select(*keys, F.col("dst").alias("v"), "l", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], "_in", F.lit(False).alias("_own"))
    )
    met = own.unionByName(sent).repartition(*keys, "v").groupBy(*keys, "v", "l")
    same = met.agg(F.sum("_in").alias("_same"), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in rest])
    total = same.withColumn("_all", F.sum("_same").over(W.partitionBy(*keys, "v"))).filter("_own")
    return total.select(*keys, "v", "l", *rest, (F.col("_all") - F.col("_same")).alias("v_potts"))


def reach(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], radius: float | None = None, max_rounds: int | None = None) -> DataFrame:
    """Shortest distance from each root's seed set to every vertex within ``radius`` (inclusive).

    ``seeds`` holds ``keys, v, d``; ``keys`` include the root (a parcel, a source).
    Only vertices improved in the last round send distances on, and candidates
    are reduced by ``min`` before they shuffle.
    """
    keys = list(keys)
    shared = [k for k in keys if k in edges.columns]
    hop = edges.select(*shared, "src", "dst", "w")
    state = cut(seeds.groupBy(*keys, "v").agg(F.min("d").alias("d")).withColumn("fresh", F.lit(True)))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        sent = (
            state.filter("fresh").select(*keys, F.col("v").alias("src"), "d").join(hop, [*shared, "src"])
            .select(*keys, F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        )
        if radius is not None:
            sent = sent.filter(F.col("d") <= radius)
        both = state.select(*keys, "v", "d", F.col("d").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("double")))
        merged = both.groupBy(*keys, "v").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        state = cut(merged.select(*keys, "v", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh")))
        if state.filter("fresh").isEmpty():
            break
    return state.drop("fresh")


def radius_mask(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], radius: float, label: str = "label") -> DataFrame:
    """Vertices each parcel may claim: its own, and those within ``radius`` of its rim.

    A parcel vertex seeds the search if any neighbour carries another label,
    zero included; interior vertices are in the mask without a search.
    """
    keys = list(keys)
    inside = vertices.filter(F.col(label) > 0).select(*keys, "v", F.col(label).alias("l"))
    rim = (
        _ends(edges, vertices.select(*keys, "v", label), keys, label)
        .filter((F.col("own") > 0) & (F.col("own") != F.col("other")))
        .select(*keys, F.col("own").alias("l"), F.col("src").alias("v"), F.lit(0.0).alias("d"))
        .distinct()
    )
    near = _near_parcels(rim, edges, keys, radius)
    return near.unionByName(inside).distinct()


def _near_parcels(rim: DataFrame, edges: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """``keys, v, l`` within ``radius`` of the parcel's rim; a block holds whole parcels and one mesh's edges."""
    shared, cells = [k for k in keys if k in edges.columns], paths.CELLS

    def per_block(rows: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            mesh = paths.Mesh.of(e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy(), rows["v"].to_numpy())
            parcels, owner = np.unique(rows["l"].to_numpy(), return_inverse=True)
            starts, step = mesh.place(rows["v"].to_numpy()), max(1, cells // len(mesh.ids))
            for at in range(0, len(parcels), step):
                mine = (owner >= at) & (owner < at + step)
                dist, _ = paths.search(mesh, owner[mine] - at, starts[mine], min(step, len(parcels) - at), limit=radius)
                p, v = np.nonzero(np.isfinite(dist))
                out.append(pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "v": mesh.ids[v], "l": parcels[at + p]}))
        cols = [*keys, "v", "l"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    kinds = dict(rim.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "v", "l"])
    return block_apply(rim.select(*keys, "v", "l"), edges.select(*shared, "src", "dst", "w"), keys, "l", per_block, schema, rows_per_block=16384)


def source_set_distance(sources: DataFrame, edges: DataFrame, targets: DataFrame, keys: Sequence[str], side: str, parcel: str) -> DataFrame:
    """Mean geodesic distance between every source of a side and a parcel's vertices.

    Distances run per source on blocks of sources and stop once a source has
    settled every target of its mesh; only the per-target sums of a block leave the
    task, so the source-by-vertex table never exists. A target that a source can't
    reach adds nothing to the sum but counts.
    """
    keys = list(keys)
    goals = targets.select(*keys, F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("goal")).distinct()
    model = edges.select(*keys, "src", "dst", F.col("w").cast("double"), F.lit(False).alias("goal")).unionByName(goals)
    cells = paths.CELLS

    def per_block(rows: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and e["goal"].any():
            wanted, e = e.loc[e["goal"], "src"].to_numpy(), e[~e["goal"]]
            mesh = paths.Mesh.of(e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy(), np.concatenate([rows["v"].to_numpy(), wanted]))
            goal, step = mesh.place(wanted), max(1, cells // len(mesh.ids))
            for name, grp in rows.groupby(side):
                starts, total = mesh.place(grp["v"].to_numpy()), 0.0
                for at in range(0, len(starts), step):
                    part = starts[at : at + step]
                    dist = paths.search(mesh, np.arange(len(part)), part, len(part), goal)[0][:, goal]
                    total = total + np.where(np.isfinite(dist), dist, 0.0).sum(0)
                out.append(pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, side: name, "v": wanted, "d": total, "n": len(grp)}))
        cols = [*keys, side, "v", "d", "n"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    kinds = dict(edges.dtypes) | dict(sources.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, side]) + ", v long, d double, n long"
    sums = block_apply(sources.select(*keys, side, "v"), model, keys, "v", per_block, schema, rows_per_block=256)
    per_vertex = sums.groupBy(*keys, side, "v").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return per_vertex.join(targets.select(*keys, "v", parcel), [*keys, "v"]).groupBy(*keys, parcel, side).agg(
        (F.sum("d") / F.sum("n")).alias("mean_distance")
    )


def geodesic_distances(values: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All-pairs shortest paths on each mesh, one row per source.

    An edge costs the mean of its two ends' values; distances are divided by the
    mesh's largest one. A mesh in several pieces is an error. Sources are split
    into blocks of rows, each holding one mesh's edges and its share of rows.
    """
    keys = list(keys)
    priced = _ends(edges, values.select(*keys, "v", value), keys, value).select(*keys, "src", "dst", ((F.col("own") + F.col("other")) / 2.0).alias("w"))

    def per_block(rows: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "src", "dist"]
        if not len(rows):
            return pd.DataFrame(columns=cols)
        mesh = paths.Mesh.of(e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy(), rows["v"].to_numpy())
        dist, _ = paths.search(mesh, np.arange(len(rows)), mesh.place(rows["v"].to_numpy()), len(rows))
        if not np.isfinite(dist).all() or rows["_n"].iloc[0] != len(mesh.ids):
            raise ValueError("the mesh is not connected")
        return pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "src": rows["v"].to_numpy(), "dist": list(dist)})[cols]

    kinds = dict(values.dtypes)
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", src long, dist array<double>"
    raw = cut(block_apply(values.select(*keys, "v").join(n, keys), priced, keys, "v", per_block, schema, rows_per_block=256))
    top = raw.groupBy(*keys).agg(F.max(F.array_max("dist")).alias("_top"))
    return raw.join(top, keys).select(*keys, "src", F.transform("dist", lambda x: F.when(F.col("_top") > 0, x / F.col("_top")).otherwise(x)).alias("dist"))
