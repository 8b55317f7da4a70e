"""Step 0: similarity gradients, watershed edges, geodesic distances, embedding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.operators import aggregates as agg
from surfparc.operators import correlation as cor
from surfparc.operators import filters, graph, mesh, surface
from surfparc.operators.diffusion import diffusion_map
from surfparc.session import cut


@dataclass(frozen=True)
class Knobs:
    sub_fc: float = 100.0
    sub_verts: float = 200.0
    blocks: int = 3
    sigma: float = 2.55
    hops: int = 3
    steps: int = 50
    fraction: float = 1.0
    components: int = 100
    spacing: float = 3.0


def edge_density(bold: DataFrame, vertices: DataFrame, edges: DataFrame, faces: DataFrame, weights: DataFrame, k: Knobs) -> DataFrame:
    """Share of sampled columns in which a vertex lies on a watershed edge.

    ``bold (sub, sess, v, ts)`` holds cortical vertices; ``vertices (sub, v, x, y,
    z, roi)``. Each session draws its own reference and column samples. Column
    ``pos`` of a block is the same in every session, as the gradients of a column
    are averaged over sessions by position.
    """
    parts = []
    sessions = sorted(r[0] for r in bold.select("sess").distinct().collect())
    for sess in sessions:
        b = bold.filter(F.col("sess") == sess).select("sub", "v", "ts")
        columns = filters.random_subset(b, ["sub"], "v", k.sub_verts, 2 * int(sess)).select("sub", "v", "draw")
        refs = filters.random_subset(b, ["sub"], "v", k.sub_fc, 2 * int(sess) + 1).select("sub", "v", "ts")
        sim = cor.profile_similarity(b, refs, columns, ["sub"], "v", "ts")
        order = columns.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("v", "draw"))).alias("_o"))
        placed = sim.join(order, "sub").select("sub", "v", F.explode(F.arrays_zip("_o", "similarity")).alias("_z"))
        parts.append(placed.select("sub", "v", F.col("_z._o.draw").alias("k"), F.col("_z.similarity").alias("x"), F.lit(int(sess)).alias("sess")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    grads = surface.gradient_magnitude(cut(values), vertices, edges, faces, ["sub"], "x", "roi", ["k", "sess"])
    mean = agg.conditional_mean(grads, ["sub", "k", "v"], "gradient").select("sub", "k", "v", F.col("mean").alias("x"))
    calm = cut(agg.weighted_means(mean, weights, ["sub", "k"], "x"))
    inside = edges.join(vertices.filter("roi").select("sub", F.col("v").alias("src")), ["sub", "src"], "left_semi").join(
        vertices.filter("roi").select("sub", F.col("v").alias("dst")), ["sub", "dst"], "left_semi"
    )
    near = mesh.khop(inside, ["sub"], k.hops)
    marked = graph.local_minima(calm, near, ["sub", "k"], "x")
    # Levels span one block of columns; a column's block is its position's share of all columns.
    n = marked.groupBy("sub").agg(F.greatest(F.lit(1), F.floor(F.max("k") / k.blocks)).alias("_w"))
    blocked = marked.join(n, "sub").withColumn("block", F.floor((F.col("k") - 1) / F.col("_w"))).drop("_w")
    blocks = blocked.select("sub", "block").distinct()
    labels = surface.watershed(blocked, inside.join(blocks, "sub"), ["sub", "block"], "k", "x", steps=k.steps, fraction=k.fraction)
    return agg.edge_density(labels, ["sub", "v"], "label").select("sub", "v", "density")


def distances(density: DataFrame, vertices: DataFrame, faces: DataFrame, coarse_vertices: DataFrame, coarse_faces: DataFrame, k: Knobs) -> DataFrame:
    """Geodesic distances ``(sub, src, dist)`` on the coarser sphere, with density as the cost of a step.

    Vertices outside the region of interest count as zero density.
    """
    full = vertices.join(density, ["sub", "v"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    targets = coarse_vertices.withColumnRenamed("v", "target")
    small = surface.interpolate(targets, full, faces, ["sub"], "target", ["density"], k.spacing).select("sub", F.col("target").alias("v"), "density")
    links = mesh.edges_from_faces(coarse_faces, ["sub"])
    return graph.geodesic_distances(cut(small), links, ["sub"], "density")


def embed(dist: DataFrame, vertices: DataFrame, coarse_vertices: DataFrame, coarse_faces: DataFrame, k: Knobs) -> DataFrame:
    """Diffusion coordinates of every vertex, computed on the coarser sphere and carried back; zero outside the region of interest."""
    emb = diffusion_map(dist, ["sub"], k.components)
    wide = coarse_vertices.join(emb.select("sub", "v", *[F.col("emb")[i].alias(f"e{i}") for i in range(k.components)]), ["sub", "v"])
    up = surface.interpolate(vertices.withColumnRenamed("v", "target"), cut(wide), coarse_faces, ["sub"], "target", [f"e{i}" for i in range(k.components)], 2.0 * k.spacing)
    coords = F.array(*[F.col(f"e{i}") for i in range(k.components)])
    out = vertices.select("sub", "v", "roi").join(up.withColumnRenamed("target", "v"), ["sub", "v"])
    return out.select("sub", "v", F.when(F.col("roi"), coords).otherwise(F.transform(coords, lambda x: x * 0.0)).alias("grad"))
