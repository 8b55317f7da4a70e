"""Step 1: binary connectivity profiles, cohort mean, parcel centroids, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.functions import bits
from surfparc.functions.special import inv_ad
from surfparc.functions.vectors import binarize, demean_unit_nonzero
from surfparc.operators import aggregates as agg
from surfparc.operators import connectedness as con
from surfparc.operators import correlation as cor
from surfparc.operators import filters, graph, mesh, ranking
from surfparc.session import cut


def binary_profiles(bold: DataFrame, vertices: DataFrame, seed_order: int, n_seeds: int, fraction: float) -> DataFrame:
    """``sub, sess, v, words``: strongest correlations with the seeds, wall rows zero.

    ``bold (sub, sess, run, v, ts)`` may hold several runs per session; their
    correlations are averaged before one threshold per subject and session is
    applied to all vertices together. ``vertices`` with a column ``hemi`` are both
    hemispheres stacked, and each gives its own seeds.
    """
    keys = ["sub", "sess", "run"]
    if "hemi" in vertices.columns:
        chosen = filters.two_sided_seeds(vertices, ["sub"], "v", "hemi", "mars", seed_order)
    else:
        chosen = filters.seed_vertices(vertices, "v", "mars", seed_order)
    seeds = bold.join(chosen.select("sub", "v"), ["sub", "v"]).select(*keys, "v", "ts")
    corr = cor.seed_correlation(bold, seeds, keys, "v", "ts")
    mean = cut(agg.mean_of_few(corr, ["sub", "sess", "v"], "corr", "corr"))
    cut_at = ranking.top_fraction_threshold(mean.select("sub", "sess", F.explode("corr").alias("c")), ["sub", "sess"], "c", fraction)
    on = mean.join(cut_at, ["sub", "sess"]).join(vertices.select("sub", "v", "mars"), ["sub", "v"])
    on = filters.zero_wall_profiles(on.withColumn("bits", binarize(F.col("corr"), F.col("threshold"))), F.col("mars") == 1, "bits")
    return on.select("sub", "sess", "v", bits.pack(F.col("bits"), n_seeds).alias("words"))


def normalized_profiles(packed: DataFrame, n_seeds: int) -> DataFrame:
    """``sub, t, v, x`` as the EM reads it: demeaned, scaled, all-zero rows zero."""
    s = bits.with_packed_stats(packed, "words", n_seeds)
    return s.select("sub", (F.col("sess") - 1).alias("t"), "v", bits.normalized(F.col("words"), n_seeds).alias("x"))


def packed_profiles(packed: DataFrame, n_seeds: int) -> DataFrame:
    """The same rows still packed: words, the two values a bit can take, and whether any value is non-zero."""
    s = bits.with_packed_stats(packed, "words", n_seeds)
    live = (F.col("ones") > 0) & (F.col("ones") < n_seeds)
    return s.select("sub", (F.col("sess") - 1).alias("t"), "v", "words", "value_on", "value_off", F.lit(n_seeds).alias("width"), live.alias("live"))


def mean_profiles(packed: DataFrame, n_seeds: int) -> DataFrame:
    return agg.gather_vectors(agg.cohort_mean_profile(packed, ["v"], "words", n_seeds), ["v"], "mean", "avg")


def group_start(mean: DataFrame, labels: DataFrame, dim: int) -> tuple[DataFrame, float]:
    """Parcel centroids of the cohort mean and the starting inter-subject concentration."""
    unit = demean_unit_nonzero(mean, "avg", "x").join(labels, "v")
    cent = agg.gather_vectors(agg.parcel_centroids(unit, "label", "x"), ["label"], "mtc", "mtc")
    fit = agg.own_parcel_cosine(unit, cent.withColumnRenamed("mtc", "centroid"), "label", "x").first()
    return cent.withColumnRenamed("label", "l"), float(inv_ad(dim, fit["rbar"])[0])


def spatial_mask(vertices: DataFrame, faces: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """``v, l`` cells within reach of a parcel, less what anatomy rules out.

    ``vertices`` carries ``label`` and the anatomical ``region``. Edge lengths are
    taken after the mesh is rescaled to the area of a sphere of radius 100. With a
    column ``hemi`` each hemisphere is a mesh of its own, and a parcel, which lies
    in one of them, gets no cells in the other.
    """
    if "hemi" in vertices.columns and "hemi" not in keys:
        sided = faces.join(vertices.select(*keys, F.col("v").alias("v0"), "hemi"), [*keys, "v0"])
        return spatial_mask(vertices, sided, [*keys, "hemi"], radius)
    scaled = mesh.rescale_area(vertices, faces, keys)
    edges = cut(mesh.with_length(mesh.edges_from_faces(faces, keys), scaled, keys))
    near = graph.radius_mask(scaled, edges, keys, radius)
    profile = cut(con.region_profile(scaled, keys, "label", "region"))
    wanted = profile.filter((F.col("central")[0] >= 0.999) | (F.col("central")[3] >= 0.999)).select(*keys, "label")
    sides = scaled.filter(F.col("region").isin(25, 23)).withColumn("side", F.when(F.col("region") == 25, "pre").otherwise("post"))
    targets = scaled.join(wanted, [*keys, "label"], "left_semi")
    mean = graph.source_set_distance(sides, edges, targets, keys, "side", "label")
    both = mean.groupBy(*keys, "label").agg(
        F.max(F.when(F.col("side") == "pre", F.col("mean_distance"))).alias("pre"), F.max(F.when(F.col("side") == "post", F.col("mean_distance"))).alias("post")
    )
    return con.truncate_mask(near, scaled, profile, both, keys, "label", "region")
