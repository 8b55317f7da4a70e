"""Distributed-parcel test and anatomical truncation of parcel masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.functions.vectors import safe_div
from surfparc.operators.aggregates import overlap
from surfparc.operators.graph import boundary_vertices, component_counts, components, remove_isolated
from surfparc.operators.surface import nearest
from surfparc.session import cut


def component_distance(vertices: DataFrame, edges: DataFrame, comps: DataFrame, keys: Sequence[str], n_labels: int, spacing: float, label: str = "label") -> DataFrame:
    """Per parcel, the largest gap between a component and its nearest sibling.

    Only parcels in more than one piece take part and only their boundary
    vertices are compared. The nearest vertex of another component comes from a
    cube search, never from all pairs of a parcel. Parcels in one piece give 0.
    """
    keys = list(keys)
    counts = component_counts(comps, keys, label)
    many = counts.filter(F.col("n_comp") > 1).select(*keys, label)
    kept = vertices.join(many.withColumn("_many", F.lit(True)), [*keys, label], "left").withColumn(
        label, F.when(F.col("_many"), F.col(label)).otherwise(0)
    ).drop("_many")
    rim = boundary_vertices(kept, edges, keys, label, fake=2 * n_labels + 1).filter(F.col(label) != 0)
    pts = cut(rim.join(comps.select(*keys, "v", "comp"), [*keys, "v"]).select(*keys, label, "v", "comp", "x", "y", "z"))
    near = nearest(pts, pts.withColumnRenamed("v", "other"), [*keys, label], "v", "other", spacing, apart="comp", settle=["comp"])
    gap = near.join(pts.select(*keys, label, "v", "comp"), [*keys, label, "v"]).groupBy(*keys, label, "comp").agg(F.min("distance").alias("d"))
    far = gap.groupBy(*keys, label).agg(F.max("d").alias("distance"))
    return counts.join(far, [*keys, label], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def connectedness(
    vertices: DataFrame, edges: DataFrame, gamma: DataFrame, keys: Sequence[str], n_labels: int, max_distance: float,
    max_components: int, spacing: float, isolated_below: int | None = None, label: str = "label",
) -> DataFrame:
    """Flag distributed parcels and add 1000 to their sphere concentration.

    A parcel is distributed when a piece lies further than ``max_distance`` from
    the rest or when it has more than ``max_components`` pieces. With
    ``isolated_below`` small pieces are first relabelled by their neighbours.
    """
    keys = list(keys)
    v = vertices if isolated_below is None else remove_isolated(vertices, edges, keys, isolated_below, label)
    comps = components(v, edges, keys, label)
    d = component_distance(v, edges, comps, keys, n_labels, spacing, label)
    d = d.withColumn("distributed", (F.col("distance") > max_distance) | (F.col("n_comp") > max_components))
    joined = gamma.join(d, [*keys, label], "left").withColumn("distributed", F.coalesce("distributed", F.lit(False)))
    return joined.withColumn("gamma", F.col("gamma") + F.when(F.col("distributed"), 1000.0).otherwise(0.0))


# One-based anatomical codes. Relabelled first, then six groups in
# the order paracentral, postcentral, precentral, insula, frontal, parietal.
REGION_ALIASES = {4: 19, 29: 19, 32: 30}
REGION_GROUPS = [18, 23, 25, 36, 19, 30]


def region_profile(vertices: DataFrame, keys: Sequence[str], label: str, region: str) -> DataFrame:
    """Per parcel, its share in six regions relative to the largest of them (array ``central``)."""
    keys = list(keys)
    code = F.col(region)
    for a, b in REGION_ALIASES.items():
        code = F.when(F.col(region) == a, b).otherwise(code)
    marked = vertices.filter((F.col(label) >= 1) & (F.col(region) >= 1)).withColumn("_r", code)
    share = overlap(marked, [*keys, label], "_r")
    six = share.groupBy(*keys, label).agg(*[F.max(F.when(F.col("_r") == g, F.col("share")).otherwise(0.0)).alias(f"_g{i}") for i, g in enumerate(REGION_GROUPS)])
    top = F.greatest(*[F.col(f"_g{i}") for i in range(6)])
    six = six.withColumn("_t", top)
    c = [safe_div(F.col(f"_g{i}"), F.col("_t")) for i in range(6)]
    post = F.when((F.col("_g1") != 0) & (F.col("_g2") == 0), 1.0).otherwise(c[1])
    pre = F.when((F.col("_g1") == 0) & (F.col("_g2") != 0), 1.0).otherwise(c[2])
    return six.select(*keys, label, F.array(c[0], post, pre, c[3], c[4], c[5]).alias("central"))


def truncate_mask(mask: DataFrame, vertices: DataFrame, profile: DataFrame, distances: DataFrame, keys: Sequence[str], label: str, region: str) -> DataFrame:
    """Drop mask cells in regions a parcel's anatomy rules out.

    Six rules, one per region group a parcel dominates. Paracentral and insular
    parcels keep what they overlap by a fifth and only the central bank they are
    nearer to; the central banks keep themselves and a few companions; frontal
    parcels lose the postcentral side, parietal ones the precentral side.
    ``distances`` holds ``pre`` and ``post`` mean distances per parcel.
    """
    keys = list(keys)
    sure = 0.999
    p = profile.join(distances, [*keys, label], "left")
    c = [F.col("central")[i] for i in range(6)]
    nearer_pre = F.coalesce(F.col("pre") - F.col("post") < 0, F.lit(False))
    yes, no = F.lit(True), F.lit(False)
    either = [c[0] > 0.2, ~nearer_pre, nearer_pre, c[3] > 0.2, yes, yes]
    rules = [
        either,
        [yes, c[1] >= sure, c[2] >= sure, yes, c[4] >= sure, yes],
        [yes, c[1] >= sure, c[2] >= sure, yes, yes, c[5] >= sure],
        either,
        [yes, no, yes, yes, yes, yes],
        [yes, yes, no, yes, yes, yes],
    ]
    dropped = [F.lit(False)] * 6
    for i, rule in enumerate(rules):
        dropped = [d | ((c[i] >= sure) & ~k) for d, k in zip(dropped, rule)]
    gone = p.select(*keys, F.col(label).alias("l"), F.explode(F.array(*[F.when(d, g) for d, g in zip(dropped, REGION_GROUPS)])).alias("_r")).filter("_r is not null")
    code = F.col(region)
    for a, b in REGION_ALIASES.items():
        code = F.when(F.col(region) == a, b).otherwise(code)
    where = vertices.select(*keys, "v", code.alias("_r"))
    return mask.join(where, [*keys, "v"]).join(gone, [*keys, "l", "_r"], "left_anti").select(*keys, "v", "l")
