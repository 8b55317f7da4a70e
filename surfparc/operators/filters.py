"""Row and cell selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.functions.vectors import nan_to_zero


def concat_hemispheres(lh: DataFrame, rh: DataFrame, vertex: str, n_lh: int, medial: str, series: str) -> DataFrame:
    """Stack left over right, clean the series, drop medial-wall rows."""
    left = lh.withColumn("hemi", F.lit("lh"))
    right = rh.withColumn("hemi", F.lit("rh")).withColumn(vertex, F.col(vertex) + n_lh)
    both = left.unionByName(right).filter(~F.col(medial))
    return both.withColumn(series, F.transform(series, nan_to_zero))


def zero_wall_profiles(df: DataFrame, wall: Column, profile: str) -> DataFrame:
    """Zero the whole profile at wall vertices and flag rows that keep a non-zero."""
    cleared = F.when(wall, F.transform(profile, lambda x: x * 0)).otherwise(F.col(profile))
    return df.withColumn(profile, cleared).withColumn("keep", F.exists(profile, lambda x: x != 0))


def censor(series: Column, keep: Column) -> Column:
    """Keep time points whose flag is one; the lengths have to agree."""
    checked = F.when(
        F.size(series) != F.size(keep), F.raise_error(F.lit("censor vector and series differ in length")).cast("array<double>")
    ).otherwise(series)
    return F.filter(checked, lambda x, i: F.get(keep, i) == 1)


def seed_vertices(vertices: DataFrame, vertex: str, mars: str, order: int) -> DataFrame:
    """Cortical vertices among the first ``10 * 4**order + 2``: the coarser mesh."""
    return vertices.filter((F.col(vertex) < 10 * 4**order + 2) & (F.col(mars) == 2))


def two_sided_seeds(vertices: DataFrame, keys: Sequence[str], vertex: str, hemi: str, mars: str, order: int) -> DataFrame:
    """Seeds of a stacked brain: the coarser mesh of each hemisphere, whose ids count from its own first vertex."""
    first = vertices.groupBy(*keys, hemi).agg(F.min(vertex).alias("_first"))
    own = vertices.join(first, [*keys, hemi]).withColumn("_own", F.col(vertex) - F.col("_first"))
    return seed_vertices(own, "_own", mars, order).drop("_first", "_own")


def same_side_cells(cells: DataFrame, hemi: str, parcel: str, n_left: int, left: str = "lh") -> DataFrame:
    """Cells of a vertex with parcels of its own hemisphere: the first ``n_left`` belong to the left one."""
    return cells.filter((F.col(hemi) == left) == (F.col(parcel) <= n_left))


def drop_vertices_from_edges(edges: DataFrame, keep: DataFrame, keys: Sequence[str], vertex: str) -> DataFrame:
    """Edges with both ends kept, renumbered to consecutive ids from zero.

    The renumbering window runs per mesh (``keys``), so its size is that of one
    mesh whatever the number of meshes.
    """
    order = W.partitionBy(*keys).orderBy(vertex)
    ids = keep.select(*keys, vertex).distinct().withColumn("new_id", (F.row_number().over(order) - 1).cast("long"))
    src = ids.select(*keys, F.col(vertex).alias("src"), F.col("new_id").alias("new_src"))
    dst = ids.select(*keys, F.col(vertex).alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"])


def active_edges(edges: DataFrame, cells: DataFrame, keys: Sequence[str], vertex: str, value: str) -> DataFrame:
    """Edges between vertices whose row of cells sums to a non-zero value."""
    live = cells.groupBy(*keys, vertex).agg(F.sum(value).alias("_t")).filter(F.col("_t") != 0).drop("_t")
    on_src = live.withColumnRenamed(vertex, "src")
    on_dst = live.withColumnRenamed(vertex, "dst")
    return edges.join(on_src, [*keys, "src"], "left_semi").join(on_dst, [*keys, "dst"], "left_semi")


def candidate_cells(theta: DataFrame, mask: DataFrame, on: Sequence[str]) -> DataFrame:
    """Non-zero prior cells inside the spatial mask.

    The prior must be non-negative and must not reach outside the mask; a row
    that does either fails the job where it is met.
    """
    marked = theta.filter(F.col("theta") != 0).join(mask.select(*on).distinct().withColumn("_in", F.lit(True)), list(on), "left")
    bad = (F.col("theta") < 0) | F.col("_in").isNull()
    checked = F.when(bad, F.raise_error(F.lit("prior cell is negative or outside the spatial mask")).cast("double")).otherwise(F.col("theta"))
    return marked.withColumn("theta", checked).drop("_in")


def densify(cells: DataFrame, domain: DataFrame, on: Sequence[str], value: str, fill: float = 0.0) -> DataFrame:
    """Scatter sparse cells over a given domain; absent cells take ``fill``."""
    return domain.join(cells, list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def block_diagonal_mask(lh: DataFrame, rh: DataFrame, vertex: str, parcel: str, n_lh: int, l_lh: int) -> DataFrame:
    """Both hemispheres' masks as one table; cross-hemisphere blocks are absent rows."""
    moved = rh.withColumn(vertex, F.col(vertex) + n_lh).withColumn(parcel, F.col(parcel) + l_lh)
    return lh.withColumn("hemi", F.lit("lh")).unionByName(moved.withColumn("hemi", F.lit("rh")))


def random_subset(df: DataFrame, keys: Sequence[str], row_id: str, divisor: float, scan: int) -> DataFrame:
    """Seeded sample without replacement of ``round(n / divisor)`` rows per key.

    Rows are ranked by a digest of their id and the scan number, so the draw is
    reproducible on any cluster layout. Halves round to even. Ranking is split by
    digest prefix: counts per prefix give each one its offset, and only rows that
    share a prefix are ever sorted together, however many rows a key has.
    """
    keys = list(keys)
    digest = F.md5(F.concat_ws(":", F.lit(str(scan)), F.col(row_id).cast("string")))
    marked = df.withColumn("_d", digest).withColumn("_p", F.substring("_d", 1, 4))
    counts = marked.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_p")) - F.col("_c")
    total = F.sum("_c").over(W.partitionBy(*keys))
    placed = counts.withColumn("_before", before).withColumn("_n", F.bround(total / F.lit(float(divisor)), 0).cast("long"))
    needed = placed.filter(F.col("_before") < F.col("_n")).drop("_c")
    order = W.partitionBy(*keys, "_p").orderBy("_d", row_id)
    ranked = marked.join(needed, [*keys, "_p"]).withColumn("draw", F.row_number().over(order) + F.col("_before"))
    return ranked.filter(F.col("draw") <= F.col("_n")).drop("_d", "_p", "_before", "_n")


def require_none(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Pass rows through; any row matching ``bad`` fails the job where it is met."""
    first = df.columns[0]
    guarded = F.when(bad, F.raise_error(F.lit(message)).cast(df.schema[first].dataType)).otherwise(F.col(first))
    return df.withColumn(first, guarded)
