"""From a project's files to the tables a run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.operators import filters, ranking
from surfparc.sources import surface_files, tables

SIDES = ("lh", "rh")


def _local(path: str):
    """Paths as a manifest and as a scan name them differ in the scheme alone."""
    return F.regexp_replace(path, "^file:/*", "/")


def series_from_manifest(spark: SparkSession, manifest: DataFrame, project: str, n_left: int, n_right: int, censor: DataFrame | None = None) -> DataFrame:
    """``sub, sess, run, v, ts`` of every session in a manifest, both hemispheres stacked.

    Relative paths lie under ``project``; the right hemisphere's vertices follow
    the left one's ``n_left``. A missing file, or one with another number of
    vertices, stops the job. ``censor (path, keep)`` drops time points of the
    files it names. Values that aren't numbers become zero.
    """
    sided = None
    for hemi, first, n in (("lh", 0, n_left), ("rh", n_left, n_right)):
        wanted = manifest.select("sub", "sess", tables.resolved(hemi, project).alias("path"))
        paths = [r[0] for r in wanted.select("path").distinct().collect()]  # file names: a line each in the manifest
        found = surface_files.read_series(spark, paths, expected=n).withColumn("path", _local("path"))
        rows = wanted.withColumn("path", _local("path")).join(found, "path")
        rows = rows.select("sub", "sess", F.lit(1).alias("run"), (F.col("v") + first).alias("v"), "path", F.col("ts").cast("array<double>").alias("ts"))
        sided = rows if sided is None else sided.unionByName(rows)
    if censor is not None:
        flags = censor.select(_local("path").alias("path"), "keep")
        joined = sided.join(flags, "path", "left")
        sided = joined.withColumn("ts", F.when(F.col("keep").isNull(), F.col("ts")).otherwise(filters.censor(F.col("ts"), F.col("keep"))))
    clean = F.transform("ts", lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x))
    return sided.select(F.col("sub").cast("long").alias("sub"), "sess", "run", "v", clean.alias("ts"))


def group_mesh(spark: SparkSession, meshes: dict[str, str], annotations: dict[str, str], n_parcels_left: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, hemi, x, y, z, label, mars) and faces of both hemispheres, stacked.

    ``meshes`` and ``annotations`` name one file per side. Vertices without a
    label are the medial wall. The right side's vertices, faces and labels are
    numbered after the left one's.
    """
    vertices, faces, first_v, first_f = None, None, 0, 0
    for hemi in SIDES:
        points, triangles = surface_files.read_mesh(spark, meshes[hemi])
        labels = surface_files.group_labels(surface_files.read_annotation(spark, annotations[hemi])).select("v", "label")
        v = points.join(labels, "v").select((F.col("v") + first_v).alias("v"), F.lit(hemi).alias("hemi"), "x", "y", "z", "label")
        f = triangles.select((F.col("f") + first_f).alias("f"), *[(F.col(c) + first_v).alias(c) for c in ("v0", "v1", "v2")])
        vertices = v if vertices is None else vertices.unionByName(v)
        faces = f if faces is None else faces.unionByName(f)
        first_v, first_f = first_v + points.count(), first_f + triangles.count()
    vertices = ranking.stack_labels(vertices, "hemi", "label", n_parcels_left)
    return vertices.withColumn("mars", F.when(F.col("label") == 0, 1).otherwise(2)), faces


def read_prior(spark: SparkSession, project: str) -> dict[str, DataFrame]:
    """``theta (v, l, theta)`` and ``parcel (l, mu, sigma, eps)`` that a training run has stored."""
    parcel = tables.read(spark, project, "prior_parcel").select(F.col("l").cast("int").alias("l"), "mu", "sigma", "eps")
    theta = tables.read(spark, project, "prior_theta").select("v", F.col("l").cast("int").alias("l"), "theta")
    return {"theta": theta, "parcel": parcel}
