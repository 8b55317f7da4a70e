"""Artifacts as Parquet tables, manifests as JSON, lists as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.operators.ledger import manifest_defects
from surfparc.sources import versions

MANIFEST = (
    "schema_version string, dataset_name string, targ_mesh string, seed_mesh string, "
    "subjects array<struct<id string, sessions array<struct<id string, lh string, rh string>>>>"
)
# Partitioning of each artifact; a reader of one subject or session skips the rest.
LAYOUT = {
    "profile": ["sub", "sess"], "gradient": ["sub"], "mean_profile": [], "group": [], "mask": ["hemi"], "prior_parcel": [], "prior_theta": [],
    "labels": ["sub"], "distance": ["sub", "hemi"], "edge_density": ["sub"],
}
# Artifacts that several runs may change at once, see ``versions``.
VERSIONED = ("ledger",)


def write(df: DataFrame, project: str, artifact: str, overwrite: bool = True) -> str:
    """Write one artifact. Only the partitions present are replaced, so sessions may come in any order."""
    folder, by = f"{project}/{artifact}", LAYOUT[artifact]
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(folder)
    return folder


def read(spark: SparkSession, project: str, artifact: str, **where) -> DataFrame:
    """Read one artifact; equality filters on partition columns prune files."""
    df = spark.read.parquet(versions.current(spark, project, artifact) if artifact in VERSIONED else f"{project}/{artifact}")
    # Numeric partition ids come back as int; ids are bigint everywhere else.
    df = df.withColumns({k: F.col(k).cast("long") for k, t in df.dtypes if k in LAYOUT.get(artifact, []) and t == "int"})
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df


def read_gradient(spark: SparkSession, project: str, n_components: int, **where) -> DataFrame:
    """First ``n_components`` of the embedding; fewer is an error."""
    g = read(spark, project, "gradient", **where)
    short = F.raise_error(F.lit(f"gradient has fewer than {n_components} components")).cast("array<double>")
    return g.withColumn("grad", F.when(F.size("grad") < n_components, short).otherwise(F.slice("grad", 1, n_components)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of list files, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line") != "")


def read_censor(spark: SparkSession, path: str) -> DataFrame:
    """``path, keep``: one flag array per censor file (a run's frames, one file one row)."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("int")).alias("keep"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Flat ``dataset, sub, sess, lh, rh``; a defective manifest is refused."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = m.select("schema_version", "dataset_name", "targ_mesh", "seed_mesh", F.size("subjects").alias("n")).first()
    missing = [k for k in ("dataset_name", "targ_mesh", "seed_mesh") if head[k] is None]
    if head["schema_version"] != "1" or missing or (head["n"] or 0) <= 0:
        raise ValueError(f"manifest version {head['schema_version']!r}, missing {missing}, {head['n']} subjects")
    s = m.select(F.posexplode("subjects").alias("_i", "_s"))
    e = s.select(F.col("_i"), F.trim("_s.id").alias("sub"), F.posexplode("_s.sessions").alias("_j", "_t"), F.size("_s.sessions").alias("_n"))
    flat = e.select("_i", "_j", "_n", "sub", F.trim("_t.id").alias("sess"), F.trim("_t.lh").alias("lh"), F.trim("_t.rh").alias("rh"))
    bad = flat.filter((F.col("sub") != (F.col("_i") + 1).cast("string")) | (F.col("sess") != (F.col("_j") + 1).cast("string")))
    if not bad.isEmpty():
        raise ValueError(f"ids must count up from 1: {bad.first().asDict()}")
    if flat.select("_n").distinct().count() > 1 or s.count() != flat.select("sub").distinct().count():
        raise ValueError("subjects differ in their number of sessions")
    typed = flat.select("sub", F.col("sess").cast("int").alias("sess"), "lh", "rh")
    defects = manifest_defects(typed)
    if not defects.isEmpty():
        raise ValueError(f"sessions need .gii paths for both hemispheres: {defects.first().asDict()}")
    return typed.withColumn("dataset", F.lit(head["dataset_name"]))


def missing_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest paths without a listed file."""
    want = manifest.select(F.explode(F.array("lh", "rh")).alias("path"))
    return want.join(found.select("path"), "path", "left_anti")



def subject(ledger: DataFrame, sub: str) -> DataFrame:
    """One subject's ledger row; an unknown id is an error."""
    hit = ledger.filter(F.col("id") == str(sub))
    if hit.isEmpty():
        raise KeyError(f"subject {sub!r} is not in the ledger")
    return hit


def resolved(path_column: str, project: str):
    """Absolute paths as they are, relative ones under the project."""
    c = F.col(path_column)
    return F.when(c.startswith("/") | c.rlike("^[A-Za-z]:\\\\") | c.contains("://"), c).otherwise(F.concat(F.lit(f"{project}/"), c))
