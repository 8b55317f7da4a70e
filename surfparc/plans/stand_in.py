"""Domain tables derived from the generic input tables.

These are stand-ins, not neuro-imaging data: they give every operator rows of the
right shape whose number grows with the inputs. A subject is a run of 250 vectors
laid out on a 10 x 25 grid; its profile is the vector, its parcel the label (0 is
the wall). Users are vertices of a time series sampled by day, event types its runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.functions.vectors import let
from surfparc.operators.mesh import lattice_edges, with_length

MESH_SIZE = 250
WIDTH = 25
DIM = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mesh(spark: SparkSession, folder: str) -> DataFrame:
    """``sub, v, gr, gc, label, x, y, z, mars, emb``."""
    e = table(spark, folder, "embeddings")
    v = F.col("vec_id") % MESH_SIZE
    return e.select(
        F.floor(F.col("vec_id") / MESH_SIZE).alias("sub"), v.alias("v"), F.floor(v / WIDTH).alias("gr"), (v % WIDTH).alias("gc"), "label",
        ((v % WIDTH) * F.lit(10.0)).alias("x"), (F.floor(v / WIDTH) * F.lit(10.0)).alias("y"), (F.col("embedding")[0].cast("double") * 10.0).alias("z"),
        F.when(F.col("label") == 0, 1).otherwise(2).alias("mars"), F.col("embedding").cast("array<double>").alias("emb"),
    )


def grid_edges(m: DataFrame) -> DataFrame:
    """Four-neighbour edges with lengths."""
    return with_length(lattice_edges(m.select("sub", "v", "gr", "gc"), ["sub"], "v", "gr", "gc"), m, ["sub"])


def grid_faces(m: DataFrame) -> DataFrame:
    """Two triangles per grid square whose four corners exist."""
    v = m.select("sub", "v", "gc").filter(F.col("gc") < WIDTH - 1)
    far = m.select("sub", (F.col("v") - WIDTH - 1).alias("v"))
    square = v.join(far, ["sub", "v"], "left_semi").select("sub", "v")
    a, b, c, d = F.col("v"), F.col("v") + 1, F.col("v") + WIDTH, F.col("v") + WIDTH + 1
    two = F.array(
        F.struct((a * 2).alias("f"), a.alias("v0"), b.alias("v1"), c.alias("v2")), F.struct((a * 2 + 1).alias("f"), b.alias("v0"), d.alias("v1"), c.alias("v2"))
    )
    return square.select("sub", F.explode(two).alias("_t")).select("sub", "_t.*")


def profile(m: DataFrame, sessions: int = 1) -> DataFrame:
    """``sub, t, v, x``: the vector, shifted a little per session, zero at the wall."""
    t = F.explode(F.sequence(F.lit(0), F.lit(sessions - 1)))
    x = F.transform("emb", lambda e, i: F.when(F.col("label") == 0, 0.0).otherwise(e + F.col("t") * 0.01 * ((i % 5) - 2)))
    return m.select("sub", "v", "label", "emb", t.alias("t")).select("sub", "t", "v", x.alias("x"))


def day_series(spark: SparkSession, folder: str) -> DataFrame:
    """``run, v, ts``: mean event value per user and day, zero where nothing happened.

    Events are averaged per day before the days of a user meet, so a user with a
    third of all events contributes no more rows than there are days.
    """
    e = table(spark, folder, "events")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first, last = span["a"].date(), span["b"].date()
    day = F.datediff(F.col("ts").cast("date"), F.lit(first))
    daily = e.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("v"), day.alias("t")).agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n"))
    days = daily.groupBy("run", "v").agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("_m"))
    n = (last - first).days + 1
    filled = let(F.col("_m"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.coalesce(F.element_at(m, t), F.lit(0.0))))
    return days.select("run", "v", filled.alias("ts"))


def day_flags(spark: SparkSession, folder: str) -> DataFrame:
    """``run, keep``: one flag per day, set where a run has at least its mean number of events."""
    e = table(spark, folder, "events")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first, last = span["a"].date(), span["b"].date()
    n = (last - first).days + 1
    c = e.groupBy(F.col("event_type").alias("run"), F.datediff(F.col("ts").cast("date"), F.lit(first)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("_m"), (F.sum("n") / F.lit(float(n))).alias("_a"))
    flags = let(
        F.struct("_m", "_a"),
        lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.when(F.coalesce(F.element_at(s["_m"], t), F.lit(0)) >= s["_a"], 1).otherwise(0)),
    )
    return m.select("run", flags.alias("keep"))
