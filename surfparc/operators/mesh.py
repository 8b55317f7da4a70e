"""Triangle meshes as vertex, face and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from surfparc.functions.vectors import safe_div


def lattice_edges(vertices: DataFrame, keys: Sequence[str], vertex: str, row: str, col: str) -> DataFrame:
    """Four-neighbour edges of a grid, both directions, no wrap-around."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    moved = vertices.select(*keys, F.col(vertex).alias("src"), row, col, F.explode(steps).alias("_s")).select(
        *keys, "src", (F.col(row) + F.col("_s.dr")).alias(row), (F.col(col) + F.col("_s.dc")).alias(col)
    )
    ends = vertices.select(*keys, row, col, F.col(vertex).alias("dst"))
    return moved.join(ends, [*keys, row, col]).select(*keys, "src", "dst")


def with_length(edges: DataFrame, vertices: DataFrame, keys: Sequence[str], vertex: str = "v") -> DataFrame:
    """Attach the Euclidean edge length ``w``."""
    xyz = ("x", "y", "z")
    a = vertices.select(*keys, F.col(vertex).alias("src"), *[F.col(c).alias(f"_a{c}") for c in xyz])
    b = vertices.select(*keys, F.col(vertex).alias("dst"), *[F.col(c).alias(f"_b{c}") for c in xyz])
    sq = sum((F.col(f"_a{c}") - F.col(f"_b{c}")) * (F.col(f"_a{c}") - F.col(f"_b{c}")) for c in xyz)
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).withColumn("w", F.sqrt(sq)).drop(*[f"_{s}{c}" for s in "ab" for c in xyz])


def edges_from_faces(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertex-to-vertex incidence: each triangle gives six directed edges, once each."""
    pairs = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    both = pairs + [(b, a) for a, b in pairs]
    arr = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in both])
    return faces.select(*keys, F.explode(arr).alias("_e")).select(*keys, "_e.src", "_e.dst").distinct()


def vertex_faces(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertex-to-face incidence."""
    return faces.select(*keys, "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))


def corners(faces: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Faces with the coordinates of their three corners (``x0 .. z2``)."""
    out = faces
    for i in range(3):
        side = vertices.select(*keys, F.col("v").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
        out = out.join(side, [*keys, f"v{i}"])
    return out


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def inner(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a, b):
    return tuple(p - q for p, q in zip(a, b))


def normals_and_areas(faces: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit vertex normals (sum of face cross products) and a third of the incident area."""
    c = corners(faces, vertices, keys)
    p = [tuple(F.col(f"{a}{i}") for a in "xyz") for i in range(3)]
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    per = c.select(*keys, F.explode(F.array("v0", "v1", "v2")).alias("v"), *[e.alias(k) for e, k in zip(n, ("nx", "ny", "nz"))])
    per = per.withColumn("area", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) * 0.5)
    s = per.groupBy(*keys, "v").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "nz", "area")])
    m = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    s = s.withColumn("_m", m)
    return s.select(*keys, "v", *[safe_div(F.col(k), F.col("_m")).alias(k) for k in ("nx", "ny", "nz")], (F.col("area") / 3.0).alias("area"))


def unfolded_edges(faces: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second-layer edges: straight lines across the shared edge of two triangles.

    The two faces of an interior edge meet in one aggregation (no self-join).
    The far corner is turned into the base triangle's plane; the shortcut counts
    only where the straight line strictly crosses the shared edge.
    """
    halves = F.array(
        *[
            F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(t).alias("third"))
            for a, b, t in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))
        ]
    )
    h = faces.select(*keys, "f", F.explode(halves).alias("h")).select(*keys, "f", "h.*")
    two = (
        h.groupBy(*keys, "lo", "hi")
        .agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("f", "third")).alias("_a"), F.max(F.struct("f", "third")).alias("_b"))
        .filter(F.col("_c") == 2)
        .select(*keys, "lo", "hi", F.col("_a.third").alias("base"), F.col("_b.third").alias("far"))
    )
    # One join brings all four corners' coordinates; an aggregation lines them up per edge.
    roles = ("lo", "hi", "base", "far")
    role = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("v")) for r in roles])).alias("_r")
    placed = two.select("*", role).select(*keys, *roles, "_r.role", "_r.v").join(vertices.select(*keys, "v", "x", "y", "z"), [*keys, "v"])
    pick = [F.max(F.when(F.col("role") == r, F.col(c).cast("double"))).alias(f"_{r}{c}") for r in roles for c in "xyz"]
    at = placed.groupBy(*keys, *roles).agg(*pick)
    pt = {r: tuple(F.col(f"_{r}{c}") for c in "xyz") for r in roles}
    edge, far, base = (minus(pt[r], pt["lo"]) for r in ("hi", "far", "base"))
    dots = {"_ee": inner(edge, edge), "_ef": inner(edge, far), "_eb": inner(edge, base), "_ff": inner(far, far), "_bb": inner(base, base)}
    at = at.select(*keys, "base", "far", *[e.alias(k) for k, e in dots.items()]).filter(F.col("_ee") > 0)
    # Along-edge and perpendicular components of both opposite corners, seen from ``lo``.
    length = F.sqrt("_ee")
    fa, ba = F.col("_ef") / length, F.col("_eb") / length
    at = at.select(
        *keys, "base", "far", length.alias("_len"), fa.alias("_fa"), ba.alias("_ba"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_ff") - fa * fa)).alias("_fp"), F.sqrt(F.greatest(F.lit(0.0), F.col("_bb") - ba * ba)).alias("_bp"),
    )
    along, across = F.col("_fa") - F.col("_ba"), F.col("_bp") + F.col("_fp")
    crossing = F.col("_ba") + along * safe_div(F.col("_bp"), across)
    ok = (F.col("_bp") > 0) & (crossing > 0) & (crossing < F.col("_len"))
    kept = at.filter(ok).select(*keys, "base", "far", F.sqrt(along * along + across * across).alias("w"))
    ends = F.array(F.struct(F.col("base").alias("src"), F.col("far").alias("dst")), F.struct(F.col("far").alias("src"), F.col("base").alias("dst")))
    return kept.select(*keys, "w", F.explode(ends).alias("_e")).select(*keys, "_e.src", "_e.dst", "w")


def rescale_area(vertices: DataFrame, faces: DataFrame, keys: Sequence[str], radius: float = 100.0) -> DataFrame:
    """Scale coordinates so each mesh's total area is that of a sphere of ``radius``."""
    total = normals_and_areas(faces, vertices, keys).groupBy(*keys).agg(F.sqrt(F.lit(4.0 * np.pi * radius * radius) / F.sum("area")).alias("_k"))
    scaled = vertices.join(total, list(keys))
    return scaled.select(*[(F.col(c) * F.col("_k")).alias(c) if c in "xyz" else F.col(c) for c in vertices.columns])


def khop(edges: DataFrame, keys: Sequence[str], hops: int) -> DataFrame:
    """Pairs at hop distance 1..``hops``; a vertex is not its own neighbour."""
    from surfparc.session import cut

    e = edges.select(*keys, "src", "dst").distinct()
    step = e.withColumnRenamed("dst", "next").withColumnRenamed("src", "dst")
    reach = e
    for _ in range(hops - 1):
        grown = reach.join(step, [*keys, "dst"]).select(*keys, "src", F.col("next").alias("dst")).filter(F.col("src") != F.col("dst"))
        reach = cut(reach.unionByName(grown).distinct())
    return reach


def unpad_neighbours(table: DataFrame, keys: Sequence[str], vertex: str, neighbours: str) -> DataFrame:
    """Padded, one-based neighbour arrays (0 or NaN = no neighbour) to an edge table."""
    e = table.select(*keys, F.col(vertex).alias("src"), F.explode(F.col(neighbours).cast("array<double>")).alias("_n"))
    return e.filter((F.col("_n") > 0) & ~F.isnan("_n")).select(*keys, "src", (F.col("_n") - 1).cast("long").alias("dst"))


def icosphere(spark: SparkSession, n_target: int, radius: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Class-I geodesic sphere with about ``n_target`` vertices: ``(vertices, faces)``.

    Each of the 20 faces is cut into ``m * m`` triangles by Spark; lattice points
    shared by neighbouring faces are merged on rounded coordinates.
    """
    m = max(1, int(round(np.sqrt(max(n_target - 2, 10) / 10.0))))
    phi = (1.0 + 5.0**0.5) / 2.0
    pts = np.array([(s1 * 1.0, s2 * phi, 0.0) for s1 in (-1, 1) for s2 in (-1, 1)])
    pts = np.vstack([pts, pts[:, [2, 0, 1]], pts[:, [1, 2, 0]]])
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    side = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    short = side[side > 1e-9].min() * 1.01
    tri = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if max(side[a, b], side[b, c], side[a, c]) < short]
    rows = []
    for i, (a, b, c) in enumerate(tri):
        if np.dot(np.cross(pts[b] - pts[a], pts[c] - pts[a]), pts[a]) < 0:
            b, c = c, b
        rows.append((i, *[float(q) for p in (pts[a], pts[b], pts[c]) for q in p]))
    base = spark.createDataFrame(rows, "g int, " + ", ".join(f"{k}{i} double" for i in range(3) for k in "xyz"))

    def cut_face(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                corner = np.array(r[1:]).reshape(3, 3)
                bary = lambda i, j: (corner[0] * (m - i - j) + corner[1] * i + corner[2] * j) / m
                out = []
                for i in range(m):
                    for j in range(m - i):
                        out.append([bary(i, j), bary(i + 1, j), bary(i, j + 1)])
                        if i + j < m - 1:
                            out.append([bary(i + 1, j), bary(i + 1, j + 1), bary(i, j + 1)])
                t = np.array(out)
                t *= radius / np.linalg.norm(t, axis=2, keepdims=True)
                d = pd.DataFrame(t.reshape(len(out), 9), columns=[f"{k}{i}" for i in range(3) for k in "xyz"])
                d.insert(0, "k", np.arange(len(out)))
                d.insert(0, "g", r[0])
                yield d

    cols = ", ".join(f"{k}{i} double" for i in range(3) for k in "xyz")
    soup = base.repartition(20, "g").mapInPandas(cut_face, f"g int, k long, {cols}")
    key = lambda i: [F.round(F.col(f"{c}{i}"), 6).alias(f"_{c}") + 0.0 for c in "xyz"]
    points = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(key(i), ("a", "b", "c"))], *[F.col(f"{n}{i}").alias(n) for n in "xyz"]) for i in range(3)]))
    from surfparc.session import cut

    uniq = soup.select(points.alias("p")).groupBy("p.a", "p.b", "p.c").agg(*[F.min(f"p.{n}").alias(n) for n in "xyz"])
    # Number the points within bands of z, then add what lies in lower bands: no task sorts the whole sphere.
    laid = cut(uniq.withColumn("band", F.floor(F.col("c") / (2.0 * radius) * 64)))
    below = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("band").count().select("band", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("band").orderBy("c", "b", "a")) - 1
    verts = cut(laid.withColumn("nth", nth).join(sizes, "band").withColumn("v", F.col("before") + F.col("nth")).select("a", "b", "c", "x", "y", "z", "v"))
    faces = soup
    for i in range(3):
        k = key(i)
        faces = faces.withColumns({"a": k[0], "b": k[1], "c": k[2]}).join(verts.select("a", "b", "c", F.col("v").alias(f"v{i}")), ["a", "b", "c"])
        faces = faces.drop("a", "b", "c")
    faces = faces.select((F.col("g").cast("long") * (m * m) + F.col("k")).alias("f"), "v0", "v1", "v2")
    return verts.select("v", "x", "y", "z"), cut(faces)
