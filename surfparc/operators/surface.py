"""Surface operators: Gaussian smoothing, gradients, interpolation, watershed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.functions.vectors import safe_div
from surfparc.operators.aggregates import weighted_means
from surfparc.operators.graph import reach
from surfparc.operators.mesh import corners, cross, inner, minus, normals_and_areas, unfolded_edges, vertex_faces
from surfparc.session import cut


def smoothing_weights(vertices: DataFrame, edges: DataFrame, faces: DataFrame, keys: Sequence[str], sigma: float, roi: str) -> DataFrame:
    """``(tgt, src, w)``: each source spreads its area over vertices within ``3 sigma``.

    Distances run over mesh edges and across-face shortcuts. A source's weights
    are normalised over everything it reaches, but only targets in the region of
    interest are kept, and only sources in it spread.
    """
    keys = list(keys)
    links = edges.select(*keys, "src", "dst", "w").unionByName(unfolded_edges(faces, vertices, keys).select(*keys, "src", "dst", "w"))
    area = normals_and_areas(faces, vertices, keys).select(*keys, "v", "area")
    seeds = vertices.filter(roi).select(*keys, F.col("v").alias("root"), "v", F.lit(0.0).alias("d"))
    near = reach(seeds, links, [*keys, "root"], 3.0 * sigma)
    raw = near.join(area, [*keys, "v"]).withColumn("_w", F.exp(F.col("d") * F.col("d") * (-0.5 / (sigma * sigma))) * F.col("area"))
    total = raw.groupBy(*keys, "root").agg(F.sum("_w").alias("_t"))
    own = area.select(*keys, F.col("v").alias("root"), F.col("area").alias("_own"))
    scaled = raw.join(total, [*keys, "root"]).filter(F.col("_t") > 0).join(own, [*keys, "root"])
    inside = vertices.filter(roi).select(*keys, "v")
    return scaled.join(inside, [*keys, "v"], "left_semi").select(
        *keys, F.col("v").alias("tgt"), F.col("root").alias("src"), (F.col("_w") * F.col("_own") / F.col("_t")).alias("w")
    )


def smooth(values: DataFrame, weights: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Apply a smoothing table; vertices outside the region of interest become zero."""
    done = weighted_means(values.select(*keys, "v", value), weights, keys, value)
    return values.select(*keys, "v").join(done, [*keys, "v"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def gradient_magnitude(
    values: DataFrame, vertices: DataFrame, edges: DataFrame, faces: DataFrame, keys: Sequence[str], value: str, roi: str, columns: Sequence[str] = ()
) -> DataFrame:
    """Gradient magnitude by area-weighted least squares on the unrolled one-ring.

    Edge geometry is reduced to six sums per vertex, the data to three per vertex
    and column; a plane is then solved for in closed form. A singular system falls
    back to a weighted finite difference. ``columns`` name value columns' keys.
    """
    keys, columns = list(keys), list(columns)
    shape = normals_and_areas(faces, vertices, keys)
    at = vertices.filter(roi).select(*keys, "v", "x", "y", "z").join(shape, [*keys, "v"])
    own = at.select(*keys, F.col("v").alias("src"), *[F.col(c).alias(f"s{c}") for c in "xyz"], "nx", "ny", "nz", F.col("area").alias("s_area"))
    other = at.select(*keys, F.col("v").alias("dst"), *[F.col(c).alias(f"d{c}") for c in "xyz"], F.col("area").alias("wt"))
    e = edges.select(*keys, "src", "dst").join(own, [*keys, "src"]).join(other, [*keys, "dst"])
    e = e.filter((F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0))

    n = tuple(F.col(f"n{c}") for c in "xyz")
    lean = F.abs(n[0]) > F.abs(n[1])
    seed = (F.when(lean, 0.0).otherwise(1.0), F.when(lean, 1.0).otherwise(0.0), F.lit(0.0))
    for tag, vec in (("h", cross(n, seed)), ("k", None)):
        if vec is None:
            vec = cross(n, tuple(F.col(f"h{c}") for c in "xyz"))
        e = e.withColumns({f"_{c}": v for c, v in zip("xyz", vec)})
        e = e.withColumn("_len", F.sqrt(inner(*[tuple(F.col(f"_{c}") for c in "xyz")] * 2)))
        e = e.withColumns({f"{tag}{c}": F.when(F.col("_len") > 0, F.col(f"_{c}") / F.when(F.col("_len") > 0, F.col("_len"))).otherwise(F.col(f"_{c}")) for c in "xyz"})
    step = minus(tuple(F.col(f"d{c}") for c in "xyz"), tuple(F.col(f"s{c}") for c in "xyz"))
    e = e.withColumns({f"o{c}": v for c, v in zip("xyz", step)})
    o = tuple(F.col(f"o{c}") for c in "xyz")
    e = e.withColumn("mag", F.sqrt(inner(o, o))).withColumn("rise", inner(o, n))
    bent = (F.col("mag") > 0) & (F.abs("rise") > 0.035 * F.col("mag"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), safe_div(F.col("rise"), F.col("mag"))))
    arc = F.col("mag") * F.asin(ratio) * safe_div(F.col("mag"), F.col("rise"))
    e = e.withColumn("unrolled", F.when(bent, arc).otherwise(F.col("mag")))
    e = e.withColumn("_p", inner(o, tuple(F.col(f"h{c}") for c in "xyz"))).withColumn("_q", inner(o, tuple(F.col(f"k{c}") for c in "xyz")))
    e = e.withColumn("flat", F.sqrt(F.col("_p") * F.col("_p") + F.col("_q") * F.col("_q")))
    e = e.withColumn("p", F.col("_p") * safe_div(F.col("unrolled"), F.col("flat"))).withColumn("q", F.col("_q") * safe_div(F.col("unrolled"), F.col("flat")))

    s = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("wt"))
    basis = [f"{t}{c}" for t in "hk" for c in "xyz"]
    e = e.withColumn("one", F.lit(1.0))
    ring = e.groupBy(*keys, "src").agg(
        F.count(F.lit(1)).alias("deg"), s("p", "p").alias("pp"), s("p", "q").alias("pq"), s("p", "one").alias("p1"), s("q", "q").alias("qq"),
        s("q", "one").alias("q1"), F.sum("wt").alias("w_ring"), F.first("s_area").alias("s_area"), *[F.first(b).alias(b) for b in basis],
    ).filter(F.col("deg") >= 2).withColumn("w1", F.col("w_ring") + F.col("s_area"))

    data = values.select(*keys, *columns, "v", F.col(value).alias("_x"))
    link = e.select(*keys, "src", "dst", "p", "q", "wt", "unrolled", "flat")
    near = link.join(data.withColumnRenamed("v", "dst").withColumnRenamed("_x", "_xd"), [*keys, "dst"])
    near = near.join(data.withColumnRenamed("v", "src").withColumnRenamed("_x", "_xs"), [*keys, *columns, "src"])
    t = F.col("wt") * (F.col("_xd") - F.col("_xs"))
    soft = safe_div(t, F.col("unrolled") * F.col("flat"))
    rhs = near.groupBy(*keys, *columns, "src").agg(
        F.sum(F.col("p") * t).alias("b0"), F.sum(F.col("q") * t).alias("b1"), F.sum(t).alias("b2"),
        F.sum(F.col("p") * soft).alias("f0"), F.sum(F.col("q") * soft).alias("f1"),
    )
    m = rhs.join(ring, [*keys, "src"])
    c = {k: F.col(k) for k in ("pp", "pq", "p1", "qq", "q1", "w1", "b0", "b1", "b2")}
    first = (c["pp"], c["pq"], c["p1"])
    second = (c["pq"], c["qq"], c["q1"])
    third = (c["p1"], c["q1"], c["w1"])
    right = (c["b0"], c["b1"], c["b2"])
    det3 = lambda a, b, d: inner(a, cross(b, d))
    m = m.withColumn("det", det3(first, second, third))
    m = m.withColumn("ga", safe_div(det3(right, second, third), F.col("det"), None)).withColumn("gb", safe_div(det3(first, right, third), F.col("det"), None))
    usable = F.col("ga").isNotNull() & ~F.isnan("ga") & ~F.isnan("gb") & (F.abs("ga") != float("inf")) & (F.abs("gb") != float("inf"))
    m = m.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    for out, fallback in (("ga", "f0"), ("gb", "f1")):
        m = m.withColumn(out, F.when(F.col("_ok"), F.col(out)).otherwise(safe_div(F.col(fallback), F.col("w_ring"))))
    g = [F.col(f"h{k}") * F.col("ga") + F.col(f"k{k}") * F.col("gb") for k in "xyz"]
    solved = m.select(*keys, *columns, F.col("src").alias("v"), F.sqrt(sum(x * x for x in g)).alias("gradient"))
    on = [*keys, *columns, "v"]
    return values.select(*on).join(solved, on, "left").withColumn("gradient", F.coalesce("gradient", F.lit(0.0)))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, start: float, apart: str | None = None, settle: Sequence[str] | None = None) -> DataFrame:
    """Exact nearest right point of every left point (``x, y, z`` on both sides).

    Points fall into cubes of side ``r`` and meet only points of the 27 cubes
    around them; whoever has a neighbour within ``r`` is settled, the rest retry
    with four times the side. ``apart`` names a column whose values have to differ.
    Ties go to the lowest id. Left points with no partner at all are left out.
    ``settle`` names columns of a group that only needs its smallest distance: the
    whole group stops searching once one of its points is settled.
    """
    keys = list(keys)
    xyz = ("x", "y", "z")
    extra = sorted({*([apart] if apart else []), *(settle or [])} - set(keys))
    todo = left.select(*keys, left_id, *[F.col(c).cast("double").alias(c) for c in xyz], *extra)
    other = right.select(*keys, F.col(right_id).alias("_rid"), *[F.col(c).cast("double").alias(f"_r{c}") for c in xyz], *[F.col(a).alias(f"_r_{a}") for a in [apart] if a])
    # Beyond this side every cube of a key touches every other, so the last round is complete.
    span = left.select(*xyz).unionByName(right.select(*xyz)).agg(F.max(F.greatest(*[F.abs(c) for c in xyz]))).first()[0]
    limit = 4.0 * (float(span or 0.0) + 1.0)
    r, found = float(start), None
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    cube = lambda c, side: F.floor(F.col(c) / side)
    while True:
        a = todo.select("*", F.explode(around).alias("_o")).withColumns(
            {f"_{n}": cube(c, r) + F.col(f"_o.{n}") for n, c in zip("ijk", xyz)}
        ).drop("_o")
        b = other.withColumns({f"_{n}": cube(f"_r{c}", r) for n, c in zip("ijk", xyz)})
        pairs = a.join(b, [*keys, "_i", "_j", "_k"])
        if apart:
            pairs = pairs.filter(F.col(apart) != F.col(f"_r_{apart}"))
        d = F.sqrt(sum((F.col(c) - F.col(f"_r{c}")) * (F.col(c) - F.col(f"_r{c}")) for c in xyz))
        best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct(d.alias("d"), F.col("_rid").alias("id"))).alias("_b"))
        last = r > limit
        ok = F.col("_b").isNotNull() if last else F.coalesce(F.col("_b.d") <= r, F.lit(False))
        tried = todo.join(best, [*keys, left_id], "left").withColumn("_ok", ok)
        if settle:
            tried = tried.withColumn("_quiet", F.max("_ok").over(W.partitionBy(*keys, *[g for g in settle if g not in keys])))
        else:
            tried = tried.withColumn("_quiet", F.col("_ok"))
        tried = cut(tried)
        done = tried.filter("_ok").select(*keys, left_id, F.col("_b.id").alias(right_id), F.col("_b.d").alias("distance"))
        found = done if found is None else found.unionByName(done)
        todo = tried.filter(~F.col("_quiet")).drop("_b", "_ok", "_quiet")
        if last or todo.isEmpty():
            return found
        r *= 4.0


def interpolate(targets: DataFrame, vertices: DataFrame, faces: DataFrame, keys: Sequence[str], target: str, values: Sequence[str], spacing: float) -> DataFrame:
    """Barycentric interpolation of vertex ``values`` at points on the sphere.

    Candidate faces are those around the nearest vertex. Each is scored by how far
    the radial projection leaves the triangle; the first best wins, weights are
    the three sub-areas and snap to a corner above 0.9999999.
    """
    keys = list(keys)
    close = nearest(targets, vertices, keys, target, "v", spacing)
    fan = vertex_faces(faces, keys).join(corners(faces, vertices, keys), [*keys, "f"])
    c = close.join(targets.select(*keys, target, *[F.col(a).cast("double").alias(f"p{a}") for a in "xyz"]), [*keys, target]).join(fan, [*keys, "v"])
    v = [tuple(F.col(f"{a}{i}") for a in "xyz") for i in range(3)]
    p = tuple(F.col(f"p{a}") for a in "xyz")
    n = cross(minus(v[1], v[0]), minus(v[2], v[0]))
    c = c.withColumns({f"n{a}": e for a, e in zip("xyz", n)})
    n = tuple(F.col(f"n{a}") for a in "xyz")
    c = c.withColumn("_pn", inner(p, n)).filter(F.abs("_pn") >= 1e-12).withColumn("_s", inner(v[0], n) / F.col("_pn"))
    c = c.withColumns({f"q{a}": F.col("_s") * F.col(f"p{a}") for a in "xyz"})
    q = tuple(F.col(f"q{a}") for a in "xyz")
    nn = inner(n, n)
    for i in range(3):
        sub = cross(minus(v[(i + 1) % 3], q), minus(v[(i + 2) % 3], q))
        c = c.withColumn(f"signed{i}", inner(sub, n) / F.when(nn == 0, 1e-30).otherwise(nn)).withColumn(f"area{i}", 0.5 * F.sqrt(inner(sub, sub)))
    signed = [F.col(f"signed{i}") for i in range(3)]
    outside = F.greatest(F.lit(0.0), -F.least(*signed)) + F.greatest(F.lit(0.0), F.greatest(*signed) - 1.0)
    total = F.col("area0") + F.col("area1") + F.col("area2")
    c = c.withColumns({f"b{i}": F.col(f"area{i}") / F.when(total == 0, 1e-30).otherwise(total) for i in range(3)})
    pick = F.min(F.struct(outside.alias("score"), F.col("f"), *[F.col(f"v{i}") for i in range(3)], *[F.col(f"b{i}") for i in range(3)])).alias("_m")
    best = c.groupBy(*keys, target).agg(pick).select(*keys, target, "_m.*")
    snap = 0.9999999
    corner = [F.col(f"b{i}") > snap for i in range(3)]
    hit = corner[0] | corner[1] | corner[2]
    taken = [corner[0], ~corner[0] & corner[1], ~corner[0] & ~corner[1] & corner[2]]
    best = best.withColumns({f"w{i}": F.when(hit, taken[i].cast("double")).otherwise(F.col(f"b{i}")) for i in range(3)})
    legs = best.select(*keys, target, F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("v"), F.col(f"w{i}").alias("w")) for i in range(3)])).alias("_l"))
    legs = legs.select(*keys, target, "_l.v", "_l.w").join(vertices.select(*keys, "v", *values), [*keys, "v"])
    return legs.groupBy(*keys, target).agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in values])


def flood(values: np.ndarray, minima: np.ndarray, nbrs: list, levels: np.ndarray, seed: int) -> np.ndarray:
    """Raise the water level over one column; returns basin ids, 0 on the ridges."""
    rng = np.random.RandomState(seed)
    label = np.zeros(len(values), dtype=np.int64)
    ridge = np.zeros(len(values), dtype=bool)
    ids = np.arange(1, int(minima.sum()) + 1)
    rng.shuffle(ids)
    label[minima] = ids
    for h in levels:
        wet = np.flatnonzero((values < h) & (label == 0) & ~ridge)
        rng.shuffle(wet)
        for v in wet:
            around = {label[u] for u in nbrs[v]} - {0}
            if len(around) == 1:
                label[v] = around.pop()
            elif around:
                ridge[v] = True
    return label


def watershed(
    values: DataFrame, edges: DataFrame, keys: Sequence[str], column: str, value: str, is_min: str = "is_min", steps: int = 50, fraction: float = 1.0
) -> DataFrame:
    """Flood every data column of every mesh from its local minima.

    The sweep is sequential within one column by definition, so a column of one
    mesh is the unit of work and columns spread over the cluster. Levels run from
    the lowest to the highest value over all columns of the key.
    """
    keys = list(keys)
    ends = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ring = edges.groupBy(*keys, F.col("src").alias("v")).agg(F.collect_list("dst").alias("_nb"))
    rows = values.select(*keys, column, "v", value, is_min).join(ring, [*keys, "v"], "left").join(ends, keys)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)
        ids = pdf["v"].to_numpy()
        nbrs = [np.searchsorted(ids, np.intersect1d(np.asarray(n), ids)) if n is not None else [] for n in pdf["_nb"]]
        lo, hi = float(pdf["_lo"].iloc[0]), float(pdf["_hi"].iloc[0])
        step = (hi - lo) / steps
        levels = np.arange(lo, hi * fraction + step / 2.0, step).astype(np.float32) if step > 0 else np.array([], np.float32)
        x = pdf[value].to_numpy(dtype=np.float32)
        pdf["label"] = flood(x, pdf[is_min].to_numpy(dtype=bool), nbrs, levels, int(pdf[column].iloc[0]))
        return pdf[[*keys, column, "v", "label"]]

    kinds = dict(values.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, column, "v"]) + ", label long"
    return rows.groupBy(*keys, column).applyInPandas(sweep, schema)
