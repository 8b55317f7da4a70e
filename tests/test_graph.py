import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfparc.operators import connectedness as con
from surfparc.operators import diffusion, graph, mesh, surface
from surfparc.operators.diffusion import diffusion_map


def grid(spark, rows, cols, labels=None, sub=0):
    lab = np.ones(rows * cols, int) if labels is None else labels
    rng = np.random.default_rng(1)
    z = rng.normal(size=rows * cols)
    data = [(sub, i, i // cols, i % cols, int(lab[i]), float(10 * (i % cols)), float(10 * (i // cols)), float(z[i])) for i in range(rows * cols)]
    v = spark.createDataFrame(data, "sub long, v long, gr long, gc long, label int, x double, y double, z double")
    e = mesh.with_length(mesh.lattice_edges(v.select("sub", "v", "gr", "gc"), ["sub"], "v", "gr", "gc"), v, ["sub"])
    return v, e


def neighbours(rows, cols):
    out = {}
    for i in range(rows * cols):
        r, c = divmod(i, cols)
        out[i] = [rr * cols + cc for rr, cc in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)) if 0 <= rr < rows and 0 <= cc < cols]
    return out


def pieces(labels, nb):
    comp = {}
    for s in range(len(labels)):
        if labels[s] == 0 or s in comp:
            continue
        stack = [s]
        comp[s] = s
        while stack:
            for u in nb[stack.pop()]:
                if labels[u] == labels[s] and u not in comp:
                    comp[u] = s
                    stack.append(u)
    return comp


@pytest.mark.parametrize("rows,cols,n,thr,seed", [(6, 9, 4, 5, 0), (12, 15, 3, 8, 3)])
def test_components_and_isolated_removal(spark, rows, cols, n, thr, seed):
    labels = np.random.default_rng(seed).integers(0, n + 1, rows * cols)
    labels[:cols] = 1
    nb = neighbours(rows, cols)
    want = pieces(labels, nb)
    v, e = grid(spark, rows, cols, labels)
    got = {r.v: r.comp for r in graph.components(v, e, ["sub"]).collect()}
    assert got == want
    sizes = {c: sum(1 for x in want.values() if x == c) for c in set(want.values())}
    expect = labels.copy()
    for c, size in sizes.items():
        if size < thr:
            votes = [labels[u] for m, k in want.items() if k == c for u in nb[m] if labels[u] not in (0, labels[c])]
            if votes:
                top = max(votes.count(x) for x in votes)
                for m, k in want.items():
                    if k == c:
                        expect[m] = min(x for x in votes if votes.count(x) == top)
    out = {r.v: r.label for r in graph.remove_isolated(v.select("sub", "v", "label"), e, ["sub"], thr).collect()}
    assert [out[i] for i in range(rows * cols)] == list(expect)


def test_long_snake_is_one_component(spark):
    v, e = grid(spark, 1, 120)
    assert {r.comp for r in graph.components(v, e, ["sub"]).collect()} == {0}


def dijkstra(nb, w, s):
    d, q = {s: 0.0}, [(0.0, s)]
    while q:
        a, u = heapq.heappop(q)
        if a > d[u]:
            continue
        for t in nb[u]:
            b = a + w[u, t]
            if b < d.get(t, np.inf):
                d[t] = b
                heapq.heappush(q, (b, t))
    return d


def test_all_pairs_and_source_sets(spark):
    rows, cols = 5, 7
    v, e = grid(spark, rows, cols)
    nb = neighbours(rows, cols)
    g = {r.v: abs(r.z) + 0.1 for r in v.collect()}
    want = np.array([[dijkstra(nb, {(a, b): (g[a] + g[b]) / 2 for a in nb for b in nb[a]}, s)[t] for t in nb] for s in nb])
    got = graph.geodesic_distances(v.select("sub", "v", (F.abs("z") + 0.1).alias("g")), e, ["sub"], "g").orderBy("src").collect()
    assert np.allclose(np.array([r.dist for r in got]), want / want.max())
    w = {(r.src, r.dst): r.w for r in e.collect()}
    src = v.filter("v in (0, 3, 11)").select("sub", F.when(F.col("v") == 0, "pre").otherwise("post").alias("side"), "v")
    targets = v.filter("v in (20, 21, 30)").withColumn("label", (F.col("v") % 2 + 1).cast("int"))
    out = {(r.side, r.label): r.mean_distance for r in graph.source_set_distance(src, e, targets, ["sub"], "side", "label").collect()}
    d = {s: dijkstra(nb, w, s) for s in (0, 3, 11)}
    assert out["pre", 2] == pytest.approx(d[0][21])
    assert out["post", 1] == pytest.approx(np.mean([d[s][t] for s in (3, 11) for t in (20, 30)]))


def test_disconnected_mesh_is_an_error(spark):
    v, e = grid(spark, 3, 4)
    cut_edges = e.filter(~((F.col("src") % 4 < 2) & (F.col("dst") % 4 >= 2)) & ~((F.col("src") % 4 >= 2) & (F.col("dst") % 4 < 2)))
    with pytest.raises(Exception, match="not connected"):
        graph.geodesic_distances(v.select("sub", "v", F.lit(1.0).alias("g")), cut_edges, ["sub"], "g").count()


def test_reach_is_inclusive_and_shortest(spark):
    v, e = grid(spark, 4, 6)
    e = e.withColumn("w", F.lit(10.0))
    seeds = v.filter("v = 0").select("sub", F.lit(1).alias("l"), "v", F.lit(0.0).alias("d"))
    got = {r.v: r.d for r in graph.reach(seeds, e, ["sub", "l"], 30.0).collect()}
    assert got == {i: 10.0 * (i // 6 + i % 6) for i in range(24) if i // 6 + i % 6 <= 3}


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 3)) * 40, rng.normal(size=(45, 3)) * 40
    left = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(a)], "g int, i long, x double, y double, z double")
    right = spark.createDataFrame([(1, j, *map(float, p)) for j, p in enumerate(b)], "g int, j long, x double, y double, z double")
    got = {r.i: r.j for r in surface.nearest(left, right, ["g"], "i", "j", 3.0).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == {i: int(d[i].argmin()) for i in range(60)}


def test_component_distance_of_far_pieces(spark):
    labels = np.zeros(40, int)
    labels[[0, 1, 38, 39, 20]] = 2
    v, e = grid(spark, 1, 40, labels)
    v = v.withColumn("z", F.lit(0.0))
    c = graph.components(v, e, ["sub"])
    out = con.component_distance(v, e, c, ["sub"], 4, 15.0).first()
    assert (out.n_comp, out.distance) == (3, 190.0)


def test_icosphere_counts_and_interpolation(spark):
    v, f = mesh.icosphere(spark, 162)
    assert (v.count(), f.count()) == (162, 320)
    e = mesh.edges_from_faces(f.withColumn("m", F.lit(1)), ["m"])
    assert e.count() == 960
    p = np.array([[r.x, r.y, r.z] for r in v.orderBy("v").collect()])
    tri = np.array([[r.v0, r.v1, r.v2] for r in f.orderBy("f").collect()])
    rng = np.random.default_rng(0)
    t = rng.normal(size=(25, 3))
    t = 100 * t / np.linalg.norm(t, axis=1, keepdims=True)
    t[0] = p[7]
    targets = spark.createDataFrame([(1, i, *map(float, q)) for i, q in enumerate(t)], "m int, i long, x double, y double, z double")
    vv = v.withColumn("m", F.lit(1)).withColumn("h", F.col("x") + 2 * F.col("z"))
    got = {r.i: r.h for r in surface.interpolate(targets, vv, f.withColumn("m", F.lit(1)), ["m"], "i", ["h"], 30.0).collect()}
    h = p[:, 0] + 2 * p[:, 2]
    for i, q in enumerate(t):
        near = np.linalg.norm(p - q, axis=1).argmin()
        best = None
        for k in np.flatnonzero((tri == near).any(axis=1)):
            a, b, c = p[tri[k]]
            n = np.cross(b - a, c - a)
            proj = q * (a @ n) / (q @ n)
            crosses = [np.cross(b - proj, c - proj), np.cross(c - proj, a - proj), np.cross(a - proj, b - proj)]
            s = np.array([x @ n for x in crosses]) / (n @ n)
            score = max(0, -s.min()) + max(0, s.max() - 1)
            area = np.array([np.linalg.norm(x) for x in crosses])
            if best is None or score < best[0]:
                best = (score, (area / area.sum()) @ h[tri[k]])
        assert got[i] == pytest.approx(best[1], abs=1e-6)
    assert got[0] == pytest.approx(h[7])


def test_watershed_floods_two_basins(spark):
    v, e = grid(spark, 1, 9)
    x = [0, 1, 2, 3, 4, 3, 2, 1, 0.5]
    vals = spark.createDataFrame([(0, 1, i, float(a), i in (0, 8)) for i, a in enumerate(x)], "sub long, k int, v long, value double, is_min boolean")
    got = [r.label for r in surface.watershed(vals, e, ["sub"], "k", "value", steps=8).orderBy("v").collect()]
    assert len(set(got[:4])) == 1 and len(set(got[5:])) == 1 and got[0] != got[8] and set(got) - {0} == {1, 2}
    assert got[4] == 0


def test_diffusion_map_matches_dense_eigensolver(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(40, 2))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    df = spark.createDataFrame([(0, i, [float(x) for x in row]) for i, row in enumerate(d)], "sub long, src long, dist array<double>")
    got = np.array([r.emb for r in diffusion_map(df, ["sub"], 2).orderBy("v").collect()])
    a = np.exp(-d / d.max())
    s = a.sum(1) ** -0.5
    a = a * s[:, None] * s[None]
    r = np.sqrt(a.sum(1))
    val, vec = np.linalg.eigh(a / r[:, None] / r[None])
    val, vec = val[::-1], vec[:, ::-1] / r[:, None]
    emb = vec[:, 1:3] / vec[:, :1] * (val[1:3] / (1 - val[1:3]))
    emb *= np.sign(emb[np.abs(emb).argmax(0), [0, 1]])
    assert np.allclose(got, emb, atol=1e-5)


def test_meshes_of_one_block_take_no_rounds_and_agree_with_them(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for sub, n in ((0, 30), (1, 12), (2, 3)):
        p = rng.normal(size=(n, 2))
        rows += [(sub, i, [float(x) for x in np.linalg.norm(p[i] - p, axis=1)]) for i in range(n)]
    df = spark.createDataFrame(rows, "sub long, src long, dist array<double>")
    emb = lambda got: {(r["sub"], r.v): r.emb for r in got.collect()}
    want = emb(diffusion.iterated_map(df, ["sub"], 4))
    monkeypatch.setattr(diffusion, "WHOLE", 12)
    mixed = emb(diffusion_map(df, ["sub"], 4))
    monkeypatch.undo()
    monkeypatch.delattr(diffusion, "block_apply")
    whole = emb(diffusion_map(df, ["sub"], 4))
    assert whole.keys() == mixed.keys() == want.keys()
    for k, w in want.items():
        assert whole[k] == pytest.approx(w, abs=1e-5) and mixed[k] == pytest.approx(w, abs=1e-5)
