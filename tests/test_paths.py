import heapq
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfparc.operators import graph, paths
from tests.test_graph import grid


def lattice(rows, cols, rng, least=0.1):
    at = np.arange(rows * cols).reshape(rows, cols)
    pairs = np.concatenate([np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()]), np.stack([at[:-1].ravel(), at[1:].ravel()])], axis=1)
    w = least + rng.random(pairs.shape[1])
    return np.r_[pairs[0], pairs[1]], np.r_[pairs[1], pairs[0]], np.r_[w, w]


def plain(n, src, dst, w, starts):
    out = {}
    for a, b, c in zip(src, dst, w, strict=True):
        out.setdefault(a, []).append((b, c))
    d, heap = np.full(n, np.inf), [(0.0, s) for s in starts]
    d[starts] = 0.0
    while heap:
        x, u = heapq.heappop(heap)
        if x > d[u]:
            continue
        for v, c in out.get(u, []):
            if x + c < d[v]:
                d[v] = x + c
                heapq.heappush(heap, (d[v], v))
    return d


@pytest.mark.parametrize("seed,chunk", [(0, 1 << 20), (1, 7), (2, 50)])
def test_search_equals_a_heap(seed, chunk, monkeypatch):
    monkeypatch.setattr(paths, "EDGES", chunk)
    rng = np.random.default_rng(seed)
    n = 60
    src, dst = rng.integers(0, n, 200), rng.integers(0, n, 200)
    w = rng.choice([0.0, 0.5, 1.0, 1e-9, 40.0], 200) * rng.random(200)
    mesh = paths.Mesh.of(src, dst, w, np.arange(n))
    sets = [rng.integers(0, n, k) for k in (1, 1, 3, 8)]
    rows = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    want = np.array([plain(n, src, dst, w, s) for s in sets])
    got, _ = paths.search(mesh, rows, np.concatenate(sets), len(sets))
    assert np.allclose(got, want)
    near, _ = paths.search(mesh, rows, np.concatenate(sets), len(sets), limit=0.4)
    assert (np.isfinite(near) == (want <= 0.4)).all() and np.allclose(near[want <= 0.4], want[want <= 0.4])
    goal = rng.choice(n, 5, replace=False)
    some, _ = paths.search(mesh, rows, np.concatenate(sets), len(sets), goal)
    assert np.allclose(some[:, goal], want[:, goal])


def test_search_stops_at_its_targets():
    src, dst, w = lattice(60, 60, np.random.default_rng(3))
    mesh = paths.Mesh.of(src, dst, w, np.arange(3600))
    start, goal = np.array([0, 61, 3]), np.array([5, 122, 184])
    whole, every = paths.search(mesh, np.arange(3), start, 3)
    part, few = paths.search(mesh, np.arange(3), start, 3, goal)
    assert np.allclose(part[:, goal], whole[:, goal])
    assert few < every / 20
    assert every < 3 * 3 * len(src)
    assert paths.search(mesh, np.arange(3), start, 3, np.array([], int))[1] == 0


def test_memory_does_not_grow_with_the_diameter():
    peaks = []
    for rows, cols in ((64, 64), (2, 2048)):
        mesh = paths.Mesh.of(*lattice(rows, cols, np.random.default_rng(4)), np.arange(rows * cols))
        tracemalloc.start()
        paths.search(mesh, np.arange(32), np.arange(32), 32)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and peaks[0] < 3 * 9 * 32 * 4096


def test_negative_lengths_are_refused_and_lone_vertices_stay():
    with pytest.raises(ValueError, match="negative"):
        paths.Mesh.of(np.array([0]), np.array([1]), np.array([-1.0]), np.array([2]))
    none = np.array([], int)
    dist, relaxed = paths.search(paths.Mesh.of(none, none, np.array([]), np.array([4, 9])), np.array([0]), np.array([1]), 1)
    assert dist.tolist() == [[np.inf, 0.0]] and relaxed == 0


@pytest.mark.parametrize("cells", [1 << 24, 100])
def test_radius_mask_equals_reach(spark, cells, monkeypatch):
    monkeypatch.setattr(paths, "CELLS", cells)
    labels = np.random.default_rng(6).integers(0, 5, 80)
    v, e = grid(spark, 8, 10, labels)
    nb = [(r.src, r.dst, r.w) for r in e.collect()]
    got = {(r.v, r.l) for r in graph.radius_mask(v, e, ["sub"], 25.0).collect()}
    src, dst, w = map(np.array, zip(*nb, strict=True))
    want = {(i, int(x)) for i, x in enumerate(labels) if x}
    for parcel in range(1, 5):
        rim = sorted({s for s, d, _ in nb if labels[s] == parcel != labels[d]})
        want |= {(i, parcel) for i in np.flatnonzero(plain(80, src, dst, w, np.array(rim)) <= 25.0)}
    assert got == want


def test_source_sets_count_what_they_do_not_reach(spark):
    v, e = grid(spark, 2, 6)
    split = e.filter((F.col("src") % 6 < 3) == (F.col("dst") % 6 < 3))
    src = v.filter("v in (0, 5)").select("sub", F.lit("pre").alias("side"), "v")
    goals = v.filter("v in (1, 4, 11)").withColumn("label", F.when(F.col("v") == 1, 1).otherwise(2))
    got = {r.label: r.mean_distance for r in graph.source_set_distance(src, split, goals, ["sub"], "side", "label").collect()}
    w = {(r.src, r.dst): r.w for r in e.collect()}
    assert got[1] == pytest.approx(w[0, 1] / 2)
    assert got[2] == pytest.approx((w[5, 4] + w[5, 11]) / 4)
    assert graph.source_set_distance(src, split, goals.filter("v < 0"), ["sub"], "side", "label").count() == 0
