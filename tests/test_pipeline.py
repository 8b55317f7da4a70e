import json

import numpy as np
from pyspark.sql import functions as F
from test_sources import config

from surfparc.operators import graph, mesh, ranking
from surfparc.plans.config import parse_config
from surfparc.plans.pipeline import Pipeline
from surfparc.session import cut
from surfparc.sources import tables


def test_project_run_writes_every_artifact(spark, tmp_path):
    v, f = mesh.icosphere(spark, 92)
    subs = spark.createDataFrame([(1, 0), (2, 0)], "sub long, k int")
    each = lambda d: cut(d.withColumn("k", F.lit(0)).join(subs, "k").drop("k"))
    band = F.when(F.col("v") < 4, 0).when(F.col("z") > 40, 1).when(F.col("z") > 0, 2).when(F.col("z") > -40, 3).otherwise(4)
    vertices = each(v.withColumn("label", band).withColumn("mars", F.when(F.col("v") < 4, 1).otherwise(2)).withColumn("region", (F.col("v") % 36 + 1).cast("int")))
    xyz = np.array([[r.x, r.y, r.z] for r in v.orderBy("v").collect()]) / 100
    rng = np.random.default_rng(0)
    rows = []
    for s in (1, 2):
        for t in (1, 2):
            sig = xyz @ rng.normal(size=(3, 30)) + rng.normal(size=(len(xyz), 30)) * 0.4
            rows += [(s, t, 1, i, [float(a) for a in x]) for i, x in enumerate(sig)]
    bold = cut(spark.createDataFrame(rows, "sub long, sess int, run int, v long, ts array<double>"))
    seeds = 42 - 4
    theta = vertices.filter("sub = 1 and label > 0").select("v", F.col("label").alias("l"), F.lit(1.0).alias("theta"))
    near = mesh.edges_from_faces(each(f).filter("sub = 1"), ["sub"]).join(theta.select(F.col("v").alias("src"), "l"), "src").select(F.col("dst").alias("v"), "l")
    theta = theta.unionByName(near.distinct().withColumn("theta", F.lit(0.2)).filter("v >= 4")).groupBy("v", "l").agg(F.max("theta").alias("theta"))
    mu = rng.normal(size=(5, seeds))
    parcel = spark.createDataFrame([(l, [float(a) for a in mu[l] / np.linalg.norm(mu[l])], 40.0, 40.0) for l in range(1, 5)], "l int, mu array<double>, sigma double, eps double")
    labels = Pipeline(spark, str(tmp_path), parse_config(config())).run(
        {"bold": bold, "vertices": vertices, "faces": each(f), "theta": cut(theta), "parcel": parcel}, 1, seeds
    )
    got = labels.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top")).collect()
    assert {(r["sub"], r.n) for r in got} == {(1, 92), (2, 92)} and all(r.top <= 4 for r in got)
    packed = tables.read(spark, str(tmp_path), "profile")
    assert packed.select("sub", "sess").distinct().count() == 4
    ones = packed.groupBy("sub", "sess").agg(F.sum(F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w))).alias("n"), F.max(F.when(F.col("v") < 4, F.col("words")[0])).alias("wall"))
    assert all(r.wall == 0 and 0 < r.n <= 92 * seeds * 0.1 + 1 for r in ones.collect())
    log = json.loads(next((tmp_path / "logs").glob("*.json")).read_text())
    assert log["success"] and log["steps"] == ["step1", "step1_avg", "step1_ini", "step1_mask", "step3"]
    assert tables.read(spark, str(tmp_path), "ledger").count() == 2 and (tmp_path / "progress.jsonl").exists()
    before = {r.id: r.run_id for r in tables.read(spark, str(tmp_path), "ledger").collect()}
    # One subject fewer, and one vertex moved: the earlier subject stays out, and the run is another one.
    rest = lambda d: d.filter("sub = 1")
    moved = rest(vertices).withColumn("x", F.when(F.col("v") == 7, F.col("x") + 1e-3).otherwise(F.col("x")))
    again = Pipeline(spark, str(tmp_path), parse_config(config())).run(
        {"bold": rest(bold), "vertices": cut(moved), "faces": cut(rest(each(f))), "theta": cut(theta), "parcel": parcel}, 1, seeds
    )
    assert {r["sub"] for r in again.select("sub").distinct().collect()} == {1}
    after = {r.id: r.run_id for r in tables.read(spark, str(tmp_path), "ledger").collect()}
    assert after["1"] != before["1"]


def test_two_hemispheres_never_mix(spark, tmp_path):
    v, f = mesh.icosphere(spark, 92)
    n = v.count()
    band = F.when(F.col("v") < 4, 0).when(F.col("z") > 0, 1).otherwise(2)
    one = v.withColumn("sub", F.lit(1).cast("long")).withColumn("label", band).withColumn("mars", F.when(F.col("v") < 4, 1).otherwise(2)).withColumn("region", (F.col("v") % 36 + 1).cast("int"))
    left = one.withColumn("hemi", F.lit("lh"))
    right = ranking.stack_labels(one.withColumn("hemi", F.lit("rh")).withColumn("v", F.col("v") + n), "hemi", "label", 2)
    vertices = cut(left.unionByName(right))
    far = F.lit(n).cast("long")
    faces = f.withColumn("sub", F.lit(1).cast("long"))
    faces = cut(faces.unionByName(faces.select("sub", (F.col("f") + 10_000).alias("f"), *[(F.col(c) + far).alias(c) for c in ("v0", "v1", "v2")])))
    rng = np.random.default_rng(3)
    xyz = np.array([[r.x, r.y, r.z] for r in v.orderBy("v").collect()]) / 100
    sig = np.concatenate([xyz @ rng.normal(size=(3, 30)) for _ in range(2)]) + rng.normal(size=(2 * n, 30)) * 0.4
    bold = spark.createDataFrame([(1, 1, 1, i, [float(a) for a in x]) for i, x in enumerate(sig)], "sub long, sess int, run int, v long, ts array<double>")
    seeds = 2 * (42 - 4)
    near = mesh.edges_from_faces(faces, ["sub"]).join(vertices.select(F.col("v").alias("src"), F.col("label").alias("l")), "src").filter("l > 0")
    theta = near.select(F.col("dst").alias("v"), "l", F.lit(0.2).alias("theta")).unionByName(vertices.filter("label > 0").select("v", F.col("label").alias("l"), F.lit(1.0).alias("theta")))
    theta = theta.join(vertices.filter("mars = 2").select("v"), "v", "left_semi").groupBy("v", "l").agg(F.max("theta").alias("theta"))
    mu = rng.normal(size=(5, seeds))
    parcel = spark.createDataFrame([(l, [float(a) for a in mu[l] / np.linalg.norm(mu[l])], 40.0, 40.0) for l in range(1, 5)], "l int, mu array<double>, sigma double, eps double")
    labels = Pipeline(spark, str(tmp_path), parse_config(config())).run({"bold": bold, "vertices": vertices, "faces": faces, "theta": cut(theta), "parcel": parcel}, 1, seeds)
    for r in labels.collect():
        assert r.label == 0 or (r.v < n) == (r.label <= 2)
    mask = tables.read(spark, str(tmp_path), "mask").collect()
    assert {r.hemi for r in mask} == {"lh", "rh"} and all((r.v < n) == (r.l <= 2) == (r.hemi == "lh") for r in mask)
    words = tables.read(spark, str(tmp_path), "profile").select(F.max(F.size("words")).alias("n")).first().n
    assert words == -(-seeds // 64)


def test_hemispheres_are_embedded_once_each_and_their_distances_kept(spark, tmp_path, monkeypatch):
    v, f = mesh.icosphere(spark, 92)
    small, links = mesh.icosphere(spark, 42)
    n, m = v.count(), small.count()
    as_sub = lambda d: d.withColumn("sub", F.lit(1).cast("long"))

    def shifted(points, faces, by, hemi):
        return (
            as_sub(points.withColumn("v", F.col("v") + by).withColumn("hemi", F.lit(hemi))),
            as_sub(faces.withColumn("f", F.col("f") + 1000 * (by > 0)).withColumn("hemi", F.lit(hemi)).withColumns({c: F.col(c) + by for c in ("v0", "v1", "v2")})),
        )

    fine = [shifted(v, f, 0, "lh"), shifted(v, f, n, "rh")]
    coarse = [shifted(small, links, 0, "lh"), shifted(small, links, m, "rh")]
    rng = np.random.default_rng(8)
    bold = spark.createDataFrame([(1, 1, 1, i, [float(a) for a in rng.normal(size=20)]) for i in range(2 * n)], "sub long, sess int, run int, v long, ts array<double>")
    inputs = {
        "bold": bold, "vertices": cut(fine[0][0].unionByName(fine[1][0]).withColumn("mars", F.lit(2))), "faces": cut(fine[0][1].unionByName(fine[1][1]).drop("hemi")),
        "coarse_vertices": cut(coarse[0][0].unionByName(coarse[1][0])), "coarse_faces": cut(coarse[0][1].unionByName(coarse[1][1])),
    }
    seen = []

    # The three searches have tests of their own; asked here is that each runs once per side, on that side alone.
    def density(b, vertices, *_):
        mine = vertices.select("sub", "v", (F.abs("z") / 100).alias("density"))
        seen.append((mine.agg(F.min("v"), F.max("v")).first(), b.count()))
        return mine

    def distances(dens, vertices, faces, coarse_vertices, coarse_faces, k):
        assert dens.count() == vertices.count() == n and faces.join(vertices.select(F.col("v").alias("v2")), "v2").count() == faces.count() > 0
        links = mesh.edges_from_faces(coarse_faces, ["sub"])
        return graph.geodesic_distances(coarse_vertices.select("sub", "v", F.lit(1.0).alias("g")), links, ["sub"], "g")

    def embed(dist, vertices, *_):
        assert dist.count() == m
        return vertices.select("sub", "v", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("grad"))

    for name, made in (("edge_density", density), ("distances", distances), ("embed", embed)):
        monkeypatch.setattr(f"surfparc.plans.gradient_embedding.{name}", made)
    monkeypatch.setattr("surfparc.operators.surface.smoothing_weights", lambda v, *_: v.select("sub", "v"))
    settings = config()
    settings["step0"].update(save_geodesic_distance=True, save_edge_density=True)
    settings["n_grad_components"] = 3
    run = Pipeline(spark, str(tmp_path), parse_config(settings))
    run.roster = bold.select("sub").distinct()
    grad = run._embedding(inputs)
    assert [(a, b, c) for (a, b), c in seen] == [(0, n - 1, n), (n, 2 * n - 1, n)]
    assert sorted(r.v for r in grad.select("v").collect()) == list(range(2 * n))
    dist = tables.read(spark, str(tmp_path), "distance")
    assert {(r.hemi, r.n, r.low, r.wide) for r in dist.groupBy("hemi").agg(F.count("src").alias("n"), F.min("src").alias("low"), F.max(F.size("dist")).alias("wide")).collect()} == {("lh", m, 0, m), ("rh", m, m, m)}
    assert tables.read(spark, str(tmp_path), "edge_density").count() == 2 * n
