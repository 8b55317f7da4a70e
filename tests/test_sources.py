import base64
import json
import struct
import zlib

import numpy as np
import pytest

from surfparc.plans.config import parse_config
from surfparc.operators import ledger
from surfparc.sources import matfile, surface_files, tables
from surfparc.streaming import progress, running_mean
from surfparc.functions import bits
from pyspark.sql import functions as F


def darray(x, kind="NIFTI_TYPE_FLOAT32", intent="NIFTI_INTENT_TIME_SERIES", endian="LittleEndian"):
    body = base64.b64encode(zlib.compress(x.tobytes())).decode()
    return f'<DataArray Intent="{intent}" DataType="{kind}" Encoding="GZipBase64Binary" Endian="{endian}" Dim0="{len(x)}"><Data>{body}</Data></DataArray>'


def test_series_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(7, 4)).astype("<f4")
    (tmp_path / "a.func.gii").write_text("<GIFTI>" + "".join(darray(x[:, t].copy()) for t in range(4)) + "</GIFTI>")
    got = surface_files.read_series(spark, str(tmp_path / "a.func.gii"), expected=7).orderBy("v").collect()
    assert np.array_equal(np.array([r.ts for r in got], dtype="f4"), x)
    for bad in (darray(x[:, 0].copy(), endian="BigEndian"), darray(x[:, 0].copy()) + darray(x[:3, 1].copy()), "<DataArray Dim0='1'>", ""):
        with pytest.raises(ValueError):
            surface_files.parse_series(bad.encode(), "x")


def test_series_of_a_manifest_stack_both_sides(spark, tmp_path):
    from surfparc.sources import project, tables

    rng, made = np.random.default_rng(1), {}
    for sub in (1, 2):
        for hemi, n in (("lh", 3), ("rh", 2)):
            x = rng.normal(size=(n, 4)).astype("<f4")
            x[0, 1] = np.nan
            made[sub, hemi] = x
            (tmp_path / f"s{sub}.{hemi}.func.gii").write_text("<GIFTI>" + "".join(darray(x[:, t].copy()) for t in range(4)) + "</GIFTI>")
    manifest = spark.createDataFrame([(str(s), 1, f"s{s}.lh.func.gii", f"{tmp_path}/s{s}.rh.func.gii") for s in (1, 2)], "sub string, sess int, lh string, rh string")
    (tmp_path / "censor.txt").write_text("1 0 1 1\n")
    censor = tables.read_censor(spark, str(tmp_path / "censor.txt")).withColumn("path", F.lit(f"{tmp_path}/s2.rh.func.gii"))
    rows = project.series_from_manifest(spark, manifest, str(tmp_path), 3, 2, censor).collect()
    assert len(rows) == 10
    for r in rows:
        want = np.nan_to_num(made[r["sub"], "lh" if r.v < 3 else "rh"][r.v if r.v < 3 else r.v - 3])
        assert np.allclose(r.ts, want[[0, 2, 3]] if r["sub"] == 2 and r.v >= 3 else want)
    with pytest.raises(Exception, match="expected 4"):
        project.series_from_manifest(spark, manifest, str(tmp_path), 4, 2).collect()


def test_stored_prior_comes_back(spark, tmp_path):
    from surfparc.sources import project, tables

    tables.write(spark.createDataFrame([(0, 1, 0.5)], "v long, l int, theta double"), str(tmp_path), "prior_theta")
    tables.write(spark.createDataFrame([(1, [0.6, 0.8], 3.0, 4.0)], "l int, mu array<double>, sigma double, eps double"), str(tmp_path), "prior_parcel")
    got = project.read_prior(spark, str(tmp_path))
    assert tuple(got["theta"].first()) == (0, 1, 0.5) and tuple(got["parcel"].first()) == (1, [0.6, 0.8], 3.0, 4.0)


def test_mesh_and_annotation_files(spark, tmp_path):
    p, f = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], ">f4"), np.array([[0, 1, 2]], ">i4")
    blob = b"\xff\xff\xfecreated\n\n" + struct.pack(">2i", 3, 1) + p.tobytes() + f.tobytes()
    (tmp_path / "lh.sphere").write_bytes(blob)
    v, faces = surface_files.read_mesh(spark, str(tmp_path / "lh.sphere"))
    assert v.count() == 3 and faces.first().v2 == 2
    with pytest.raises(ValueError):
        surface_files.parse_mesh(b"", "x.func.gii")
    code = lambda r, g, b: r + 256 * g + 65536 * b
    entry = lambda i, n, r, g, b: struct.pack(">2i", i, len(n)) + n + struct.pack(">4i", r, g, b, 0)
    head = lambda vals: struct.pack(">i", len(vals)) + b"".join(struct.pack(">2i", i, c) for i, c in vals)
    table = struct.pack(">3i", 1, -2, 3) + struct.pack(">i", 4) + b"tab\0" + struct.pack(">i", 2) + entry(1, b"one\0", 1, 2, 3) + entry(2, b"two\0", 9, 0, 0)
    (tmp_path / "lh.annot").write_bytes(head([(2, code(9, 0, 0)), (0, code(1, 2, 3)), (1, 0)]) + table)
    got = surface_files.group_labels(surface_files.read_annotation(spark, str(tmp_path / "lh.annot"))).orderBy("v").collect()
    assert [r.label for r in got] == [1, 0, 2]
    with pytest.raises(ValueError, match="not in the colour table"):
        surface_files.parse_annotation(head([(0, 77)]) + table, "x")
    with pytest.raises(ValueError, match="missing"):
        surface_files.parse_annotation(head([(0, 0), (0, 0)]) + table, "x")


def element(kind, data):
    return struct.pack("<2I", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, cls, dims, parts):
    body = element(6, struct.pack("<2I", cls, 0)) + element(5, np.array(dims, "<i4").tobytes()) + element(1, name.encode()) + b"".join(parts)
    return element(14, body)


@pytest.mark.parametrize("packed", [False, True])
def test_matrix_files(spark, tmp_path, packed):
    dense = np.array([[1.0, 0.0], [2.0, 3.0]])
    a = matrix("mu", 6, (2, 2), [element(9, dense.tobytes(order="F"))])
    b = matrix("theta", 5, (3, 2), [element(5, np.array([0, 2, 1], "<i4").tobytes()), element(5, np.array([0, 2, 3], "<i4").tobytes()), element(9, np.array([0.5, 0.25, 4.0]).tobytes())])
    if packed:
        a, b = (struct.pack("<2I", 15, len(z)) + z for z in (zlib.compress(a), zlib.compress(b)))
    (tmp_path / "p.mat").write_bytes(b"\0" * 128 + a + b)
    got = {(r.row, r.col): r.value for r in matfile.read_matrix(spark, str(tmp_path / "p.mat"), "theta").collect()}
    assert got == {(0, 0): 0.5, (2, 0): 0.25, (1, 1): 4.0}
    got = {(r.row, r.col): r.value for r in matfile.read_matrix(spark, str(tmp_path / "p.mat"), "mu").collect()}
    assert got == {(0, 0): 1.0, (1, 0): 2.0, (1, 1): 3.0}


def manifest(**change):
    m = {"schema_version": "1", "dataset_name": "d", "targ_mesh": "a", "seed_mesh": "b", "subjects": [
        {"id": str(i), "sessions": [{"id": str(j), "lh": f" /x/{i}{j}.func.GII ", "rh": "/y.gii"} for j in (1, 2)]} for i in (1, 2)]}
    return {**m, **change}


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps(manifest()))
    rows = tables.read_manifest(spark, str(p)).orderBy("sub", "sess").collect()
    assert len(rows) == 4 and rows[0].lh == "/x/11.func.GII"
    ragged = manifest()
    ragged["subjects"][1]["sessions"].pop()
    wrong = manifest()
    wrong["subjects"][0]["id"] = "7"
    text = manifest()
    text["subjects"][0]["sessions"][0]["lh"] = "/x.nii"
    for bad in (manifest(schema_version="2"), manifest(subjects=[]), ragged, wrong, text):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            tables.read_manifest(spark, str(p))


def config():
    return {
        "schema_version": "2", "mode": "modeA_batch", "variant": "distributed", "num_clusters": 4, "beta_scalar": 5, "w": 50, "c": 10, "n_grad_components": 3,
        "step0": {"sub_FC": 2, "sub_verts": 4, "block_a": 3, "smooth_sigma": 2.55, "K_hop": 2, "watershed_steps": 10, "watershed_frac": 1.0,
                  "save_geodesic_distance": False, "save_edge_density": True},
        "step1": {"threshold": 0.1, "radius_mask_radius_mm": 60.0},
        "step3": {"connect_th": None, "epsilon": 1e-4, "max_iter_intra_em": 1, "max_iter_em": 1, "max_iter_lambda": 1, "max_iter_m": 3, "max_iter_comp": 1, "isolated_component_min_size": 5},
    }


def test_config_rules():
    assert parse_config(config()).variant == "distributed"
    def broken(block, key, value, drop=False):
        c = config()
        at = c if block is None else c[block]
        at.pop(key) if drop else at.__setitem__(key, value)
        with pytest.raises(ValueError):
            parse_config(c)
    broken(None, "variant", "garbage")
    broken(None, "variant", "d")
    broken(None, "w", 0)
    broken("step3", "x_isolated_component_min_size", 5)
    broken("step0", "downsample", 3.2)
    broken("step1", "threshold", 1.5)
    broken("step1", "threshold", True)
    broken("step0", "K_hop", 0)
    broken("step0", "K_hop", 2.5)
    broken("step3", "epsilon", float("inf"))
    broken("step3", "extra", 1)
    broken("step3", "max_iter_m", None, drop=True)
    broken(None, "mode", "other")
    broken(None, "variant", "x")
    broken(None, "step2", {})
    broken(None, "step1", None, drop=True)
    broken(None, "mode", "modeB_train_prior")


def test_ledger_merge_rules(spark):
    old = spark.createDataFrame([("1", "r", "p1", "g1"), ("2", "r", "p2", None), ("9", "r", "p9", None), ("3", "old", "p3", "g3")], "id string, run_id string, p string, g string")
    new = spark.createDataFrame([("1", "r", None, "n1"), ("2", "r", "n2", None), ("3", "r", None, None), ("4", "r", "n4", None)], "id string, run_id string, p string, g string")
    got = {r.id: (r.p, r.g) for r in ledger.merge_subjects(new, old, ["p", "g"]).collect()}
    assert got == {"1": ("p1", "n1"), "2": ("n2", None), "3": (None, None), "4": ("n4", None)}


def test_run_id_is_set_shaped(spark):
    import hashlib

    a = spark.createDataFrame([(0, "2", "1"), (0, "1", "1"), (0, "10", "2")], "k int, s string, t string")
    blob = json.dumps({"subjects": sorted(["2", "1", "10"]), "sessions": ["1", "2"], "targ": "x", "seed": "y", "n_grad_components": 5}, sort_keys=True, separators=(",", ":"))
    assert ledger.run_ids(a, ["k"], "s", "t", "x", "y", 5).first().run_id == hashlib.sha256(blob.encode()).hexdigest()


def test_progress_log(spark, tmp_path):
    p = progress.Progress(str(tmp_path / "progress.jsonl"))
    p.plan(progress.plan_entries(["1", "2"], train=True))
    p.state("step0", "1", "running")
    p.state("step0", "1", "done")
    p.iteration("step2", 1, 2)
    got = {(r.step, r.sub_id): r.state for r in progress.latest_states(progress.read_progress(spark, str(tmp_path / "progress.jsonl"))).collect()}
    assert got["step0", "1"] == "done" and got["step2", "cohort"] == "pending" and len(got) == 10
    progress.Progress(str(tmp_path / "no" / "dir")).state("step0", "1", "done")


def test_running_mean_grows_by_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (3, 4, 70))
    want = rows.mean(axis=0)
    schema = "v long, words array<bigint>"
    for i in range(3):
        df = spark.createDataFrame([(v, [int(b) for b in rows[i, v]]) for v in range(4)], "v long, b array<int>").select("v", bits.pack(F.col("b"), 70).alias("words"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = running_mean.accumulate(running_mean.stream_profiles(spark, str(tmp_path / "in"), schema), ["v"], "words", str(tmp_path / "state"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    got = running_mean.current_mean(spark, str(tmp_path / "state"), ["v"], 70).collect()
    assert len(got) == 280 and all(r["mean"] == pytest.approx(want[r.v, r.pos]) for r in got)


def test_artifacts_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([("1", 1, 5), ("2", 1, 6)], "sub string, sess int, x int")
    tables.write(df, str(tmp_path), "profile")
    tables.write(df.filter("sub = '2'").withColumn("x", F.lit(9)), str(tmp_path), "profile")
    assert {(r["sub"], r.x) for r in tables.read(spark, str(tmp_path), "profile").select(F.col("sub").cast("string"), "x").collect()} == {("1", 5), ("2", 9)}
    plan = tables.read(spark, str(tmp_path), "profile", sub=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sub" in plan
