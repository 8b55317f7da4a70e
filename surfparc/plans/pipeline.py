"""A whole run over a project folder: embedding, profiles, prior, parcellation."""

from __future__ import annotations

import functools
import json
import traceback
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.operators import ledger, mesh, surface
from surfparc.plans import gradient_embedding, group_prior, parcellation, profiles
from surfparc.plans.config import Config, read_config
from surfparc.session import cut
from surfparc.sources import files, tables, versions
from surfparc.streaming.progress import COHORT, Progress, plan_entries


class Pipeline:
    """Runs the steps a mode asks for and keeps the ledger, progress and run log.

    ``inputs`` names the tables a run needs: ``bold (sub, sess, run, v, ts)``,
    ``vertices (sub, v, x, y, z, mars, label, region``, with ``hemi`` if both
    hemispheres are stacked``)``, ``faces (sub, f, v0, v1,
    v2)``, and, for the embedding, ``coarse_vertices`` and ``coarse_faces``;
    ``group_vertices`` and ``group_faces`` (no ``sub``), if the cohort's mesh isn't
    the smallest subject's. With no training, ``theta`` and ``parcel`` hold the prior to use.
    """

    def __init__(self, spark: SparkSession, project: str, config: Config | None = None):
        self.spark, self.project = spark, project
        self.config = config or read_config(f"{project}/pipeline_config.json")
        self.progress = Progress(f"{project}/progress.jsonl")
        self.log: dict = {"success": False, "failed_at_step": None, "steps": []}

    def run(self, inputs: dict[str, DataFrame], seed_order: int, n_seeds: int) -> DataFrame:
        started = datetime.now(timezone.utc)
        step = "inputs"
        try:
            subs = [str(r[0]) for r in inputs["bold"].select("sub").distinct().orderBy("sub").collect()]
            sessions = inputs["bold"].select("sess").distinct().count()
            self._check(subs, inputs)
            self.roster = inputs["bold"].select("sub").distinct()
            self.progress.plan(plan_entries(subs, self.config.trains))
            gradient = None
            step = "step0"
            if parcellation.VARIANTS[self.config.variant].gradient_prior:
                gradient = self._note(step, subs, lambda: self._embedding(inputs))
            step = "step1"
            packed = self._note(step, subs, lambda: self._profiles(inputs, seed_order, n_seeds))
            step = "step1_avg"
            mean = self._note(step, [COHORT], lambda: self._keep(profiles.mean_profiles(packed, n_seeds), "mean_profile"))
            step = "step1_ini"
            cent = self._note(step, [COHORT], lambda: self._start(inputs, mean, n_seeds))
            step = "step1_mask"
            mask = self._note(step, [COHORT], lambda: self._mask(inputs))
            x = profiles.packed_profiles(packed, n_seeds)
            theta, parcel = inputs.get("theta"), inputs.get("parcel")
            if self.config.trains:
                step = "step2"
                theta, parcel = self._note(step, [COHORT], lambda: self._train(x, mask, cent, sessions, len(subs), n_seeds, gradient))
            step = "step3"
            labels = self._note(step, subs, lambda: self._parcellate(x, theta, parcel, inputs, sessions, n_seeds, gradient))
            self._ledger(inputs, seed_order)
            self.log["success"] = True
            return labels
        except Exception:
            self.log.update(failed_at_step=step, error=traceback.format_exc())
            raise
        finally:
            stamp = started.strftime("%Y%m%dT%H%M%S.%f")[:-3]
            self.log["started"] = started.replace(microsecond=0).isoformat()
            files.write_text(self.spark, f"{self.project}/logs/pipeline_run_{stamp}.json", json.dumps(self.log, indent=1))

    def _check(self, subs: list[str], inputs: dict) -> None:
        if self.config.mode == "modeA_single" and len(subs) != 1:
            raise ValueError(f"mode {self.config.mode} takes one subject, got {len(subs)}")
        if self.config.trains and len(subs) < 2:
            raise ValueError("training needs at least two subjects")
        if not self.config.trains and not {"theta", "parcel"} <= set(inputs):
            raise ValueError("no prior given and this mode trains none")

    def _note(self, step: str, slots: list[str], work):
        for s in slots:
            self.progress.state(step, s, "running")
        try:
            out = work()
        except Exception as e:
            for s in slots:
                self.progress.state(step, s, "failed", str(e))
            raise
        for s in slots:
            self.progress.state(step, s, "done")
        self.log["steps"].append(step)
        return out

    def _keep(self, df: DataFrame, artifact: str) -> DataFrame:
        """Write an artifact and read back what belongs to this run: subjects of earlier rosters stay on disk but out of it."""
        tables.write(df, self.project, artifact)
        back = tables.read(self.spark, self.project, artifact)
        return back.join(self.roster, "sub", "left_semi") if "sub" in tables.LAYOUT[artifact] else back

    def _embedding(self, inputs: dict) -> DataFrame:
        """Each hemisphere is embedded once, as a mesh of its own; what is stored is the union over sides."""
        c = self.config.step0
        k = gradient_embedding.Knobs(
            c["sub_FC"], c["sub_verts"], c["block_a"], c["smooth_sigma"], c["K_hop"], c["watershed_steps"], c["watershed_frac"], self.config.top["n_grad_components"]
        )
        parts = [self._embedding_of(hemi, side, k) for hemi, side in self._sides(inputs)]
        density, dist, grad = (functools.reduce(DataFrame.unionByName, p) for p in zip(*parts, strict=True))
        if c["save_edge_density"]:
            tables.write(density, self.project, "edge_density")
        if c["save_geodesic_distance"]:
            tables.write(dist, self.project, "distance")
        return self._keep(grad, "gradient")

    def _sides(self, inputs: dict) -> list[tuple[str, dict[str, DataFrame]]]:
        """Inputs by hemisphere; one mesh that names none is the side ``both``."""
        v = inputs["vertices"]
        if "hemi" not in v.columns:
            return [("both", inputs)]
        found = []
        for hemi in [r[0] for r in v.select("hemi").distinct().orderBy("hemi").collect()]:
            mine = {n: inputs[n].filter(F.col("hemi") == hemi).drop("hemi") for n in ("vertices", "coarse_vertices", "coarse_faces")}
            mine["faces"] = inputs["faces"].join(mine["vertices"].select("sub", F.col("v").alias("v0")), ["sub", "v0"], "left_semi")
            found.append((hemi, inputs | mine))
        return found

    def _embedding_of(self, hemi: str, side: dict, k: gradient_embedding.Knobs) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Edge density, geodesic distances (with their ``hemi``) and gradient coordinates of one side."""
        v, f = side["vertices"].withColumn("roi", F.col("mars") == 2), side["faces"]
        coarse = side["coarse_vertices"], side["coarse_faces"]
        edges = cut(mesh.with_length(mesh.edges_from_faces(f, ["sub"]), v, ["sub"]))
        weights = cut(surface.smoothing_weights(v, edges, f, ["sub"], k.sigma, "roi"))
        cortex = side["bold"].join(v.filter("roi").select("sub", "v"), ["sub", "v"], "left_semi")
        density = cut(gradient_embedding.edge_density(cortex, v, edges, f, weights, k))
        dist = cut(gradient_embedding.distances(density, v, f, *coarse, k))
        return density, dist.withColumn("hemi", F.lit(hemi)), cut(gradient_embedding.embed(dist, v, *coarse, k))

    def _profiles(self, inputs: dict, seed_order: int, n_seeds: int) -> DataFrame:
        return self._keep(profiles.binary_profiles(inputs["bold"], inputs["vertices"], seed_order, n_seeds, self.config.step1["threshold"]), "profile")

    def _start(self, inputs: dict, mean: DataFrame, n_seeds: int) -> DataFrame:
        v, _ = self._group_mesh(inputs)
        cent, eps = profiles.group_start(mean, v.select("v", "label"), n_seeds - 1)
        return self._keep(cent.withColumn("eps", F.lit(eps)), "group")

    def _mask(self, inputs: dict) -> DataFrame:
        v, f = self._group_mesh(inputs)
        mask = profiles.spatial_mask(v, f, ["sub"], self.config.step1["radius_mask_radius_mm"])
        hemi = F.col("hemi") if "hemi" in mask.columns else F.lit("both")
        return self._keep(mask.select("v", "l", hemi.alias("hemi")), "mask")

    def _group_mesh(self, inputs: dict) -> tuple[DataFrame, DataFrame]:
        """The mesh the cohort shares: ``group_vertices`` and ``group_faces``, else the smallest subject's.

        Labels, masks and path lengths of the prior are taken from it once, however many subjects there are.
        """
        if "group_vertices" in inputs:
            return inputs["group_vertices"].withColumn("sub", F.lit(0)), inputs["group_faces"].withColumn("sub", F.lit(0))
        first = inputs["vertices"].agg(F.min("sub")).first()[0]
        return inputs["vertices"].filter(F.col("sub") == first), inputs["faces"].filter(F.col("sub") == first)

    def _train(self, x, mask, cent, sessions: int, n: int, n_seeds: int, gradient) -> tuple[DataFrame, DataFrame]:
        got = group_prior.train(x, mask.select("v", "l"), cent.select("l", "mtc"), self.config.training(sessions, n), n_seeds - 1, gradient, lambda i, j: self.progress.iteration("step2", i, j))
        return self._keep(got["theta"], "prior_theta"), self._keep(got["parcel"], "prior_parcel")

    def _parcellate(self, x, theta, parcel, inputs: dict, sessions: int, n_seeds: int, gradient) -> DataFrame:
        v = inputs["vertices"]
        s = self.config.settings(sessions, v.groupBy("sub").count().agg(F.max("count")).first()[0])
        edges = mesh.edges_from_faces(inputs["faces"], ["sub"])
        got = parcellation.parcellate(x, theta, parcel, v, edges, self.config.variant, s, n_seeds - 1, gradient)
        return self._keep(got["labels"], "labels")

    def _meshes(self, inputs: dict, seed_order: int) -> tuple[str, str]:
        """Names of the target and the seed mesh, from what they hold, so that runs on other meshes are other runs."""
        v = inputs["vertices"].select(F.xxhash64("sub", "v", "x", "y", "z", "mars", "label", "region").alias("h"))
        f = inputs["faces"].select(F.xxhash64("sub", "f", "v0", "v1", "v2").alias("h"))
        whole = v.unionByName(f).agg(F.bit_xor("h").alias("a"), F.sum(F.pmod("h", F.lit(2**31))).alias("b"), F.count("h").alias("n")).first()
        target = f"{whole['n']}-{whole['a'] & (2**64 - 1):016x}{(whole['b'] or 0):x}"
        return target, f"{target}-seeds{seed_order}"

    def _ledger(self, inputs: dict, seed_order: int) -> None:
        target, seed = self._meshes(inputs, seed_order)
        roster = inputs["bold"].select(F.col("sub").cast("string").alias("id"), F.col("sess").cast("string").alias("sess")).distinct().withColumn("_all", F.lit(0))
        run = ledger.run_ids(roster, ["_all"], "id", "sess", target, seed, self.config.top["n_grad_components"]).first()["run_id"]
        new = roster.select("id").distinct().select(
            "id", F.lit(run).alias("run_id"), F.concat(F.lit("profile/sub="), "id").alias("profile"), F.lit(None).cast("string").alias("gradient")
        )
        if parcellation.VARIANTS[self.config.variant].gradient_prior:
            new = new.withColumn("gradient", F.concat(F.lit("gradient/sub="), "id"))
        versions.commit(self.spark, self.project, "ledger", lambda old: new if old is None else ledger.merge_subjects(new, old, ["profile", "gradient"]))
