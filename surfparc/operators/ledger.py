"""Cohort ledger, manifests and artifact names as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_subjects(new: DataFrame, old: DataFrame, artifacts: Sequence[str]) -> DataFrame:
    """New roster wins; missing artifacts carry over from the same run only.

    Subjects absent from the new roster drop out, as does everything recorded
    under another ``run_id``.
    """
    o = old.select("id", "run_id", *[F.col(a).alias(f"_{a}") for a in artifacts])
    joined = new.join(o, ["id", "run_id"], "left")
    return joined.select("id", "run_id", *[F.coalesce(a, f"_{a}").alias(a) for a in artifacts])


def run_ids(roster: DataFrame, keys: Sequence[str], subject: str, session: str, target: str, seed: str, n_components: int) -> DataFrame:
    """SHA-256 of the cohort definition per key: set-shaped, paths excluded.

    The digest is of compact JSON with sorted keys and sorted id lists, so order
    and storage layout do not change the identity.
    """
    ids = lambda c: F.to_json(F.sort_array(F.collect_set(F.col(c).cast("string"))))
    g = roster.groupBy(*keys).agg(ids(subject).alias("_s"), ids(session).alias("_t"))
    body = F.concat(
        F.lit(f'{{"n_grad_components":{int(n_components)},"seed":"{seed}","sessions":'), "_t", F.lit(',"subjects":'), "_s", F.lit(f',"targ":"{target}"}}')
    )
    return g.select(*keys, F.sha2(body, 256).alias("run_id"))


def nest_manifest(flat: DataFrame) -> DataFrame:
    """``sub, sess, lh, rh`` rows to one row per subject with its session list."""
    return flat.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("sess", "lh", "rh"))).alias("sessions"))


def flatten_manifest(nested: DataFrame) -> DataFrame:
    """One row per subject and session; paths trimmed."""
    return nested.select("sub", F.explode("sessions").alias("_s")).select("sub", "_s.sess", F.trim("_s.lh").alias("lh"), F.trim("_s.rh").alias("rh"))


def manifest_defects(flat: DataFrame) -> DataFrame:
    """Rows a run must reject: gaps in session numbers, missing or foreign paths."""
    last = flat.groupBy("sub").agg(F.max("sess").alias("n_max"), F.count(F.lit(1)).alias("n"))
    gii = lambda c: F.lower(F.trim(c)).endswith(".gii")
    d = flat.join(last, "sub").withColumn("gap", (F.col("n") != F.col("n_max")).cast("int"))
    d = d.withColumn("bad_lh", (~F.coalesce(gii("lh"), F.lit(False))).cast("int")).withColumn("bad_rh", (~F.coalesce(gii("rh"), F.lit(False))).cast("int"))
    return d.filter((F.col("gap") + F.col("bad_lh") + F.col("bad_rh")) > 0).select("sub", "sess", "gap", "bad_lh", "bad_rh")


def short_number(x: Column) -> Column:
    """Shortest plain form of a knob: ``5`` for 5.0, ``0.5`` for 0.5."""
    whole = x == F.floor(x)
    return F.when(whole, F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""))


def parcellation_name(subject: Column, w: Column, c: Column, beta: Column | None = None) -> Column:
    """File stem of an individual parcellation; the last part only where it applies."""
    parts = [F.lit("Ind_parcellation_sub"), subject.cast("string"), F.lit("_w"), short_number(w), F.lit("_MRF"), short_number(c)]
    if beta is not None:
        parts += [F.lit("_beta"), short_number(beta)]
    return F.concat(*parts)
