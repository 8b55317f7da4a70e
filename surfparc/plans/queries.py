"""Every operator as a query over the input tables. Names match ``oracles.py``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from surfparc.functions import bits
from surfparc.functions.special import bessel_ratio, cdln_column, inv_ad
from surfparc.functions.vectors import (
    binarize, demean_unit_nonzero, dot, log_or_floor, log_or_neg_inf, nan_to_zero, round6, unit, unit_sphere, vsum, zscore_unit,
)
from surfparc.operators import aggregates as agg
from surfparc.operators import connectedness as con
from surfparc.operators import correlation as cor
from surfparc.operators import em, filters, graph, ledger, mesh, ranking, surface
from surfparc.operators.blocks import block_apply
from surfparc.operators.diffusion import diffusion_map
from surfparc.plans import group_prior, parcellation, profiles
from surfparc.session import cut
from surfparc.plans.stand_in import DIM, MESH_SIZE, day_flags, day_series, grid_edges, grid_faces, profile, table
from surfparc.plans.stand_in import mesh as mesh_table

KAPPA = 20.0
FRACTION = 0.1

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in cols})


# ---- projections -------------------------------------------------------------


@query
def unit_norm_vectors(spark: SparkSession, folder: str) -> DataFrame:
    d = demean_unit_nonzero(table(spark, folder, "embeddings"), "embedding", "u")
    return rounded(d.select("vec_id", F.posexplode("u").alias("d", "value")), "value")


@query
def bold_zscore(spark, folder):
    z = zscore_unit(day_series(spark, folder), "ts", "z")
    return rounded(z.select("run", F.col("v").alias("user_id"), F.posexplode("z").alias("t", "z")), "z")


@query
def clean_ratios(spark, folder):
    li = table(spark, folder, "lineitem")
    zero = F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))
    raw = F.when(F.col("l_discount") == 0, zero).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return rounded(li.select("l_orderkey", "l_linenumber", nan_to_zero(raw).alias("ratio")), "ratio")


@query
def log_policies(spark, folder):
    g = table(spark, folder, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    score = log_or_neg_inf(F.col("l_discount"))
    return rounded(
        g.select("l_discount", "n", (score == float("-inf")).cast("int").alias("score_is_neg_inf"), log_or_floor(F.col("l_discount")).alias("log_cost")), "log_cost"
    )


@query
def sphere_projection(spark, folder):
    m = mesh_table(spark, folder)
    ux, uy, uz = unit_sphere(F.col("x") - 100.0, F.col("y") - 45.0, F.col("z") + 50.0)
    return rounded(m.select("sub", "v", ux.alias("ux"), uy.alias("uy"), uz.alias("uz")), "ux", "uy", "uz")


@query
def renumber_labels(spark, folder):
    c = table(spark, folder, "customer")
    d = c.withColumn("gap_label", F.when(F.col("c_acctbal") < 0, 0).otherwise(F.col("c_nationkey") * 3)).select("c_custkey", "c_mktsegment", "gap_label")
    return ranking.renumber(d, ["c_mktsegment"], "gap_label", "label").select("c_custkey", "c_mktsegment", "gap_label", F.col("label").cast("bigint").alias("label"))


@query
def icosphere_counts(spark, folder):
    from surfparc.functions.vectors import icosphere_size

    g = table(spark, folder, "customer").select((F.col("c_nationkey") % 7).alias("mesh_order")).groupBy("mesh_order").agg(F.count(F.lit(1)).alias("n"))
    return g.select("mesh_order", "n", icosphere_size(F.col("mesh_order")).alias("n_vertices"))


# ---- thresholds and bit profiles --------------------------------------------


def _thresholds(m: DataFrame) -> DataFrame:
    return ranking.top_fraction_threshold(m.select("sub", F.explode("emb").alias("x")), ["sub"], "x", FRACTION)


def _words(m: DataFrame) -> DataFrame:
    on = m.join(_thresholds(m), "sub").withColumn("bits", binarize(F.col("emb"), F.col("threshold")))
    on = filters.zero_wall_profiles(on, F.col("mars") == 1, "bits")
    return on.select("sub", "v", "label", "keep", bits.pack(F.col("bits"), DIM).alias("words"))


@query
def top_fraction_binarize(spark, folder):
    m = mesh_table(spark, folder)
    on = m.join(_thresholds(m), "sub").withColumn("bits", binarize(F.col("emb"), F.col("threshold")))
    n = F.aggregate("bits", F.lit(0), lambda a, b: a + b).cast("bigint")
    return rounded(on.select("sub", "v", "threshold", n.alias("n_on")), "threshold")


@query
def bit_profile_pack(spark, folder):
    return _words(mesh_table(spark, folder)).select("sub", "v", F.posexplode("words").alias("word_index", "word")).withColumn("word_index", F.col("word_index").cast("bigint"))


@query
def popcount_stats(spark, folder):
    s = bits.with_packed_stats(_words(mesh_table(spark, folder)), "words", DIM)
    out = s.select("sub", "v", F.col("ones").cast("bigint").alias("ones"), "row_mean", "row_sumsq", "value_on", "value_off", F.col("is_scaled").cast("int").alias("is_scaled"))
    return rounded(out, "row_mean", "row_sumsq", "value_on", "value_off")


@query
def packed_normalize(spark, folder):
    s = bits.with_packed_stats(_words(mesh_table(spark, folder)), "words", DIM)
    return rounded(s.select("sub", "v", F.posexplode(bits.normalized(F.col("words"), DIM)).alias("d", "value")), "value")


@query
def cohort_mean_profile(spark, folder):
    out = agg.cohort_mean_profile(_words(mesh_table(spark, folder)), ["v"], "words", DIM)
    return rounded(out.select("v", F.col("pos").cast("bigint").alias("pos"), "mean"), "mean")


@query
def merged_mean_profile(spark, folder):
    w = _words(mesh_table(spark, folder))
    early = agg.bit_sums(w.filter(F.col("sub") % 2 == 0), ["v"], "words")
    late = agg.bit_sums(w.filter(F.col("sub") % 2 == 1), ["v"], "words")
    m = agg.merge_mean_state(early, late, ["v"])
    return rounded(m.select("v", F.col("pos").cast("bigint").alias("pos"), "ones", "n", (F.col("ones") / F.col("n")).alias("mean")), "mean")


# ---- centroids and soft assignment ------------------------------------------


def _centroids(m: DataFrame) -> DataFrame:
    """One unit vector per subject and parcel."""
    long = agg.parcel_centroids(m, "label", "emb", ["sub"])
    return agg.gather_vectors(long, ["sub", "label"], "mtc", "centroid").withColumnRenamed("label", "l")


def _products(m: DataFrame, cent: DataFrame) -> DataFrame:
    """Dot product of every vertex with its subject's parcels (a model-sized list)."""

    def work(rows: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cols = ["sub", "v", "l", "acc"]
        if not len(rows) or not len(c):
            return pd.DataFrame(columns=cols)
        c = c.sort_values("l")
        s = np.stack(rows["emb"].to_list()) @ np.stack(c["centroid"].to_list()).T
        return pd.DataFrame(
            {"sub": rows["sub"].iloc[0], "v": np.repeat(rows["v"].to_numpy(), len(c)), "l": np.tile(c["l"].to_numpy(), len(rows)), "acc": s.ravel()}
        )[cols]

    return block_apply(m.filter("mars = 2").select("sub", "v", "emb"), cent, ["sub"], "v", work, "sub long, v long, l int, acc double")


def _soft(spark, folder, kappa: float = KAPPA) -> DataFrame:
    m = mesh_table(spark, folder)
    p = _products(m, _centroids(m))
    return ranking.masked_softmax(p.withColumn("score", F.col("acc") * kappa), ["sub", "v"], "score").select("sub", "v", "l", "acc", "lam")


@query
def parcel_centroids(spark, folder):
    e = table(spark, folder, "embeddings")
    return rounded(agg.parcel_centroids(e, "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"), "mtc"), "mtc")


@query
def own_parcel_cosine(spark, folder):
    e = table(spark, folder, "embeddings")
    c = agg.gather_vectors(agg.parcel_centroids(e, "label", "embedding"), ["label"], "mtc", "centroid")
    return rounded(agg.own_parcel_cosine(e, c, "label", "embedding"), "rbar")


@query
def soft_assign(spark, folder):
    return rounded(_soft(spark, folder).select("sub", "v", "l", "lam"), "lam")


@query
def argmax_labels(spark, folder):
    s = _soft(spark, folder)
    return rounded(ranking.argmax_labels(s, ["sub", "v"], "l", "lam"), "best")


@query
def row_softmax_masked(spark, folder):
    m = mesh_table(spark, folder)
    p = _products(m, _centroids(m)).join(m.select("sub", "v", "label"), ["sub", "v"])
    p = p.withColumn("near", F.abs(F.col("l") - F.col("label")) <= 2).withColumn("score", F.col("acc") * KAPPA)
    return rounded(ranking.masked_softmax(p, ["sub", "v"], "score", "near").select("sub", "v", "l", "lam"), "lam")


@query
def weighted_group_sum(spark, folder):
    m = mesh_table(spark, folder)
    s = _soft(spark, folder).join(m.select("sub", "v", "emb"), ["sub", "v"])
    x = agg.sum_vectors(s, ["sub", "l"], "emb", F.col("lam"), "xdot")
    return rounded(x.select("sub", "l", F.posexplode("xdot").alias("pos", "xdot")), "xdot")


@query
def mean_resultant(spark, folder):
    m = mesh_table(spark, folder)
    s = _soft(spark, folder)
    x = agg.sum_vectors(s.join(m.select("sub", "v", "emb"), ["sub", "v"]), ["sub", "l"], "emb", F.col("lam"), "xdot")
    nu = _centroids(m).withColumnRenamed("centroid", "nu")
    return rounded(agg.mean_resultant(nu, x, s, ["sub"], 1).select("sub", "num", "den", "rbar"), "num", "den", "rbar")


def _n_subjects(spark, folder) -> int:
    return mesh_table(spark, folder).select("sub").distinct().count()


@query
def theta_mean(spark, folder):
    return rounded(agg.mean_over_subjects(_soft(spark, folder), _n_subjects(spark, folder)), "theta")


@query
def theta_init(spark, folder):
    s = _soft(spark, folder).withColumn("lam", F.when(F.col("lam") > 0.1, F.col("lam")).otherwise(0.0))
    return rounded(agg.initial_theta(s, s.select("v", "l"), _n_subjects(spark, folder)), "theta")


@query
def group_direction(spark, folder):
    m = mesh_table(spark, folder)
    psi = _centroids(m).withColumnRenamed("centroid", "psi")
    prev = psi.groupBy("l").agg(F.min_by("psi", "sub").alias("mu"))
    return rounded(agg.group_direction(psi, prev).select("l", F.posexplode("mu").alias("pos", "mu")), "mu")


@query
def subject_direction(spark, folder):
    m = mesh_table(spark, folder)
    nu = _centroids(m).withColumnRenamed("centroid", "nu")
    first = nu.groupBy("l").agg(F.min_by("nu", "sub").alias("mu"))
    parcel = first.select("l", "mu", F.lit(3.0).alias("sigma"), F.lit(2.0).alias("eps"))
    out = em.subject_direction(nu, parcel, 1, DIM)
    return rounded(out.select("sub", "l", F.posexplode("psi").alias("pos", "psi")), "psi")


@query
def em_cost(spark, folder):
    s = _soft(spark, folder)
    e = grid_edges(mesh_table(spark, folder))
    c = graph.potts(s, e, ["sub"]).withColumns(
        {"kappa": F.lit(KAPPA), "cdln": F.lit(1.5), "t": F.lit(1), "theta": F.lit(0.1) * F.col("l"), "beta": F.lit(2.0), "scv": -F.abs("acc")}
    )
    return rounded(agg.em_cost(c, ["sub"], 0.5, 0.25), "cost")


@query
def outer_cost(spark, folder):
    m = mesh_table(spark, folder)
    psi = _centroids(m).withColumnRenamed("centroid", "psi")
    mu = psi.groupBy("l").agg(F.min_by("psi", "sub").alias("mu"))
    parcel = mu.withColumn("sigma", 30.0 + F.col("l")).withColumn("eps", 40.0 + F.col("l"))
    nu = psi.withColumnRenamed("psi", "nu")
    return rounded(agg.outer_cost(psi, nu, parcel, DIM, _n_subjects(spark, folder), 1), "cost")


@query
def mean_abs_drift(spark, folder):
    a, b = _soft(spark, folder, 10.0), _soft(spark, folder, KAPPA)
    return rounded(agg.mean_abs_drift(a, b, ["sub", "v", "l"], ["sub"], F.lit(float(MESH_SIZE * 9))), "drift")


@query
def dead_columns(spark, folder):
    s = _soft(spark, folder).withColumn("acc", F.when(F.col("l") % 3 == 0, 0.0).otherwise(F.col("acc")))
    d = agg.dead_columns(s, ["sub", "l"], "acc")
    return d.select("sub", "l", F.col("all_zero").cast("int").alias("all_zero"), F.col("any_nan").cast("int").alias("any_nan"))


@query
def value_extent(spark, folder):
    return rounded(agg.extent(table(spark, folder, "events"), ["event_type"], "value"), "lo", "hi", "abs_hi")


@query
def converged_flags(spark, folder):
    m = mesh_table(spark, folder)
    psi = _centroids(m).withColumnRenamed("centroid", "psi")
    prev = psi.groupBy("l").agg(F.min_by("psi", "sub").alias("mu"))
    mu = agg.group_direction(psi, prev)
    c = psi.join(mu, "l").withColumn("cos", dot(F.col("psi"), F.col("mu")))
    f = agg.converged_flags(c, ["l"], "cos", 0.5, F.col("sub") < 0)
    return f.select("l", F.col("converged").cast("int").alias("converged"))


@query
def connect_prior(spark, folder):
    m = mesh_table(spark, folder)
    s = _soft(spark, folder)
    g = m.select("sub", "v", F.col("emb").alias("grad"))
    return rounded(em.connect_prior(s, g).select("sub", "v", "l", "scv"), "scv")


@query
def sphere_prior(spark, folder):
    m = mesh_table(spark, folder)
    ux, uy, uz = unit_sphere(F.col("x") - 100.0, F.col("y") - 45.0, F.col("z") + 50.0)
    s = _soft(spark, folder)
    gamma = s.select("sub", "l").distinct().withColumn("gamma", (F.col("l") % 3) * 1000.0)
    return rounded(em.sphere_prior(s, m.select("sub", "v", ux.alias("ux"), uy.alias("uy"), uz.alias("uz")), gamma).select("sub", "v", "l", "sxv"), "sxv")


@query
def assignment_round(spark, folder):
    s = _soft(spark, folder).withColumn("acc", F.when(F.col("l") == 9, 0.0).otherwise(F.col("acc")))
    s = em.flag_dead(s)
    s = s.withColumn("score0", 5.0 * F.col("acc") + F.when(F.col("dead"), 0.0).otherwise(1.5) + 0.5 * log_or_neg_inf(0.1 * F.col("l")))
    out = em.assignment_round(graph.potts(s, grid_edges(mesh_table(spark, folder)), ["sub"]), 0.25)
    return rounded(out.select("sub", "v", "l", F.col("new").alias("lam")), "lam")


# ---- special functions -------------------------------------------------------


@query
def bessel_cdln(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", (F.abs(F.col("embedding")[0].cast("double")) * 500.0 + 1.0).alias("kappa"))
    return rounded(e.select("vec_id", cdln_column(F.col("kappa"), DIM).alias("cdln64"), cdln_column(F.col("kappa"), 3).alias("cdln3")), "cdln64", "cdln3")


@query
def inv_ad_round_trip(spark, folder):
    m = mesh_table(spark, folder)

    @pandas_udf("double")
    def there_and_back(r: pd.Series) -> pd.Series:
        # A parcel of one vertex is its own centroid; rounding may take its cosine past one.
        return pd.Series(bessel_ratio(DIM, inv_ad(DIM, np.minimum(r.to_numpy(), 1.0))))

    c = m.filter("label > 0").join(_centroids(m).withColumnRenamed("l", "label"), ["sub", "label"])
    r = c.groupBy("sub", "label").agg(F.avg(dot(F.col("emb"), F.col("centroid"))).alias("rbar"))
    return rounded(r.select("sub", "label", "rbar", there_and_back("rbar").alias("back")), "rbar", "back")


# ---- correlations -------------------------------------------------------------

SEED_ORDER = 1


def _seed_corr(spark, folder) -> DataFrame:
    s = cut(day_series(spark, folder))
    seeds = filters.seed_vertices(s.withColumn("mars", F.lit(2)), "v", "mars", SEED_ORDER)
    return cor.seed_correlation(s, seeds, ["run"], "v", "ts"), seeds


@query
def run_mean_correlation(spark, folder):
    c, seeds = _seed_corr(spark, folder)
    ids = seeds.groupBy("run").agg(F.sort_array(F.collect_set("v")).alias("ids"))
    long = c.join(ids, "run").select("v", F.explode(F.arrays_zip("ids", "corr")).alias("_z"))
    out = long.groupBy(F.col("v").alias("user_id"), F.col("_z.ids").alias("seed")).agg(F.avg("_z.corr").alias("corr"))
    return rounded(out, "corr")


@query
def run_correlation_profile(spark, folder):
    c, _ = _seed_corr(spark, folder)
    t = ranking.top_fraction_threshold(c.select("run", F.explode("corr").alias("x")), ["run"], "x", FRACTION)
    on = c.join(t, "run").withColumn("bits", binarize(F.col("corr"), F.col("threshold")))
    n = F.aggregate("bits", F.lit(0), lambda a, b: a + b).cast("bigint")
    return rounded(on.select("run", F.col("v").alias("user_id"), "threshold", n.alias("n_on")), "threshold")


@query
def session_mean_correlation(spark, folder):
    c, _ = _seed_corr(spark, folder)
    m = agg.mean_of_few(c.withColumn("pair", F.when(F.col("run").isin("view", "click"), "browse").otherwise("act")), ["pair", "v"], "corr", "mean")
    return rounded(m.select("pair", F.col("v").alias("user_id"), vsum(F.col("mean")).alias("total")), "total")


@query
def fc_similarity(spark, folder):
    # Users in runs of 250 stand for one subject's mesh, so both samples stay mesh-sized.
    keys = ["run", "sub"]
    s = cut(day_series(spark, folder).withColumn("sub", F.floor(F.col("v") / MESH_SIZE)))
    refs = filters.random_subset(s, keys, "v", 5.0, 1).select(*keys, "v", "ts")
    cols = filters.random_subset(s, keys, "v", 10.0, 2).select(*keys, "v")
    f = cor.profile_similarity(s, refs, cols, keys, "v", "ts")
    ids = cols.groupBy(*keys).agg(F.sort_array(F.collect_set("v")).alias("ids"))
    out = f.join(ids, keys).select("run", F.col("v").alias("user_id"), F.explode(F.arrays_zip("ids", "similarity")).alias("_z"))
    return rounded(out.select("run", "user_id", F.col("_z.ids").alias("other"), F.col("_z.similarity").alias("similarity")), "similarity")


# ---- filters -------------------------------------------------------------------


@query
def censored_series(spark, folder):
    s = day_series(spark, folder).join(day_flags(spark, folder), "run")
    k = s.withColumn("kept", filters.censor(F.col("ts"), F.col("keep")))
    return rounded(k.select("run", F.col("v").alias("user_id"), F.size("kept").cast("bigint").alias("n_kept"), vsum(F.col("kept")).alias("kept_sum")), "kept_sum")


@query
def concat_hemispheres(spark, folder):
    m = mesh_table(spark, folder).withColumn("medial", F.col("label") == 0)
    half = MESH_SIZE // 2
    lh = m.filter(F.col("v") < half).select("sub", "v", "medial", "emb")
    rh = m.filter(F.col("v") >= half).select("sub", (F.col("v") - half).alias("v"), "medial", "emb")
    both = filters.concat_hemispheres(lh, rh, "v", half, "medial", "emb")
    return rounded(both.select("sub", "hemi", "v", vsum(F.col("emb")).alias("total")), "total")


@query
def wall_zeroing(spark, folder):
    m = mesh_table(spark, folder)
    z = filters.zero_wall_profiles(m, F.col("mars") == 1, "emb")
    return rounded(z.select("sub", "v", F.col("keep").cast("int").alias("keep"), vsum(F.col("emb")).alias("total")), "total")


@query
def wall_words_check(spark, folder):
    w = _words(mesh_table(spark, folder)).withColumn("ones", bits.popcount(F.col("words")).cast("bigint"))
    ok = filters.require_none(w, (F.col("label") == 0) & (F.col("ones") > 0), "wall rows must be empty")
    return ok.select("sub", "v", "ones")


@query
def seed_selection(spark, folder):
    return filters.seed_vertices(mesh_table(spark, folder), "v", "mars", SEED_ORDER).select("sub", "v")


def _brains(m: DataFrame) -> DataFrame:
    """Pairs of meshes as the stacked hemispheres of one brain."""
    side = F.when(F.col("sub") % 2 == 0, "lh").otherwise("rh")
    return m.withColumn("hemi", side).withColumn("v", F.col("v") + MESH_SIZE * (F.col("sub") % 2)).withColumn("sub", F.floor(F.col("sub") / 2))


@query
def two_sided_seeds(spark, folder):
    return filters.two_sided_seeds(_brains(mesh_table(spark, folder)), ["sub"], "v", "hemi", "mars", SEED_ORDER).select("sub", "hemi", "v")


@query
def two_sided_profile(spark, folder):
    """Correlations of each vertex's vector with those of both hemispheres' seeds, thresholded together."""
    b = _brains(mesh_table(spark, folder))
    bold = b.select("sub", F.lit(1).alias("sess"), F.lit(1).alias("run"), "v", F.col("emb").alias("ts"))
    n = filters.two_sided_seeds(b, ["sub"], "v", "hemi", "mars", SEED_ORDER).groupBy("sub").count().agg(F.max("count")).first()[0] or 1
    packed = profiles.binary_profiles(bold, b, SEED_ORDER, n, 0.1)
    return packed.select("sub", "v", F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w)).cast("long").alias("n_on"))


@query
def cross_hemisphere_cells(spark, folder):
    b = _brains(mesh_table(spark, folder)).select("sub", "v", "hemi", "label")
    cells = ranking.stack_labels(b, "hemi", "label", 9).filter("label > 0")
    around = F.explode(F.array(*[F.col("v") + F.lit(d).cast("long") for d in (-MESH_SIZE, -1, 0, 1, MESH_SIZE)]))
    near = cells.select("sub", "label", around.alias("w")).join(b.select("sub", F.col("v").alias("w"), F.col("hemi").alias("hemi_w")), ["sub", "w"])
    both = near.select("sub", F.col("w").alias("v"), F.col("hemi_w").alias("hemi"), F.col("label").alias("l")).distinct()
    return filters.same_side_cells(both, "hemi", "l", 9).select("sub", "v", "hemi", F.col("l").cast("long").alias("l"))


@query
def neighbour_filter(spark, folder):
    m = mesh_table(spark, folder)
    return filters.drop_vertices_from_edges(grid_edges(m), m.filter("mars = 2"), ["sub"], "v").select("sub", "new_src", "new_dst")


@query
def active_edges(spark, folder):
    m = mesh_table(spark, folder)
    cells = m.select("sub", "v", (F.col("label") % 4).alias("lam"))
    return filters.active_edges(grid_edges(m), cells, ["sub"], "v", "lam").select("sub", "src", "dst")


def _prior_and_mask(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = m.filter("label > 0").select("v", F.col("label").alias("l"))
    n = m.groupBy("v").agg(F.count(F.lit(1)).alias("_n"))
    theta = own.groupBy("v", "l").agg(F.count(F.lit(1)).alias("_c")).join(n, "v").select("v", "l", (F.col("_c") / F.col("_n")).alias("theta"))
    e = grid_edges(m).select("sub", "src", F.col("dst").alias("v"))
    near = e.join(m.filter("label > 0").select("sub", F.col("v").alias("src"), F.col("label").alias("l")), ["sub", "src"]).select("v", "l")
    return theta, own.unionByName(near).distinct()


@query
def candidate_cells(spark, folder):
    theta, mask = _prior_and_mask(mesh_table(spark, folder))
    return rounded(filters.candidate_cells(theta, mask, ["v", "l"]).select("v", "l", "theta"), "theta")


@query
def scatter_cells(spark, folder):
    theta, mask = _prior_and_mask(mesh_table(spark, folder))
    return rounded(filters.densify(theta, mask, ["v", "l"], "theta"), "theta")


@query
def boundary_mask(spark, folder):
    _, mask = _prior_and_mask(mesh_table(spark, folder))
    half = MESH_SIZE // 2
    lh = mask.filter(F.col("v") < half)
    rh = mask.filter(F.col("v") >= half).select((F.col("v") - half).alias("v"), "l")
    return filters.block_diagonal_mask(lh, rh, "v", "l", half, 9).select("hemi", "v", F.col("l").cast("bigint").alias("l"))


@query
def random_subset(spark, folder):
    d = filters.random_subset(mesh_table(spark, folder), ["sub"], "v", 12.0, 7)
    return d.select("sub", "v", F.col("draw").cast("bigint").alias("draw"))


# ---- meshes and graphs ------------------------------------------------------------


def _face_edges(m: DataFrame, f: DataFrame) -> DataFrame:
    return mesh.with_length(mesh.edges_from_faces(f, ["sub"]), m, ["sub"])


@query
def edge_table(spark, folder):
    return rounded(grid_edges(mesh_table(spark, folder)).select("sub", "src", "dst", "w"), "w")


@query
def face_edges(spark, folder):
    m = mesh_table(spark, folder)
    return rounded(_face_edges(m, grid_faces(m)).select("sub", "src", "dst", "w"), "w")


@query
def vertex_face_counts(spark, folder):
    return mesh.vertex_faces(grid_faces(mesh_table(spark, folder)), ["sub"]).groupBy("sub", "v").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("first_face"))


@query
def vertex_geometry(spark, folder):
    m = mesh_table(spark, folder)
    return rounded(mesh.normals_and_areas(grid_faces(m), m, ["sub"]), "nx", "ny", "nz", "area")


@query
def unfolded_edges(spark, folder):
    m = mesh_table(spark, folder)
    return rounded(mesh.unfolded_edges(grid_faces(m), m, ["sub"]), "w")


@query
def khop_neighbours(spark, folder):
    return mesh.khop(grid_edges(mesh_table(spark, folder)), ["sub"], 3)


@query
def padded_neighbours(spark, folder):
    m = mesh_table(spark, folder)
    slot = [F.when(F.col("gc") < 24, F.col("v") + 2), F.when(F.col("gc") > 0, F.col("v")), F.when(F.col("gr") > 0, F.col("v") - 24)]
    padded = m.withColumn("nb", F.array(*[F.coalesce(s.cast("double"), F.lit(p)) for s, p in zip(slot, (0.0, float("nan"), 0.0))]))
    return mesh.unpad_neighbours(padded, ["sub"], "v", "nb")


@query
def local_minima(spark, folder):
    m = mesh_table(spark, folder)
    near = mesh.khop(grid_edges(m), ["sub"], 2)
    return graph.local_minima(m.select("sub", "v", "z"), near, ["sub"], "z").select("sub", "v", F.col("is_min").cast("int").alias("is_min"))


@query
def potts_term(spark, folder):
    out = graph.potts(_soft(spark, folder), grid_edges(mesh_table(spark, folder)), ["sub"])
    return rounded(out.select("sub", "v", "l", "v_potts"), "v_potts")


def _pieces(m: DataFrame) -> DataFrame:
    """Three coarse parcels, so that pieces of several sizes exist."""
    return m.withColumn("label", F.when(F.col("label") == 0, 0).otherwise(F.col("label") % 3 + 1))


@query
def components(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    return graph.components(m, grid_edges(m), ["sub"])


@query
def component_counts(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    c = graph.components(m, grid_edges(m), ["sub"])
    return graph.component_counts(c, ["sub"])


@query
def component_sizes(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    return graph.component_sizes(graph.components(m, grid_edges(m), ["sub"]), ["sub"])


@query
def boundary_vertices(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    return graph.boundary_vertices(m, grid_edges(m), ["sub"], fake=7).select("sub", "v", "label")


@query
def component_distance(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    e = grid_edges(m)
    c = graph.components(m, e, ["sub"])
    return rounded(con.component_distance(m, e, c, ["sub"], 3, 15.0), "distance")


@query
def remove_isolated(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    return graph.remove_isolated(m.select("sub", "v", "label"), grid_edges(m), ["sub"], 3)


@query
def connectedness(spark, folder):
    m = _pieces(mesh_table(spark, folder))
    gamma = m.filter("label > 0").select("sub", "label").distinct().withColumn("gamma", F.lit(0.0))
    out = con.connectedness(m, grid_edges(m), gamma, ["sub"], 3, 15.0, 12, 15.0)
    return rounded(out.select("sub", "label", "gamma", "n_comp", "distance"), "gamma", "distance")


RADIUS = 30.0


@query
def bounded_reach(spark, folder):
    m = mesh_table(spark, folder)
    seeds = m.filter("label > 0").select("sub", F.col("label").alias("l"), "v", F.lit(0.0).alias("d"))
    return rounded(graph.reach(seeds, grid_edges(m), ["sub", "l"], RADIUS), "d")


@query
def radius_mask(spark, folder):
    m = mesh_table(spark, folder)
    return graph.radius_mask(m, grid_edges(m), ["sub"], RADIUS).select("sub", "v", "l")


@query
def central_distance(spark, folder):
    m = mesh_table(spark, folder)
    src = m.filter("label in (1, 2)").withColumn("side", F.when(F.col("label") == 1, "pre").otherwise("post")).select("sub", "side", "v")
    out = graph.source_set_distance(src, grid_edges(m), m.filter("label > 0"), ["sub"], "side", "label")
    return rounded(out, "mean_distance")


def _cost_surface(m: DataFrame) -> DataFrame:
    return m.select("sub", "v", (F.abs("z") + 0.1).alias("g"))


@query
def geodesic_distance(spark, folder):
    m = mesh_table(spark, folder)
    d = graph.geodesic_distances(_cost_surface(m), grid_edges(m), ["sub"], "g")
    return rounded(d.select("sub", "src", F.posexplode("dist").alias("pos", "distance")), "distance")


@query
def diffusion_embedding(spark, folder):
    m = mesh_table(spark, folder)
    d = graph.geodesic_distances(_cost_surface(m), grid_edges(m), ["sub"], "g")
    emb = diffusion_map(d, ["sub"], 100)
    return emb.select("sub", "v", F.posexplode("emb").alias("pos", "coordinate")).withColumn("coordinate", F.round("coordinate", 3))


SIGMA = 5.0


@query
def smoothing_weights(spark, folder):
    m = mesh_table(spark, folder).withColumn("roi", F.col("mars") == 2)
    f = grid_faces(m)
    return rounded(surface.smoothing_weights(m, _face_edges(m, f), f, ["sub"], SIGMA, "roi"), "w")


@query
def gauss_smooth(spark, folder):
    m = mesh_table(spark, folder).withColumn("roi", F.col("mars") == 2)
    f = grid_faces(m)
    w = surface.smoothing_weights(m, _face_edges(m, f), f, ["sub"], SIGMA, "roi")
    columns = m.select("sub", "v", F.posexplode("emb").alias("k", "value"))
    return rounded(surface.smooth(columns, w, ["sub", "k"], "value"), "value")


@query
def surface_gradient(spark, folder):
    m = mesh_table(spark, folder).withColumn("roi", F.col("mars") == 2)
    f = grid_faces(m)
    vals = m.select("sub", "v", F.posexplode("emb").alias("k", "value"))
    return rounded(surface.gradient_magnitude(vals, m, _face_edges(m, f), f, ["sub"], "value", "roi", ["k"]), "gradient")


@query
def watershed_labels(spark, folder):
    m = mesh_table(spark, folder)
    e = grid_edges(m)
    cols = m.select("sub", "v", F.posexplode("emb").alias("k", "value"))
    near = mesh.khop(e, ["sub"], 2)
    flagged = graph.local_minima(cols, near, ["sub", "k"], "value")
    return surface.watershed(flagged, e, ["sub"], "k", "value")


@query
def edge_density(spark, folder):
    m = mesh_table(spark, folder)
    rows = m.select("v", "label")
    return rounded(agg.edge_density(rows, ["v"], "label"), "density")


@query
def sphere_interpolation(spark, folder):
    e = table(spark, folder, "embeddings")
    p = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 3), lambda x: x)
    u = unit(p)
    t = e.select(F.lit("ico").alias("mesh"), "vec_id", *[(u[i] * 100.0).alias(c) for i, c in enumerate("xyz")])
    v, f = mesh.icosphere(spark, 642)
    v = v.withColumn("mesh", F.lit("ico")).withColumn("height", F.col("z"))
    out = surface.interpolate(t, v, f.withColumn("mesh", F.lit("ico")), ["mesh"], "vec_id", ["height"], 14.0)
    return rounded(out.select("vec_id", "height"), "height")


# ---- parcels and regions -----------------------------------------------------------


@query
def conditional_mean(spark, folder):
    return rounded(agg.conditional_mean(table(spark, folder, "events").withColumn("value", F.col("value") - 5.0), ["user_id", "event_type"], "value"), "mean")


@query
def mode_smallest(spark, folder):
    d = table(spark, folder, "lineitem").withColumn("qty", F.col("l_quantity").cast("int"))
    return ranking.mode_smallest(d, ["l_suppkey"], "qty")


@query
def label_overlap(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return rounded(agg.overlap(d, ["quality"], "lang"), "share")


def _regions(m: DataFrame) -> DataFrame:
    """Stand-in anatomy: the code of the row band and column band a vertex lies in."""
    codes = F.array(*[F.lit(c) for c in (18, 23, 25, 36, 19, 30, 4, 29, 32, 11)])
    return m.withColumn("region", F.get(codes, F.floor((F.col("gr") + F.col("gc")) / 4).cast("int")))


@query
def region_profile(spark, folder):
    out = con.region_profile(_regions(mesh_table(spark, folder)), ["sub"], "label", "region")
    return rounded(out.select("sub", "label", F.posexplode("central").alias("pos", "share")), "share")


@query
def truncate_mask(spark, folder):
    m = _regions(_bands(mesh_table(spark, folder)))
    prof = con.region_profile(m, ["sub"], "label", "region")
    dist = m.filter("label > 0").groupBy("sub", "label").agg(F.avg("x").alias("pre"), F.avg(F.lit(90.0)).alias("post"))
    mask = m.filter("label > 0").select("sub", "v", F.col("label").alias("l")).unionByName(
        grid_edges(m).select("sub", F.col("src").alias("v"), "dst").join(m.filter("label > 0").select("sub", F.col("v").alias("dst"), F.col("label").alias("l")), ["sub", "dst"]).select("sub", "v", "l")
    ).distinct()
    return con.truncate_mask(mask, m, prof, dist, ["sub"], "label", "region")


def _bands(m: DataFrame) -> DataFrame:
    """Parcels as diagonal bands, so that some are dominated by one region."""
    return m.withColumn("label", F.when(F.col("label") == 0, 0).otherwise((F.floor((F.col("gr") + F.col("gc")) / 4) + 1).cast("int")))


# ---- ledgers and manifests -------------------------------------------------------


@query
def cohort_merge(spark, folder):
    c = table(spark, folder, "customer")
    art = lambda cond, tag: F.when(cond, F.concat(F.lit(tag), F.col("c_custkey").cast("string")))
    old = c.filter(F.col("c_custkey") % 5 != 0).select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("run_id"), art(F.col("c_acctbal") > 0, "old-p").alias("profile"), art(F.col("c_acctbal") > 3000, "old-g").alias("gradient")
    )
    new = c.filter(F.col("c_custkey") % 7 != 0).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", -1).otherwise(F.col("c_nationkey")).alias("run_id"),
        art(F.col("c_acctbal") > 6000, "new-p").alias("profile"), art(F.col("c_acctbal") < 1000, "new-g").alias("gradient"),
    )
    return ledger.merge_subjects(new, old, ["profile", "gradient"])


@query
def cohort_run_id(spark, folder):
    return ledger.run_ids(table(spark, folder, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber", "target", "seed", 100)


@query
def manifest_explode(spark, folder):
    conv = table(spark, folder, "conversations")
    nested = ledger.nest_manifest(conv.select(F.col("conv_id").alias("sub"), F.col("turn").alias("sess"), F.col("role").alias("lh"), F.length("text").cast("string").alias("rh")))
    return ledger.flatten_manifest(nested).select("sub", "sess", "lh", "rh")


@query
def manifest_checks(spark, folder):
    conv = table(spark, folder, "conversations")
    flat = conv.select(F.col("conv_id").alias("sub"), (F.col("turn") + 1).alias("sess"), F.concat("role", F.lit(".func.GII ")).alias("lh"), F.lit("x.txt").alias("rh"))
    return ledger.manifest_defects(flat)


@query
def cost_lag(spark, folder):
    e = table(spark, folder, "events").groupBy("event_type", F.dayofmonth("ts").alias("iteration")).agg(F.sum("value").alias("cost"))
    r = ranking.relative_change(e, ["event_type"], "iteration", "cost", 0.05)
    fin = F.when((F.col("ratio") == float("inf")) | F.isnan("ratio"), -1.0).otherwise(F.col("ratio"))
    return rounded(r.select("event_type", "iteration", "cost", "previous", fin.alias("ratio"), F.col("converged").cast("int").alias("converged")), "cost", "previous", "ratio")


@query
def artifact_names(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select("s_suppkey", ledger.parcellation_name(F.col("s_suppkey"), F.col("s_nationkey") / 2.0, F.lit(10.0), F.col("s_nationkey") * 1.0).alias("name"))


# ---- training and parcellation -----------------------------------------------------


def _cohort(spark, folder):
    m = mesh_table(spark, folder)
    theta, mask = _prior_and_mask(m)
    cent = agg.gather_vectors(agg.parcel_centroids(m, "label", "emb"), ["label"], "mtc", "mtc").withColumnRenamed("label", "l")
    return m, theta, mask, cent


@query
def group_prior_training(spark, folder):
    m, _, mask, cent = _cohort(spark, folder)
    t = group_prior.Training(sessions=2, n_subjects=_n_subjects(spark, folder))
    got = group_prior.train(profile(m, 2), mask, cent, t, DIM - 1)
    return got["theta"].withColumn("theta", F.round("theta", 4))


def _parcellate(spark, folder, variant):
    m, theta, _, cent = _cohort(spark, folder)
    s = parcellation.Settings(sessions=2, n_labels=9, n_vertices=MESH_SIZE, w=1.0, c=0.5, beta=0.001)
    parcel = cent.select("l", F.col("mtc").alias("mu"), F.lit(60.0).alias("sigma"), F.lit(60.0).alias("eps"))
    grad = m.select("sub", "v", F.col("emb").alias("grad"))
    return parcellation.parcellate(profile(m, 2), theta, parcel, m, grid_edges(m), variant, s, DIM - 1, grad)["labels"]


@query
def parcellation_distributed(spark, folder):
    return _parcellate(spark, folder, "distributed")


@query
def parcellation_contiguous(spark, folder):
    return _parcellate(spark, folder, "contiguous")


@query
def parcellation_gradient(spark, folder):
    return _parcellate(spark, folder, "gradient")
