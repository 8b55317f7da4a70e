"""Grouped sums, means and costs.

Vector sums explode to ``(key, position, value)`` so that Spark's partial
aggregation collapses them before the shuffle: what travels is one row per key,
position and map task, however many rows a single key owns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfparc.functions.bits import WORD
from surfparc.functions.special import cdln_column
from surfparc.functions.vectors import LOG_FLOOR, as_double, dot, log_or_floor, safe_div


def gather_vectors(long: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``(keys, pos, value)`` rows back to one array per key, ordered by position."""
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_p"))
    return packed.withColumn(out, F.transform("_p", lambda p: p[value])).drop("_p")


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None, out: str = "total") -> DataFrame:
    """Elementwise (weighted) sum per key."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    long = df.select(*keys, w.alias("_w"), F.posexplode(as_double(vector)).alias("pos", "_x"))
    sums = long.groupBy(*keys, "pos").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    return gather_vectors(sums, keys, "_s", out)


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean") -> DataFrame:
    """Elementwise mean per key, e.g. of correlations over the runs of a session."""
    long = df.select(*keys, F.posexplode(as_double(vector)).alias("pos", "_x"))
    return gather_vectors(long.groupBy(*keys, "pos").agg(F.avg("_x").alias("_s")), keys, "_s", out)


def sum_of_few(df: DataFrame, keys: Sequence[str], vector: str, out: str = "total") -> DataFrame:
    """Elementwise sum of a handful of vectors per key, such as the partial sums of a mesh's blocks.

    The vectors travel whole, as in ``mean_of_few``; long keys belong to ``sum_vectors``.
    """
    few = df.groupBy(*keys).agg(F.collect_list(as_double(vector)).alias("_v"))
    return few.select(*keys, _added("_v").alias(out))


def _added(vectors: str) -> Column:
    return F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def mean_of_few(df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean") -> DataFrame:
    """Elementwise mean of a handful of vectors per key, such as the runs of one session.

    The vectors travel whole and are added in place; a key's rows must be few by
    what they are, else ``mean_vectors`` is the way.
    """
    few = df.groupBy(*keys).agg(F.collect_list(as_double(vector)).alias("_v"))
    return few.select(*keys, F.transform(_added("_v"), lambda t: t / F.size("_v")).alias(out))


def bit_sums(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """Exact integer count of set bits per key and bit position.

    One row per word goes in and 64 counters come out of the aggregation, so a
    profile is never expanded to one row per bit before it is reduced.
    """
    counted = (
        df.select(*keys, F.posexplode(words).alias("_w", "_word"))
        .groupBy(*keys, "_w")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.getbit("_word", F.lit(i)).cast("long")).alias(f"_b{i}") for i in range(WORD)])
    )
    spread = counted.select(*keys, "n", "_w", F.posexplode(F.array(*[f"_b{i}" for i in range(WORD)])).alias("_i", "ones"))
    return spread.select(*keys, (F.col("_w") * WORD + F.col("_i")).cast("int").alias("pos"), "ones", "n")


def cohort_mean_profile(df: DataFrame, keys: Sequence[str], words: str, length: int) -> DataFrame:
    """Mean of binary profiles over every subject and session of a vertex."""
    return bit_sums(df, keys, words).filter(F.col("pos") < length).select(*keys, "pos", (F.col("ones") / F.col("n")).alias("mean"))


def merge_mean_state(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add two ``(keys, pos, ones, n)`` accumulators: the mean can grow by session."""
    return old.unionByName(new).groupBy(*keys, "pos").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))


def parcel_centroids(df: DataFrame, label: str, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unit mean direction of each positive label, one row per component."""
    by = [*keys, label]
    sums = (
        df.filter(F.col(label) > 0)
        .select(*by, F.posexplode(as_double(vector)).alias("pos", "_x"))
        .groupBy(*by, "pos")
        .agg(F.sum("_x").alias("_s"))
    )
    length = sums.groupBy(*by).agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_n"))
    return sums.join(length, by).select(*by, "pos", (F.col("_s") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("mtc"))


def own_parcel_cosine(df: DataFrame, centroids: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean dot product of labelled rows with their own parcel's centroid: one row."""
    joined = df.filter(F.col(label) > 0).join(centroids, label)
    return joined.agg(F.avg(dot(as_double(vector), F.col("centroid"))).alias("rbar"), F.count(F.lit(1)).alias("n"))


def conditional_mean(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 1e-10) -> DataFrame:
    """Sum of all values over the count of those above ``threshold``; 0 if none are."""
    a = df.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count_if(F.col(value) > threshold).alias("n_positive"))
    return a.select(*keys, "n_positive", safe_div(F.col("_s"), F.col("n_positive").cast("double")).alias("mean"))


def edge_density(df: DataFrame, keys: Sequence[str], label: str, n_samples: Column | None = None) -> DataFrame:
    """Share of samples in which a vertex stays unlabelled (a watershed edge)."""
    n = F.count(F.lit(1)) if n_samples is None else n_samples
    return df.groupBy(*keys).agg(F.count_if(F.col(label) == 0).alias("n_edge"), n.alias("n_samples")).withColumn(
        "density", F.col("n_edge") / F.col("n_samples")
    )


def mean_resultant(centroids: DataFrame, sums: DataFrame, cells: DataFrame, keys: Sequence[str], n_sessions: int) -> DataFrame:
    """``sum(nu . Xdot) / (T * sum(lambda))`` per key."""
    on = [c for c in ("sub", "t", "l") if c in centroids.columns and c in sums.columns]
    num = centroids.join(sums, on).groupBy(*keys).agg(F.sum(dot(F.col("nu"), F.col("xdot"))).alias("num"))
    den = cells.groupBy(*keys).agg((F.sum("lam") * n_sessions).alias("den"))
    return num.join(den, list(keys)).withColumn("rbar", safe_div(F.col("num"), F.col("den"), None))


def mean_over_subjects(cells: DataFrame, n_subjects: int) -> DataFrame:
    """Group prior: mean posterior over all subjects; absent cells count as zero."""
    return cells.groupBy("v", "l").agg((F.sum("lam") / F.lit(float(n_subjects))).alias("theta"))


def initial_theta(cells: DataFrame, mask: DataFrame, n_subjects: int) -> DataFrame:
    """Mean over subjects, over the number of non-zero subjects, plus machine epsilon."""
    eps = 2.220446049250313e-16
    s = cells.groupBy("v", "l").agg(F.sum("lam").alias("_s"), F.count_if(F.col("lam") != 0).alias("_n"))
    full = mask.select("v", "l").distinct().join(s, ["v", "l"], "left")
    mean = safe_div(F.col("_s") / F.lit(float(n_subjects)), F.col("_n").cast("double"))
    return full.select("v", "l", (mean + eps).alias("theta"))


def group_direction(psi: DataFrame, previous: DataFrame) -> DataFrame:
    """Normalised sum of subject centroids per parcel; a zero sum keeps the old row."""
    total = sum_vectors(psi, ["l"], "psi", out="_s").withColumn("_n", F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x)))
    return previous.join(total, "l", "left").select(
        "l", F.when(F.col("_n") > 0, F.transform("_s", lambda x: x / F.col("_n"))).otherwise(F.col("mu")).alias("mu")
    )


def em_cost(cells: DataFrame, keys: Sequence[str], w: float, c: float) -> DataFrame:
    """Expected complete log likelihood over candidate cells.

    Columns: ``lam, acc, kappa, cdln, t, theta, v_potts, beta, scv``. Non-finite
    spatial terms and logs of zero take the floor; this sum uses ``c * V`` while
    the assignment score uses twice that.
    """
    scv = F.when(F.isnan("scv") | (F.abs("scv") == float("inf")), F.lit(LOG_FLOOR)).otherwise(F.col("scv"))
    body = (
        F.col("t") * F.col("cdln")
        + F.col("kappa") * F.col("acc")
        + log_or_floor(F.col("theta"))
        - w * log_or_floor(F.col("lam"))
        - c * F.col("v_potts")
        + F.col("beta") * scv
    )
    return cells.groupBy(*keys).agg(F.sum(F.col("lam") * body).alias("cost"))


def outer_cost(psi: DataFrame, nu: DataFrame, parcel: DataFrame, dim: int, n_sub: int, n_sessions: int) -> DataFrame:
    """``sigma psi.nu + ST Cdln(sigma) + eps mu.psi + S Cdln(eps)``, summed to one row ``cost``."""
    near = psi.join(nu, ["sub", "l"]).join(parcel, "l").select((F.col("sigma") * dot(F.col("psi"), F.col("nu"))).alias("c"))
    far = psi.join(parcel, "l").select((F.col("eps") * dot(F.col("mu"), F.col("psi"))).alias("c"))
    each = parcel.select((cdln_column(F.col("sigma"), dim) * (n_sub * n_sessions) + cdln_column(F.col("eps"), dim) * n_sub).alias("c"))
    return near.unionByName(far).unionByName(each).agg(F.sum("c").alias("cost"))


def mean_abs_drift(old: DataFrame, new: DataFrame, on: Sequence[str], keys: Sequence[str], n_cells: Column) -> DataFrame:
    """``sum |new - old|`` over the full dense domain size, cells absent on a side being zero."""
    o = old.select(*on, F.col("lam").alias("_o"))
    n = new.select(*on, F.col("lam").alias("_n"))
    gap = F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0)))
    return o.join(n, list(on), "full").groupBy(*keys).agg((F.sum(gap) / n_cells).alias("drift"))


def dead_columns(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Parcels whose every cell is exactly zero, and parcels holding a NaN."""
    return cells.groupBy(*keys).agg(
        F.bool_and(F.col(value) == 0).alias("all_zero"), F.bool_or(F.isnan(value)).alias("any_nan")
    )


def extent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.abs(value)).alias("abs_hi"))


def converged_flags(df: DataFrame, keys: Sequence[str], cosine: str, eps: float, carried: Column | None = None) -> DataFrame:
    """All parcels within ``eps`` of their previous direction, or already flagged."""
    now = F.bool_and(1.0 - F.col(cosine) < eps)
    return df.groupBy(*keys).agg((now if carried is None else (now | F.bool_or(carried))).alias("converged"))


def weighted_means(values: DataFrame, weights: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``sum(w x) / sum(w)`` at every target of a ``(tgt, src, w)`` table."""
    on = [*[k for k in keys if k in weights.columns], "src"]
    x = values.withColumnRenamed("v", "src")
    a = x.join(weights, on).groupBy(*keys, "tgt").agg(F.sum(F.col("w") * F.col(value)).alias("_a"), F.sum("w").alias("_b"))
    return a.select(*keys, F.col("tgt").alias("v"), safe_div(F.col("_a"), F.col("_b")).alias(value))


def overlap(df: DataFrame, keys: Sequence[str], region: str) -> DataFrame:
    """Contingency counts and each region's share of its group.

    Counting comes first, so the share is a window over a handful of rows per
    group and a crowded group costs nothing extra.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(*keys, region).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))
