"""Exact selection, argmax, softmax and iteration history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.session import cut, forget


def top_fraction_threshold(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, settle: int = 65_536, bins: int = 4_096
) -> DataFrame:
    """The value at descending rank ``clamp(floor(n * fraction + 0.5), 1, n)`` per key.

    Exact without sorting a key in one task: while some key still has more than
    ``settle`` values in play, they are counted into bins over the current range
    (pre-aggregated before the shuffle) and the range shrinks to the extremes of
    the bin holding the wanted rank. What is left is ranked by distinct value.
    NaN counts as missing, at every size; a range that a round can't narrow
    (infinite ends, neighbouring doubles) is ranked as it is.
    """
    if not keys:
        grouped = top_fraction_threshold(df.withColumn("_all", F.lit(0)), ["_all"], value, fraction, settle, bins)
        return grouped.drop("_all")
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(~F.isnan("_x"))
    n = F.col("_n")
    state = x.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rank = F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(fraction) + 0.5))).cast("long")
    state = state.withColumn("_k", rank).withColumn("_stuck", F.lit(False))
    unsettled = (F.col("_n") > settle) & (F.col("_hi") > F.col("_lo")) & ~F.col("_stuck")

    spent = None
    while True:
        state = cut(state)
        if spent is not None:
            forget(spent)
        spent = state
        open_keys = state.filter(unsettled)
        if open_keys.isEmpty():
            break
        live = x.join(open_keys.withColumnRenamed("_n", "_was"), keys).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        slot = F.least(F.lit(bins - 1), F.floor(F.when(F.isnan(share), 0.0).otherwise(share) * bins))
        hist = live.groupBy(*keys, "_k", "_was", slot.alias("_b")).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        above = F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_b")))
        hit = hist.withColumn("_a", above).filter((F.col("_a") >= F.col("_k")) & (F.col("_a") - F.col("_n") < F.col("_k")))
        narrowed = hit.select(*keys, "_n", "_lo", "_hi", (F.col("_k") - (F.col("_a") - F.col("_n"))).alias("_k"), (F.col("_n") == F.col("_was")).alias("_stuck"))
        state = state.filter(~unsettled).unionByName(narrowed)

    live = x.join(state, keys).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    tally = live.groupBy(*keys, "_k", "_x").agg(F.count(F.lit(1)).alias("_c"))
    seen = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.desc("_x")))
    return (
        tally.withColumn("_a", seen)
        .filter((F.col("_a") >= F.col("_k")) & (F.col("_a") - F.col("_c") < F.col("_k")))
        .select(*keys, F.col("_x").alias("threshold"))
    )


def argmax_labels(cells: DataFrame, keys: Sequence[str], parcel: str, value: str) -> DataFrame:
    """Largest cell per row, lowest parcel on ties, 0 where the row sums to zero.

    A running maximum of a struct combines before the shuffle; no sort is needed.
    """
    best = F.max(F.struct(F.col(value).alias("p"), (-F.col(parcel)).alias("l")))
    a = cells.groupBy(*keys).agg(best.alias("_b"), F.sum(value).alias("_s"))
    return a.select(*keys, F.when(F.col("_s") != 0, -F.col("_b.l")).otherwise(0).cast("int").alias("label"), F.col("_b.p").alias("best"))


def masked_softmax(cells: DataFrame, keys: Sequence[str], score: str, in_mask: str | None = None, out: str = "lam") -> DataFrame:
    """Softmax over a row's cells; a degenerate row becomes all zeros.

    The shift is the maximum over every cell given, also those the mask drops.
    A row has at most one cell per parcel, so the window stays small.
    """
    row = W.partitionBy(*keys)
    clean = F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    top = F.max(clean).over(row)
    e = F.when(F.col(score) == float("-inf"), 0.0).otherwise(F.exp(F.col(score) - F.col("_top")))
    if in_mask is not None:
        e = F.when(F.col(in_mask), e).otherwise(0.0)
    d = cells.withColumn("_top", top).withColumn("_e", e).withColumn("_s", F.sum("_e").over(row))
    good = (F.col("_s") > 0) & ~F.isnan("_s")
    return d.withColumn(out, F.when(good, F.col("_e") / F.when(good, F.col("_s"))).otherwise(0.0)).drop("_top", "_e", "_s")


def mode_smallest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value, the smallest one on ties; counts combine before the shuffle."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("x")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.x").alias("mode"), (-F.col("_b.n")).alias("n"))


def relative_change(df: DataFrame, keys: Sequence[str], order: str, cost: str, threshold: float = 1e-4) -> DataFrame:
    """Cost history with its lag, relative change and stop flag.

    A zero previous cost gives an infinite ratio (not converged) unless the new
    cost is zero too; that, like any NaN, counts as converged.
    """
    prev = F.lag(cost).over(W.partitionBy(*keys).orderBy(order))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    gap = F.abs((F.col(cost) - F.col("previous")) / F.when(F.col("previous") != 0, F.col("previous")))
    ratio = F.when(F.isnan(cost) | F.isnan("previous"), nan).when(F.col("previous") != 0, gap).when(F.col(cost) == 0, nan).otherwise(inf)
    return (
        df.withColumn("previous", F.coalesce(prev, F.lit(0.0)))
        .withColumn("ratio", ratio)
        .withColumn("converged", F.isnan("ratio") | (F.col("ratio") <= threshold))
    )


def stack_labels(df: DataFrame, hemi: str, label: str, n_left: int, right: str = "rh") -> DataFrame:
    """Labels of both hemispheres in one numbering: the right one's parcels follow the left one's, zero stays zero."""
    return df.withColumn(label, F.when((F.col(hemi) == right) & (F.col(label) > 0), F.col(label) + n_left).otherwise(F.col(label)))


def renumber(df: DataFrame, keys: Sequence[str], label: str, out: str) -> DataFrame:
    """Close gaps in the positive labels; zero stays zero. Ranks distinct labels only."""
    order = W.partitionBy(*keys).orderBy(label)
    ids = df.filter(F.col(label) > 0).select(*keys, label).distinct().withColumn(out, F.row_number().over(order))
    return df.join(ids, [*keys, label], "left").withColumn(out, F.coalesce(out, F.lit(0)))
