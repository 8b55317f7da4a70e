"""Seed correlations and similarity of connectivity profiles, block by block."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfparc.functions.vectors import zscore_unit
from surfparc.operators.blocks import block_apply
from surfparc.session import cut


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in cols)


def seed_correlation(series: DataFrame, seeds: DataFrame, keys: Sequence[str], vertex: str, ts: str) -> DataFrame:
    """Correlate every vertex with every seed of the same key (subject, session, run).

    Both sides are z-scored to unit length by Spark, so a block is one matrix
    product. The seed side is the coarser mesh: its size is fixed by that mesh,
    not by the number of rows, and each block receives one copy. ``corr`` is
    ordered by seed id; a constant series, or one with NaN, correlates as zero.
    """
    keys = list(keys)
    rows = zscore_unit(series.select(*keys, vertex, ts), ts, "z").select(*keys, vertex, "z")
    model = zscore_unit(seeds.select(*keys, F.col(vertex).alias("seed"), ts), ts, "z").select(*keys, "seed", "z")

    def product(block: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(seed):
            return pd.DataFrame(columns=[*keys, vertex, "corr"])
        s = seed.sort_values("seed")
        corr = np.nan_to_num(np.stack(block["z"].to_list()).astype(float) @ np.stack(s["z"].to_list()).astype(float).T, nan=0.0)
        return pd.DataFrame({**{k: block[k].to_numpy() for k in keys}, vertex: block[vertex].to_numpy(), "corr": list(corr)})

    return block_apply(rows, model, keys, vertex, product, _types(series, [*keys, vertex]) + ", corr array<double>")


def profile_similarity(series: DataFrame, references: DataFrame, columns: DataFrame, keys: Sequence[str], vertex: str, ts: str) -> DataFrame:
    """Correlate the connectivity of every vertex with that of selected vertices.

    A vertex's connectivity is its correlation with the reference vertices; the
    similarity of two vertices is the correlation of their connectivity. Both
    selections are the subsampled sets of one scan, so their size is a fixed
    share of one mesh. Undefined correlations become zero.
    """
    keys = list(keys)
    conn = cut(seed_correlation(series, references, keys, vertex, ts))
    chosen = conn.join(columns.select(*keys, vertex).distinct(), [*keys, vertex], "left_semi")
    return seed_correlation(
        conn.withColumnRenamed("corr", "ts_"), chosen.withColumnRenamed("corr", "ts_"), keys, vertex, "ts_"
    ).withColumnRenamed("corr", "similarity")
