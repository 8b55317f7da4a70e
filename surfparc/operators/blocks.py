"""Bounded blocks: split every key's rows into pieces of a fixed size.

Dense array work (matrix products, shortest paths over a mesh) runs on blocks
inside tasks. A key that holds most of the data simply owns more blocks, so no
task ever receives a whole key. The model side of a product (seeds, centroids,
mesh edges) is replicated once per block and meets it in a cogroup.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, keys: Sequence[str], row_id: str, rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """Add ``block`` to every row; also return ``keys, n_blocks``."""
    n_blocks = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("int").alias("n_blocks"))
    placed = (
        df.join(n_blocks, list(keys))
        .withColumn("block", F.pmod(F.xxhash64(row_id), F.col("n_blocks")).cast("int"))
        .drop("n_blocks")
    )
    return placed, n_blocks


def replicate(model: DataFrame, n_blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy each model row once per block of its key (a subject, or a shared mesh's name)."""
    on = [k for k in keys if k in model.columns]
    if not on:
        raise ValueError(f"the model side shares none of the keys {list(keys)}")
    return model.join(n_blocks, on).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under fresh identities, so both sides of a cogroup may share ancestors."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def block_apply(
    df: DataFrame,
    model: DataFrame,
    keys: Sequence[str],
    row_id: str,
    fn: Callable,
    schema: str,
    rows_per_block: int = 4096,
) -> DataFrame:
    """Run ``fn(rows, model_rows)`` on every block of ``df`` with its key's model."""
    placed, n_blocks = with_blocks(df, keys, row_id, rows_per_block)
    copies = renewed(replicate(model, n_blocks, keys))
    by = [*keys, "block"]
    return placed.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(fn, schema)
