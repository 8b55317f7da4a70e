"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# ASCII characters that separate words; every other character belongs to a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Rows of a helper table that may be sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words in order; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if its counted rows stay within the limit."""
    return F.broadcast(table) if table.count() <= limit else table


def same_row(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def masked(docs: DataFrame, key: list[str], *others: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its key columns under names that clash with no other, then ``others``; and those names."""
    names = [f"__key{n}" for n in range(len(key))]
    return docs.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], *others), names


def unmasked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key columns under their own names again."""
    return rows.select(*[F.col(f"__key{n}").alias(k) for n, k in enumerate(key)], *[c for c in rows.columns if not c.startswith("__key")])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
