"""Contiguous shards of near equal bytes from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.llm.common import table
from surfparc.session import cut

SHARDS = 16


def shard_by_bytes(rows: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """Cut ``rows``, ordered by ``order``, into contiguous shards of near equal total ``size``.

    Adds ``shard`` (from 0) and ``slot`` (gapless from 0 within a shard). Rows are
    range-partitioned once and written; each partition's total gives the bytes
    before it, a running sum inside the partition gives the bytes before a row,
    and a row goes to the shard in which its middle byte falls. So a cut is off
    by half of one row at most, and no task sees more than one partition.

    ``size`` must be positive. Null or equal order values sort in any stable
    place; repeated rows each get a slot. An empty table gives no rows. Other
    columns pass through; only ``shard``, ``slot`` and names that begin with
    ``__`` are taken. Pass slim rows (ids and sizes): texts need not be moved.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in order]
    laid = cut(rows.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    totals = laid.groupBy("__part").agg(F.sum(size).alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__b0"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__r0"),
        F.sum("__bytes").over(W.partitionBy()).alias("__all"),
    )
    within = W.partitionBy("__part").orderBy(*keys)
    placed = (
        laid.withColumn("__end", F.sum(size).over(within.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__nth", F.row_number().over(within))
        .join(offsets, "__part")
        .withColumn("__mid", 2 * (F.col("__b0") + F.col("__end")) - F.col(size))
        .withColumn("shard", F.floor(F.col("__mid") * F.lit(shards) / (2 * F.col("__all"))).cast("int"))
        .withColumn("shard", F.least(F.col("shard"), F.lit(shards - 1)))
        .withColumn("__rank", F.col("__r0") + F.col("__nth") - 1)
    )
    placed = cut(placed.drop("__end", "__nth", "__b0", "__r0", "__all", "__mid", "__part"))
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by bytes, in the order of doc_id."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard_by_bytes(slim, "size", ["doc_id", "text_crc32", "size"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
