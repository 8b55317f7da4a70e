"""Incremental cohort mean: sessions arrive, counts accumulate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.operators.aggregates import bit_sums


def stream_profiles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def accumulate(batches: DataFrame, keys: list[str], words: str, state: str, checkpoint: str):
    """Start a query that writes each micro-batch's bit counts under ``state``.

    A batch's counts overwrite their own ``batch`` partition, so a replayed batch
    does not count twice; the mean is read over all partitions at any time.
    """

    def keep(df: DataFrame, epoch: int) -> None:
        sums = bit_sums(df, keys, words)
        sums.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)

    return batches.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_mean(spark: SparkSession, state: str, keys: list[str], length: int) -> DataFrame:
    s = spark.read.parquet(state).groupBy(*keys, "pos").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    return s.filter(F.col("pos") < length).select(*keys, "pos", (F.col("ones") / F.col("n")).alias("mean"))
