"""Incremental feature statistics: each micro-batch adds mergeable moments (count, mean, sum of squared deviations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, m2) of the non-null values."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")).where("n > 0")


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row per key from any number of partial rows: means weigh by count, and their spread joins the squares.

    The spread is summed around the mean of all, known from a window over the key (no further shuffle), so that nothing
    cancels where the mean is large.
    """
    key = Window.partitionBy(*by)
    placed = parts.withColumn("_mean", F.sum(F.col("mean") * F.col("n")).over(key) / F.sum("n").over(key))
    apart = F.col("mean") - F.col("_mean")
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))


def finish_moments(moments: DataFrame) -> DataFrame:
    return moments.withColumn("std", F.sqrt(F.col("m2") / F.col("n")))


def stream_moments(stream: DataFrame, by: list[str], value: str, path: str, checkpoint: str):
    """A query that writes each micro-batch's moments under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch_moments(batch, by, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
