"""Extension: access statistics and cache writes from streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS = "slot long, at long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ACCESS).json(path)


def folded(log: DataFrame) -> DataFrame:
    """Last access and number of accesses by slot, as a running aggregate."""
    return log.groupBy("slot").agg(F.max("at").alias("accessed_at"), F.count("*").alias("access_count"))


def windowed(log: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accesses by window of event time; rows later than `late` are dropped by the watermark."""
    timed = log.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "slot").agg(F.count("*").alias("n")).select("window.start", "slot", "n")


def fold_into(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "5 seconds"):
    """Runs apply(batch, batch_id) for each micro-batch of the log; the batch id makes a repeat recognisable."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=trigger)
