"""Streams of events and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling bars of a stream of events (ts, event_type, event_id, value), final once the watermark has passed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    k = F.struct("ts", "event_id")
    g = e.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    b = g.agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("count"))
    return b.select("symbol", F.unix_millis("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "count")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def upsert_into(path: str):
    """foreachBatch function that merges a batch of bars into a table by symbol, newest rows first (only the batch's symbols are rewritten)."""
    from ..sources.bars import upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(path).join(batch.select("symbol").distinct(), "symbol", "left_semi")
        except Exception as e:  # noqa: BLE001  the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        staged = f"{path}_staged/{epoch}"
        upsert(old, batch).write.mode("overwrite").parquet(staged)
        spark.read.schema(batch.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)

    return merge
