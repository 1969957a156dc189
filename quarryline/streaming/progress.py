"""Append-only progress logs: incremental tail, running totals, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tail(events: DataFrame, after: int) -> DataFrame:
    """Events with a larger id, for batch or stream."""
    return events.where(F.col("event_id") > after)


def state(events: DataFrame) -> DataFrame:
    """Last event and number of events of each user."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count(F.lit(1)).alias("n"))


def running(events: DataFrame) -> DataFrame:
    """Running number of events and sum of values of each user."""
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.count(F.lit(1)).over(order).alias("seen"), F.sum("value").over(order).alias("total"))


def follow(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Copy new files of a log to ``target`` once each; a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; as a stream, rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
