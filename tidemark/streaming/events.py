"""Event-time windows, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir


def tumbling(events: DataFrame, size: str, *by: str) -> DataFrame:
    """(start, by..., n, total): counts and sums of value by window; the same plan for batch and stream."""
    g = events.groupBy(F.window("ts", size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """(key, first_ts, last_ts, n): runs of events of a key with pauses shorter than the gap."""
    w = F.session_window("ts", gap)
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(w, key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return g.select(key, F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


def watermarked(stream: DataFrame, size: str, delay: str) -> DataFrame:
    """(start, n) of a stream with ts: tumbling counts whose state is bounded by a watermark; events later than ``delay`` are dropped."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def daily_counts(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Daily counts of the files at a path, made by a stream that takes so many of them a trigger and is driven to their end.

    Each micro-batch adds its own partial counts under its number, overwriting them if it is run again, so that the result is
    exactly-once, no event is ever too late and no state is kept; partial counts are summed when they are read.
    """
    base = f"{checkpoint_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    # As a pattern the path may name a folder or one file.
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = source.select("ts").writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.schema("day timestamp_ntz, n long, batch int").parquet(f"{base}/out")
    return parts.groupBy("day").agg(F.sum("n").alias("n"))
