"""Incremental catalog sync as a stream of folder snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.sources.sinks import VersionedTable

SCHEMA = "doc_id string, file_hash string, status string, version_no long"


def apply_snapshot(found: DataFrame, table: VersionedTable, prune: bool = False) -> DataFrame:
    """Brings the catalog table in step with a snapshot (doc_id, file_hash); returns the summary of operations.

    Unchanged active documents are kept as they are; missing ones become 'missing', or go if prune.
    """
    old = table.read()
    states = catalog.diff(found, old)
    again = catalog.to_process(states).join(found, "doc_id")
    version = old.select("doc_id", F.col("version_no").alias("v"))
    new = again.join(version, "doc_id", "left").select("doc_id", "file_hash", F.lit("active").alias("status"), (F.coalesce("v", F.lit(0)) + 1).alias("version_no"))
    merged = catalog.upsert(old, new)
    gone = states.filter("state = 'missing'").select("doc_id")
    merged = merged.join(gone, "doc_id", "left_anti") if prune else catalog.set_status(merged, gone, "missing").select(*old.columns)
    summary = catalog.summary(states).collect()  # four rows at most
    table.replace(merged)
    return table.spark.createDataFrame(summary, "operation string, documents long") if summary else table.spark.createDataFrame([], "operation string, documents long")


def watch(spark: SparkSession, snapshots: str, table: VersionedTable, checkpoint: str):
    """A stream over snapshot files (JSON lines of doc_id, file_hash, snapshot); each micro-batch applies its last snapshot."""
    stream = spark.readStream.schema("doc_id string, file_hash string, snapshot long").option("maxFilesPerTrigger", 1).json(snapshots)

    def step(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("snapshot")).first()[0]
        if last is not None:
            apply_snapshot(batch.filter(F.col("snapshot") == last).select("doc_id", "file_hash"), table)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
