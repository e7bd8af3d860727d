"""Spark session for tests, benches and scripts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir. Where none is set, a folder of our own in local mode, as in tests;
    on a cluster an error, as a folder of one machine would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def discard(spark: SparkSession, older_than_hours: float = 24.0) -> list[str]:
    """Removes the tables and files that operators left in the shared folder (prefix tidemark-) so many hours ago; gives their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    least = spark._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3_600_000)
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else ():
        if status.getPath().getName().startswith("tidemark-") and status.getModificationTime() <= least:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    return sorted(gone)
