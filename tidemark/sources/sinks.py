"""Sinks: JSON lines, reports, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def report(df: DataFrame, path: str) -> None:
    """A report as JSON and as tab-separated values."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = df.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/tsv")


class VersionedTable:
    """A Parquet table whose versions are folders and whose current version is named by a pointer file.

    A new version is written aside and becomes current by one rename, so that readers see the old or the new table and a lost
    job leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        marks = self._fs.globStatus(self._path(f"{self.path}/CURRENT-*"))
        names = sorted(m.getPath().getName() for m in marks or ())
        return names[-1].split("-", 2)[2] if names else None

    def read(self) -> DataFrame:
        v = self.current()
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def replace(self, df: DataFrame) -> str:
        marks = self._fs.globStatus(self._path(f"{self.path}/CURRENT-*"))
        n = max((int(m.getPath().getName().split("-")[1]) for m in marks or ()), default=0) + 1
        v = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{v}")
        self._fs.create(self._path(f"{self.path}/CURRENT-{n:012d}-{v}"), False).close()
        return v
