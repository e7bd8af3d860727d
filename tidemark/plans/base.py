"""Registration of queries: a module's QUERIES maps a name to (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry(dict):
    def add(self, sql: str | None = None):
        def keep(f):
            self[f.__name__] = (f, sql)
            return f

        return keep
