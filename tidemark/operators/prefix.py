"""Running numbers and sums of groups of any size: two levels, so that no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, key: str, block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the rows of the key that come before, by (block, order).

    block must not decrease along the order. Blocks are summed first (one row a block), their running sums give each block its
    base, and the rest is a window inside a block. A key that holds a third of all rows is spread over its blocks.
    """
    d = df.withColumn("_b", block).withColumn("_v", value)
    sums = d.groupBy(key, "_b").agg(F.sum("_v").alias("_n"))
    base = sums.select(key, "_b", (F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).alias("_base"))
    inside = F.sum("_v").over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    return d.withColumn("_in", inside).join(base, [key, "_b"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_v", "_in", "_base")


def trailing(df: DataFrame, key: str, index: str, rows: int, block: int = 1 << 14) -> DataFrame:
    """df once for each block of ``block`` indexes, with the rows before it that windows of ``rows`` rows reach: adds _block, _own.

    A window over (key, _block) ordered by index then sees all it needs; rows that are not _own are dropped behind it.
    """
    if rows > block:
        raise ValueError("a window may not be longer than a block")
    at = F.floor(F.col(index) / block)
    reach = F.when(F.col(index) % block > block - rows, F.array(at, at + 1)).otherwise(F.array(at))
    return df.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == at)
