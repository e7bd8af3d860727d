"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import checkpoint_dir


def map_rows(df: DataFrame, fn: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Applies a 1 -> N function to each row, Arrow batch by Arrow batch, without pandas.

    ``fn`` is a factory called once per task, so automata and other tables are built (or found in a
    process-wide cache) on the worker. The function it returns takes the columns of ``df`` in order and
    yields output tuples. Narrow: no shuffle, memory is bounded by one batch.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for got in each(*row):
                    rows.append(got)
                    size += 1
                if size >= 4096:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, out)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def map_columns(df: DataFrame, fn: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """As map_rows, but the function takes and returns whole columns (lists), for vectorised kernels."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            cols = each(*(c.to_pylist() for c in batch.columns))
            if len(cols) and len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and Python work is done once, however often it is read.

    Unlike a cache it outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
