"""Canonical composition of Unicode text, for which Spark has no function: one narrow Arrow pass."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def composed(df: DataFrame) -> DataFrame:
    """(key, text) -> (key, text) in normal form C; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            if not pc.all(pc.string_is_ascii(text)).as_py():
                text = pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["key", "text"])

    kind = dict(df.dtypes)["key"]
    return df.select("key", "text").mapInArrow(run, f"key {kind}, text string")
