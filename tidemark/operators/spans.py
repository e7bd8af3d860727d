"""Joins over spans of text: overlap, containment, nearest neighbours. Keys are (doc_id, block of offsets): never a pure theta join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256


def _blocked(spans: DataFrame, size: int) -> DataFrame:
    """Each span once for every block of offsets that it touches."""
    last = F.greatest(F.col("e") - 1, F.col("s"))
    return spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor(last / size))))


def overlapping(left: DataFrame, right: DataFrame, size: int = BLOCK) -> DataFrame:
    """left (doc_id, s, e, ...), right (doc_id, s, e, ...) -> pairs that share a character; right columns get the prefix r_.

    An equi-join on (doc_id, block); a pair is kept in the first block both touch, so that it comes once.
    """
    a = _blocked(left, size)
    b = _blocked(right.select([F.col(c).alias(c if c == "doc_id" else f"r_{c}") for c in right.columns]).withColumnsRenamed({"r_s": "s", "r_e": "e"}), size).withColumnsRenamed({"s": "r_s", "e": "r_e"})
    j = a.join(b, ["doc_id", "_b"]).filter((F.col("s") < F.col("r_e")) & (F.col("r_s") < F.col("e")))
    return j.filter(F.col("_b") == F.floor(F.greatest("s", "r_s") / size)).drop("_b")


def without_overlap(left: DataFrame, right: DataFrame, key: list[str], size: int = BLOCK) -> DataFrame:
    """Rows of left that share no character with any span of right."""
    return left.join(overlapping(left.select(*key, "s", "e"), right.select("doc_id", "s", "e"), size).select(*key).distinct(), key, "left_anti")


def inside(points: DataFrame, spans: DataFrame, size: int = BLOCK) -> DataFrame:
    """points (doc_id, p, ...) with the spans (doc_id, s, e, ...) that hold them; span columns get the prefix r_."""
    p = points.withColumn("s", F.col("p")).withColumn("e", F.col("p") + 1)
    return overlapping(p, spans, size).drop("s", "e")


def nearest_left(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (doc_id, p), marks (doc_id, p, value) -> (doc_id, p, value, distance): the last mark before each point.

    One union and one window by document: an as-of lookup without a join.
    """
    u = points.select("doc_id", "p", F.lit(None).cast("string").alias("value"), F.lit(0).alias("is_mark")).unionByName(
        marks.select("doc_id", "p", F.col("value").cast("string").alias("value"), F.lit(1).alias("is_mark"))
    )
    w = Window.partitionBy("doc_id").orderBy("p", "is_mark").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_mark") == 1, F.struct(F.col("value").alias("v"), F.col("p").alias("at"))), ignorenulls=True).over(w)
    got = u.withColumn("m", last).filter("is_mark = 0")
    return got.select("doc_id", "p", F.col("m.v").alias("value"), (F.col("p") - F.col("m.at")).alias("distance"))


def islands(rows: DataFrame, by: str, order: str, breaks: str) -> DataFrame:
    """Numbers runs of rows that no true value of ``breaks`` parts: adds run."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("run", F.sum(F.when(F.col(breaks), 1).otherwise(0)).over(w))
