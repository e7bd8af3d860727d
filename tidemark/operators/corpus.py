"""Corpus preparation: exact de-duplication, first-come balance, selection filters, repeated phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows from which on a class of equal texts is joined by broadcast; there are at most rows / HOT such classes.
HOT = 5_000_000


def exact_duplicates(rows: DataFrame, key: str, text: str, hot: int = HOT) -> DataFrame:
    """(key, first, copies): each row with the least key of its class of equal texts and the size of the class. Null counts as ''.

    Classes are found by hash with a partial aggregation; texts never leave the scan. Rows of huge classes (empty texts, say)
    never meet in one task: those few classes go to the rows.
    """
    h = rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))
    cls = h.groupBy("h").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    large = F.broadcast(cls.filter(F.col("copies") >= hot))
    small = h.join(large.select("h"), "h", "left_anti").join(cls.filter(F.col("copies") < hot), "h")
    return h.join(large, "h").unionByName(small).select(key, "first", "copies")


def new_only(rows: DataFrame, known: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose text is not known yet, the first of equal ones by order."""
    h = F.sha2(text, 256)
    fresh = rows.withColumn("_h", h).join(known.select(h.alias("_h")).distinct(), "_h", "left_anti")
    first = fresh.groupBy("_h").agg(F.min(order).alias(order))
    return fresh.join(first, ["_h", order], "left_semi").drop("_h")


def balanced(rows: DataFrame, category: str, order: str, most: int) -> DataFrame:
    """The first so many rows of each category; Spark limits the groups in each task before it shuffles them."""
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def select_pairs(rows: DataFrame, text: Column, least: int, most: int, stop: str) -> DataFrame:
    """Rows by length and without stop phrases; both conditions reach the scan."""
    return rows.filter(F.length(text).between(least, most) & ~F.lower(text).rlike(stop))


def repeated_ngrams(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, repeats): places where n words stand twice in a row, with at least one word of four letters.

    Inside one array: no shuffle.
    """
    from tidemark.functions.text import words

    w = texts.select("doc_id", words(F.col("text")).alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - (2 * n - 1))
    twice = F.filter(at, lambda i: (F.slice(F.col("w"), i, n) == F.slice(F.col("w"), i + n, n)) & F.exists(F.slice(F.col("w"), i, n), lambda x: F.length(x) >= 4))
    return w.select("doc_id", F.when(F.size("w") >= 2 * n, F.size(twice)).otherwise(0).alias("repeats"))


def unambiguous(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max")).filter(F.col(value) == F.col("_max")).drop("_max")
