"""Audit log: append, windowed statistics, retention, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import prefix


def record(requests: DataFrame, redact: bool = False) -> DataFrame:
    """requests (ts, text, context, error, ...) -> audit rows: lengths, hash, a snippet of 200, errors cut at 500.

    A redacted row keeps the hash and has an empty snippet; the hash of an empty text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    return requests.withColumns(
        {
            "text_len": F.length(text),
            "context_len": F.length(F.coalesce("context", F.lit(""))),
            "text_sha1": F.when(text == "", F.lit("")).otherwise(F.sha1(text)),
            "text_snippet": F.lit("") if redact else F.substring(text, 1, 200),
            "error": F.substring("error", 1, 500),
            "ok": F.col("error").isNull(),
            "date": F.to_date("ts"),
        }
    ).drop("text", "context")


def append(rows: DataFrame, path: str) -> None:
    """Appends to a log partitioned by date; a committed job is atomic."""
    rows.write.mode("append").partitionBy("date").parquet(path)


def window_stats(log: DataFrame, cutoff, *by: str) -> DataFrame:
    """total, ok, failed, mean duration (1 digit), mean changes (2 digits) of rows from the cutoff on."""
    g = log.filter(F.col("ts") >= cutoff).groupBy(*by) if by else log.filter(F.col("ts") >= cutoff).groupBy()
    ok = F.count_if("ok")
    return g.agg(
        F.count("*").alias("total"),
        ok.alias("succeeded"),
        (F.count("*") - ok).alias("failed"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 1).alias("mean_ms"),
        F.round(F.coalesce(F.avg("changes_count"), F.lit(0.0)), 2).alias("mean_changes"),
    )


def retain(log: DataFrame, now, days: int) -> DataFrame:
    """Rows that a retention of so many days keeps; zero and less keep all."""
    return log if days <= 0 else log.filter(F.col("ts") >= now - F.expr(f"interval {int(days)} days"))


def purge(spark, path: str, keep_from: str) -> list[str]:
    """Drops whole date partitions before a date (ISO) and returns them; files of kept partitions are not touched."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < keep_from:
            fs.delete(status.getPath(), True)
            gone.append(name[5:])
    return sorted(gone)


def trailing_mean(log: DataFrame, rows: int, key: str = "server") -> DataFrame:
    """Mean duration over the last so many requests of each server, in order of (ts, id).

    There are few servers, so requests are numbered by two-level running counts over days and averaged in blocks with halos.
    """
    d = log.select("id", key, "ts", "duration_ms")
    n = prefix.running(d, key, F.to_date("ts"), ["ts", "id"], F.lit(1), "n")
    w = Window.partitionBy(key, "_block").orderBy("n").rowsBetween(1 - rows, 0)
    got = prefix.trailing(n, key, "n", rows).withColumn("trailing_ms", F.round(F.avg("duration_ms").over(w), 4))
    return got.filter("_own").select("id", key, "trailing_ms")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
