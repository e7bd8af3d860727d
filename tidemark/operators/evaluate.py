"""Evaluation: positional edit sets, precision / recall / F-beta, benchmark roll-up, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edit_rows(pairs: DataFrame) -> DataFrame:
    """pairs (case_id, source, target) -> (case_id, pos, before, after): words that differ, by position.

    Texts with other numbers of words give one edit that spans both, at position -1.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = pairs.select("case_id", split(F.col("source")).alias("a"), split(F.col("target")).alias("b"), "source", "target")
    same = p.filter(F.size("a") == F.size("b")).select("case_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "w"))
    words = same.select("case_id", "pos", F.col("w.a").alias("before"), F.col("w.b").alias("after")).filter("before <> after")
    whole = p.filter((F.size("a") != F.size("b")) & (F.col("source") != F.col("target")))
    return words.unionByName(whole.select("case_id", F.lit(-1).alias("pos"), F.col("source").alias("before"), F.col("target").alias("after")))


def complete(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """pairs (case_id, source, target), listed (case_id, pos, before, after) -> the listed changes and those that the target shows but
    the list lacks: (case_id, pos, before, after, added)."""
    shown = edit_rows(pairs)
    lacking = shown.join(listed.select("case_id", "pos", "before", "after"), ["case_id", "pos", "before", "after"], "left_anti")
    cols = ("case_id", "pos", "before", "after")
    return listed.select(*cols, F.lit(False).alias("added")).unionByName(lacking.select(*cols, F.lit(True).alias("added")))


def punctuation(cases: DataFrame) -> DataFrame:
    """cases (kind, text, expected, produced) -> (kind, cases, touched, exact): by clean and faulty texts, how many had their delimiters
    changed, and how many have the expected ones."""
    from tidemark.functions.text import delimiters

    p, t, e = (delimiters(F.col(c)) for c in ("produced", "text", "expected"))
    kind = F.when(F.col("kind") == "clean", F.lit("clean")).otherwise(F.lit("error"))
    return cases.groupBy(kind.alias("kind")).agg(F.count("*").alias("cases"), F.count_if(p != t).alias("touched"), F.count_if(p == e).alias("exact"))


def _ratio(a: Column, b: Column, empty: float | None) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def quality(cases: DataFrame, beta: float = 0.5) -> DataFrame:
    """cases (case_id, kind, text, expected, produced) -> one row: damage of clean texts, exact hits, P, R, F-beta.

    An edit on a clean text is a false positive. Precision is 1 if nothing was proposed.
    """
    gold = edit_rows(cases.select("case_id", F.col("text").alias("source"), F.coalesce("expected", "text").alias("target")))
    system = edit_rows(cases.select("case_id", F.col("text").alias("source"), F.col("produced").alias("target")))
    key = ["case_id", "pos", "before", "after"]
    both = gold.withColumn("g", F.lit(1)).join(system.withColumn("s", F.lit(1)), key, "full")
    edits = both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("s").isNull()).alias("fn"),
    )
    clean = F.col("kind") == "clean"
    rows = cases.agg(
        F.count_if(clean).alias("clean_total"),
        F.count_if(clean & (F.col("produced") != F.col("text"))).alias("clean_damaged"),
        F.count_if(~clean).alias("error_total"),
        F.count_if(~clean & (F.col("produced") == F.coalesce("expected", "text"))).alias("error_exact"),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    b2 = beta * beta
    f = F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / (b2 * p + r))
    one = rows.withColumn("one", F.lit(1)).join(edits.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    return one.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f_beta": F.round(f, 4)})


def p95(values: Column) -> Column:
    """The value at index max(0, floor(.95 n) - 1) of the sorted values."""
    return F.element_at(F.array_sort(values), F.greatest(F.floor(F.lit(0.95) * F.size(values)).cast("int"), F.lit(1)))


def exact_p95(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The same percentile without gathering a group in one place: distinct values are counted and ranked by running counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    rank = F.greatest(F.floor(F.lit(0.95) * F.col("n")), F.lit(1))
    got = run.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank))
    return got.groupBy(*by).agg(F.max(value).alias("p95"), F.max("n").alias("n")) if by else got.agg(F.max(value).alias("p95"), F.max("n").alias("n"))


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    """rows (passed boolean, latency, ...) -> overall, and by each column alone: cases, passes, rate, mean latency.

    One aggregation over grouping sets; missing groups are 'unspecified', the whole is '*'.
    """
    filled = rows.withColumns({c: F.coalesce(c, F.lit("unspecified")) for c in by})
    sets = [[], *([F.col(c)] for c in by)]
    g = filled.groupingSets(sets, *by).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passes"), F.round(F.avg("latency"), 2).alias("mean_latency")
    )
    return g.select(
        *(F.coalesce(c, F.lit("*")).alias(c) for c in by), "cases", "passes", F.round(F.when(F.col("cases") > 0, F.col("passes") / F.col("cases")), 4).alias("rate"), "mean_latency"
    )


def case_checks(cases: DataFrame) -> DataFrame:
    """Benchmark cases with produced text -> missing and forbidden strings, layout kept, passed."""
    missing = F.size(F.filter(F.coalesce("must_contain", F.array()), lambda m: ~F.contains(F.col("produced"), m)))
    forbidden = F.size(F.filter(F.coalesce("must_not_contain", F.array()), lambda m: F.contains(F.col("produced"), m)))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    c = cases.withColumns({"missing": missing, "forbidden": forbidden, "layout": breaks(F.col("text")) == breaks(F.col("produced"))})
    exact = ~F.coalesce("clean", F.lit(False)) | (F.col("produced") == F.col("text"))
    return c.withColumn("passed", (F.col("missing") == 0) & (F.col("forbidden") == 0) & F.col("layout") & exact)


def corpus_faults(cases: DataFrame) -> DataFrame:
    """Rows of a benchmark corpus that break its constraints: (id, fault). Empty for a sound corpus."""
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id", F.lit("id not unique").alias("fault"))
    blank = cases.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select("id", F.lit("no text").alias("fault"))
    both = cases.filter(F.exists(F.coalesce("must_contain", F.array()), lambda m: F.array_contains(F.coalesce("must_not_contain", F.array()), m))).select("id", F.lit("required and forbidden").alias("fault"))
    return twice.unionByName(blank).unionByName(both)
