"""Government: words that demand a case of the noun that follows, as rows, joined to the readings of neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lexicon as lx

# What governs which case and number (None: as the noun has it), by rule.
RULES = (
    ("quantifier", "несколько", "gent", "plur"), ("quantifier", "нескольких", "gent", "plur"), ("quantifier", "много", "gent", "plur"), ("quantifier", "пять", "gent", "plur"), ("quantifier", "шесть", "gent", "plur"),
    ("dative", "благодаря", "datv", None), ("dative", "согласно", "datv", None), ("dative", "вопреки", "datv", None),
    ("genitive", "после", "gent", None), ("genitive", "без", "gent", None), ("genitive", "кроме", "gent", None), ("genitive", "вместо", "gent", None), ("genitive", "около", "gent", None), ("genitive", "из", "gent", None), ("genitive", "до", "gent", None), ("genitive", "от", "gent", None),
    ("process", "при", "loct", None), ("locative", "о", "loct", None), ("locative", "об", "loct", None),
    ("instrumental", "между", "ablt", None), ("instrumental", "перед", "ablt", None), ("instrumental", "над", "ablt", None),
    ("dative-k", "к", "datv", None), ("dative-k", "ко", "datv", None), ("po", "по", "datv", None),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, governor string, want_case string, want_number string")


def governed(texts: DataFrame, lexicon: DataFrame, table: DataFrame) -> DataFrame:
    """texts (doc_id, text), table (rule, governor, want_case, want_number) -> (doc_id, idx, rule, before, after).

    A noun directly behind a governor that no reading of it allows, with the one form of its lexeme that does: in the number
    wanted, else in that of its readings. Nothing where several forms would do. Governors, nouns and forms meet by equi-joins;
    rules are few and broadcast by their size; what fits is decided once for each distinct pair of governor and noun.
    """
    pairs = lx.adjacent(texts)
    nouns = lexicon.filter("pos = 'NOUN'").select(F.col("form").alias("right"), "lexeme_id", "case", "number").distinct()
    places = pairs.join(table.select(F.col("governor").alias("left"), "rule", "want_case", "want_number"), "left").join(nouns.select("right").distinct(), "right", "left_semi")
    kinds = places.select("left", "right", "rule", "want_case", "want_number").distinct()
    read = kinds.join(nouns, "right")
    fits = (F.col("case") == F.col("want_case")) & (F.col("want_number").isNull() | (F.col("number") == F.col("want_number")))
    wrong = read.groupBy("left", "right", "rule", "want_case", "want_number").agg(F.bool_or(fits).alias("fits")).filter("not fits").drop("fits")
    sources = wrong.join(nouns.drop("case"), "right").withColumn("n", F.coalesce("want_number", "number")).select("left", "right", "rule", "lexeme_id", F.col("want_case").alias("case"), F.col("n").alias("number")).distinct()
    forms = sources.join(nouns.withColumnRenamed("right", "after"), ["lexeme_id", "case", "number"])
    fixed = forms.groupBy("left", "right", "rule").agg(F.countDistinct("after").alias("k"), F.min("after").alias("after")).filter("k = 1")
    return places.join(fixed.drop("k"), ["left", "right", "rule"]).select("doc_id", "idx", "rule", F.col("right").alias("before"), "after")
