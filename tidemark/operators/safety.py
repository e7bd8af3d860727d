"""Safety of generative edits: ordered reasons, tainted sentences, agreement of predictions with words, closed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators import spans
from tidemark.operators.candidates import deterministic

#: Reasons that show that a model lost the structure of a sentence; its other edits there are not trusted either.
STRUCTURAL = ("digits", "acronym", "quotes", "delimiters", "words", "repetition")


def family(category: Column) -> Column:
    """The model family of a category, the first that matches."""
    out = F.regexp_extract(category, "^[a-z]+", 0)
    for f in ("gec", "sage", "draft"):
        out = F.when(F.contains(category, F.lit(f)), F.lit(f)).otherwise(out)
    return out


def reason(before: Column, after: Column, category: Column, solo: Column) -> Column:
    """The first safety reason against a generative edit, in fixed order; null if there is none or the edit is deterministic."""
    joined = lambda f, c: F.concat_ws("|", f(c))
    n = lambda c: F.size(T.skeleton(c))
    words = T.skeleton(after)
    twice = F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: (F.size(words) > 1) & (F.try_element_at(words, i) == F.try_element_at(words, i + 1)))
    out = F.when(joined(T.numbers, before) != joined(T.numbers, after), "digits")
    out = out.when(joined(T.acronyms, before) != joined(T.acronyms, after), "acronym")
    out = out.when(T.quotes(before) != T.quotes(after), "quotes")
    out = out.when(F.regexp_replace(T.delimiters(before), "[,.]", "") != F.regexp_replace(T.delimiters(after), "[,.]", ""), "delimiters")
    out = out.when(n(before) != n(after), "words")
    out = out.when(twice, "repetition")
    out = out.when(solo & F.contains(category, F.lit("draft")), "solo draft")
    return F.when(~deterministic(category), out)


def untainted(edits: DataFrame, sentences: DataFrame) -> DataFrame:
    """edits (doc_id, seq, s, e, category, reason), sentences (doc_id, s, e) -> accepted edits.

    An edit without a reason falls if it lies in a sentence where an edit of the same family was rejected for a structural
    reason. Two passes of span joins, no recursion.
    """
    x = edits.withColumn("family", family(F.col("category")))
    bad = x.filter(F.col("reason").isin(*STRUCTURAL)).select("doc_id", F.col("s").alias("p"), "family")
    tainted = spans.inside(bad, sentences.select("doc_id", "s", "e")).select("doc_id", "r_s", "r_e", "family").distinct()
    ok = x.filter("reason is null")
    hit = spans.inside(ok.select("doc_id", "seq", F.col("s").alias("p"), "family"), tainted.select("doc_id", F.col("r_s").alias("s"), F.col("r_e").alias("e"), "family"))
    gone = hit.filter("family = r_family").select("doc_id", "seq").distinct()
    return ok.join(gone, ["doc_id", "seq"], "left_anti").drop("family")


def word_labels(words: DataFrame, predictions: DataFrame) -> DataFrame:
    """words (doc_id, idx, s, e), predictions (doc_id, s, e, label, score) -> (doc_id, idx, label, score).

    A word takes the prediction over it that ends last; a document with an uncovered word has none at all.
    """
    j = spans.overlapping(words, predictions)
    best = j.groupBy("doc_id", "idx").agg(F.max_by(F.struct(F.col("r_label").alias("label"), F.col("r_score").alias("score")), F.struct("r_e", "r_score", "r_label")).alias("b"))
    n = words.groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = best.groupBy("doc_id").agg(F.count("*").alias("m")).join(n, "doc_id").filter("m = n").select("doc_id")
    return best.join(whole, "doc_id", "left_semi").select("doc_id", "idx", "b.label", "b.score")


def comma_edits(words: DataFrame, labels: DataFrame, add: float = 0.88, remove: float = 0.96) -> DataFrame:
    """words (doc_id, idx, s, e, word, has_comma), labels (doc_id, idx, label, score) -> comma candidates (doc_id, s, before, after)."""
    j = words.join(labels, ["doc_id", "idx"])
    plus = ~F.col("has_comma") & (F.col("label") == "COMMA") & (F.col("score") >= add)
    minus = F.col("has_comma") & (F.col("label") == "O") & (F.col("score") >= remove)
    return j.filter(plus | minus).select("doc_id", "s", F.when(plus, F.col("word")).otherwise(F.concat("word", F.lit(","))).alias("before"), F.when(plus, F.concat("word", F.lit(","))).otherwise(F.col("word")).alias("after"))


def by_start(edits: DataFrame) -> DataFrame:
    """Edits (doc_id, s, e, ...) in order of start, each that overlaps an accepted one before it left out. A fold over the edits of a
    document."""
    cols = [c for c in edits.columns if c not in ("doc_id", "s", "e")]
    key = F.struct("s", "e", *cols)
    arr = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("x"))
    empty = F.filter("x", lambda v: F.lit(False))
    safe = F.aggregate("x", empty, lambda a, v: F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["e"] <= v["s"], F.lit(True)), F.concat(a, F.array(v))).otherwise(a))
    return arr.select("doc_id", F.explode(safe).alias("v")).select("doc_id", "v.*")


# Closed frames of official prose: pattern, replacement.
FRAMES = (
    (r"(?iu)\bсогласно ([а-яё]+)ого (приказа|регламента|графика)\b", "согласно $1ому $2"),
    (r"(?iu)\bв течении (\d+|[а-яё]+) (дней|часов|месяцев)\b", "в течение $1 $2"),
    (r"(?iu)\bпо окончанию\b", "по окончании"),
    (r"(?iu)\bпо прибытию\b", "по прибытии"),
    (r"(?iu)\bв следствии\b", "вследствие"),
    (r"(?iu)\bв соответствие с\b", "в соответствии с"),
)


def frames(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, frame, hits, fixed): texts that a closed frame changes."""
    out = None
    for i, (pattern, new) in enumerate(FRAMES):
        got = texts.filter(F.col("text").rlike(pattern)).select("doc_id", F.lit(i).alias("frame"), F.regexp_count("text", F.lit(pattern)).alias("hits"), F.regexp_replace("text", pattern, new).alias("fixed"))
        out = got if out is None else out.unionByName(got)
    return out


def year_phrases(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, year): four-digit years 1900..2100 before the word for a year, in any case form."""
    years = F.regexp_extract_all("text", F.lit(r"(?iu)(?:^|[^\p{L}\p{N}_])(19\d\d|20\d\d|2100)\s+(?:год(?:а|у|ом|е)?|г\.)"), F.lit(1))
    return texts.select("doc_id", F.explode(years).alias("year")).select("doc_id", F.col("year").cast("int").alias("year"))


def neighbours(texts: DataFrame, n: int = 2) -> DataFrame:
    """(doc_id, idx, word, prev1..prevn, next1..nextn): words with their neighbours, by one window."""
    t = texts.select("doc_id", F.posexplode(T.skeleton(F.col("text"))).alias("idx", "word"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    return t.select("*", *(F.lag("word", k).over(w).alias(f"prev{k}") for k in range(1, n + 1)), *(F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, n + 1)))
