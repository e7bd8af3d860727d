"""Guards of generative edits: surface reasons as columns, lexical ones by equi-joins on a table of readings.

Candidates carry doc_id, ord (unique in a document), before, after, category, sources, confidence and start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import lexicon as lx
from tidemark.operators.candidates import GENERATIVE, deterministic, starts_with

# The confidence that doubtful edits of one model keep at most, and the comma phrase that stays closed.
SOLO_CONFIDENCE = 0.49
CLOSED = r"(?iu),\s*(?:учитывая|принимая\s+во\s+внимание)\s*,\s*что(?![\p{L}])"
BEFORE, BEHIND = 20, 80
_ABBREVIATION = r"(?:^|(?<=[^\p{L}\p{N}_]))(?:[а-яё]{1,4}\.|[А-ЯЁ]\.)"


def _all(c: Column, pattern: str) -> Column:
    return F.concat_ws("|", F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{T.LETTER}]+"), F.lit(0))


def surface_reason(before: Column, after: Column) -> Column:
    """'' where nothing but punctuation changed (allowed), a reason, or null where the words have to be looked at."""
    skeleton = lambda c: _all(c, f"[{T.LETTER}]+|[0-9]+")
    return (
        F.when(_all(before, "[0-9]") != _all(after, "[0-9]"), "digits changed")
        .when(skeleton(before) == skeleton(after), "")
        .when((_all(before, _ABBREVIATION) != "") & (_all(before, _ABBREVIATION) != _all(after, _ABBREVIATION)), "abbreviation changed")
        .when(F.size(_words(before)) != F.size(_words(after)), "number of words changed")
    )


def generative_guard(candidates: DataFrame, texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """candidates, texts (doc_id, text) -> the candidates with ``guard``: the reason against an edit of a model, null if there is none.

    After the surface reasons each changed word is looked at: one that differs in yo only; a known word exchanged for one of
    another lemma; another form of the same lemma where the word agrees with its neighbour as it is. Unknown words are typing
    errors and may change. The first changed word with a reason decides. Only distinct pairs of words meet the lexicon.
    """
    c = candidates.withColumn("surface", F.when(starts_with(F.col("category"), GENERATIVE), surface_reason(F.col("before"), F.col("after"))).otherwise(F.lit("")))
    open_ = c.filter("surface is null").join(texts.select("doc_id", "text"), "doc_id")
    both = F.filter(F.zip_with(_words(F.col("before")), _words(F.col("after")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"])
    p = open_.select("doc_id", "ord", _words(F.col("text")).alias("w"), F.posexplode(both).alias("k", "p"))
    at = F.array_position("w", F.col("p.a"))  # the first place of the word; 0 if the text does not hold it
    p = p.select(
        "doc_id", "ord", "k", F.col("p.a").alias("word"), F.lower("p.a").alias("a"), F.lower("p.b").alias("b"),
        F.lower(F.when(at > 1, F.try_element_at("w", at.cast("int") - 1))).alias("left"), F.lower(F.when(at > 0, F.try_element_at("w", at.cast("int") + 1))).alias("right"),
    )
    forms = lexicon.select(F.lower("form").alias("form"), "lemma").distinct()
    known = forms.select(F.col("form").alias("a")).distinct().withColumn("known_a", F.lit(True))
    known_b = forms.select(F.col("form").alias("b")).distinct().withColumn("known_b", F.lit(True))
    same = p.select("a", "b").distinct().join(forms.withColumnRenamed("form", "a"), "a").join(forms.withColumnRenamed("form", "b"), ["b", "lemma"]).select("a", "b").distinct().withColumn("same", F.lit(True))
    # Neighbours: the word as a modifier of the next one, and as the head of the one before.
    near = p.select(F.col("a").alias("m"), F.col("right").alias("h")).union(p.select("left", "a")).filter("m is not null and h is not null").distinct()
    read = lambda pos, name: lexicon.filter(F.col("pos") == pos).select(F.lower("form").alias(name), *(F.col(f).alias(f"{name}_{f}") for f in ("case", "number", "gender", "animacy")))
    fits = near.join(read("ADJ", "m"), "m").join(read("NOUN", "h"), "h").filter(lx.agrees("m_", "h_")).select("m", "h").distinct()
    p = p.join(known, "a", "left").join(known_b, "b", "left").join(same, ["a", "b"], "left")
    p = p.join(fits.select(F.col("m").alias("a"), F.col("h").alias("right"), F.lit(True).alias("to_right")), ["a", "right"], "left")
    p = p.join(fits.select(F.col("m").alias("left"), F.col("h").alias("a"), F.lit(True).alias("to_left")), ["left", "a"], "left")
    why = (
        F.when(T.fold_yo(F.col("a")) == T.fold_yo(F.col("b")), "only yo")
        .when(F.col("known_a").isNull(), None)
        .when(F.col("same") & (F.coalesce("to_right", F.lit(False)) | F.coalesce("to_left", F.lit(False))), "agrees as it is")
        .when(F.col("known_b") & F.col("same").isNull(), "another word")
    )
    first = p.withColumn("why", why).filter("why is not null").groupBy("doc_id", "ord").agg(F.min_by("why", "k").alias("why"))
    return c.join(first, ["doc_id", "ord"], "left").withColumn("guard", F.coalesce(F.nullif("surface", F.lit("")), "why")).drop("surface", "why")


def doubtful(before: Column, after: Column, sources: Column) -> Column:
    """Whether an edit of models alone changes quotes, adds a comma on one model's word (unless it is made for commas), loses a number
    or an abbreviation, or fuses words."""
    commas = lambda c: F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    cyrillic = lambda c: F.regexp_extract_all(c, F.lit("[А-Яа-яЁё]+"), F.lit(0))
    tokens = F.regexp_extract_all(before, F.lit(r"(?<![А-Яа-яЁёA-Za-z])[А-ЯЁA-Z]{2,}(?![А-Яа-яЁёA-Za-z])|(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])"), F.lit(0))
    adds = ~F.exists(sources, lambda s: F.contains(s, F.lit("rupunct"))) & (F.size(sources) == 1) & (commas(after) > commas(before))
    loses = F.exists(tokens, lambda t: ~F.contains(after, t))
    fuses = (F.size(cyrillic(before)) >= 2) & (F.size(cyrillic(after)) == 1) & before.rlike(r"\s")
    return (T.quotes(before) != T.quotes(after)) | adds | loses | fuses


def lowered(candidates: DataFrame) -> DataFrame:
    """The candidates with the confidence of doubtful edits of models lowered below what is accepted."""
    sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("category"))
    low = starts_with(F.col("category"), GENERATIVE) & doubtful(F.col("before"), F.col("after"), sources)
    return candidates.withColumn("confidence", F.when(low, F.least("confidence", F.lit(SOLO_CONFIDENCE))).otherwise(F.col("confidence")))


def opens_closed_comma(text: Column, start: Column, before: Column, after: Column, category: Column) -> Column:
    """Whether a model takes a comma away in or near a phrase whose commas stay."""
    commas = lambda c: F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    lo = F.greatest(F.coalesce(start, F.lit(0)) - BEFORE, F.lit(0))
    window = F.substr(text, lo + 1, F.coalesce(start, F.lit(0)) + F.length(before) + BEHIND - lo)
    return ~deterministic(category) & (commas(before) > commas(after)) & window.rlike(CLOSED)


def inside_quotes(text: Column, at: Column) -> Column:
    """Whether an offset (0-based) lies between « and »."""
    head = F.substr(text, F.lit(1), at)
    n = lambda mark: F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))
    return n("«") > n("»")


def on_word_edges(text: Column, start: Column, length: Column) -> Column:
    """Whether a span begins and ends at word edges."""
    letter = f"[{T.LETTER}0-9_]"
    char = lambda i: F.substr(text, i, F.lit(1))
    cut = lambda i: (i >= 1) & (i < F.length(text)) & char(i).rlike(letter) & char(i + 1).rlike(letter)
    return ~cut(start) & ~cut(start + length)


def loose_pattern(literal: Column) -> Column:
    """A pattern that finds a literal whatever blanks and line breaks stand between its words."""
    words = F.filter(F.split(literal, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), r"\s+")
