"""Morphology by joins on a table of readings: parse, agreement, inflection, spell-check by deletion neighbourhoods.

Lexicon schema: form, lexeme_id, lemma, pos, case, number, gender, animacy, pref. Missing features are wildcards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T

SCHEMA = "form string, lexeme_id int, lemma string, pos string, case string, number string, gender string, animacy string, pref int"

# Endings of the two productive patterns from which the fixture is built.
_ADJ = {"masc": ("ый", "ого", "ому", "ый", "ым", "ом"), "femn": ("ая", "ой", "ой", "ую", "ой", "ой"), "neut": ("ое", "ого", "ому", "ое", "ым", "ом"), "plur": ("ые", "ых", "ым", "ые", "ыми", "ых")}
_NOUN = {"femn": (("а", "ы", "е", "у", "ой", "е"), ("ы", "", "ам", "ы", "ами", "ах")), "masc": (("", "а", "у", "", "ом", "е"), ("ы", "ов", "ам", "ы", "ами", "ах"))}
_CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")
_ADJ_STEMS = "складск архивн дежурн смотров планов приёмн ревизионн технич хозяйственн маршрутн дефектн сопроводительн годов внепланов инвентарн экспертн".split()
_NOUN_STEMS = {"femn": "служб групп смен палат схем карт сводк таблиц".split(), "masc": "журнал отдел график протокол отчёт лист участок".split()}


def fixture(spark: SparkSession) -> DataFrame:
    """A small lexicon generated from stems and endings."""
    return spark.createDataFrame(fixture_rows(), SCHEMA)


def fixture_rows() -> list[tuple]:
    rows: list[tuple] = []
    n = 0
    for stem in _ADJ_STEMS:
        n += 1
        for gender, ends in _ADJ.items():
            for case, end in zip(_CASES, ends):
                rows.append((stem + end, n, stem + "ый", "ADJ", case, "plur" if gender == "plur" else "sing", None if gender == "plur" else gender, None, 0))
    for gender, stems in _NOUN_STEMS.items():
        for stem in stems:
            n += 1
            for number, ends in zip(("sing", "plur"), _NOUN[gender]):
                for case, end in zip(_CASES, ends):
                    rows.append((stem + end, n, stem + _NOUN[gender][0][0], "NOUN", case, number, gender, "inan", 0))
    return rows


def agrees(m: str, h: str) -> Column:
    """Agreement of two readings, as a condition over columns with these prefixes: number, case, gender unless plural, animacy in
    the accusative; what is missing agrees."""
    same = lambda f: F.coalesce(F.col(m + f) == F.col(h + f), F.lit(True))
    plural = (F.col(m + "number") == "plur") | (F.col(h + "number") == "plur")
    return same("number") & same("case") & (F.coalesce(plural, F.lit(False)) | same("gender")) & ((F.coalesce(F.col(h + "case"), F.lit("")) != "accs") | same("animacy"))


def adjacent(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, idx, left, right): neighbouring words with only a blank between. Inside one array, no shuffle."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"[{T.LETTER}]+| |[^{T.LETTER} ]+"), F.lit(0))
    w = texts.select("doc_id", words.alias("w"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: (F.size("w") > 2) & (F.try_element_at("w", i + 1) == " "))
    pairs = F.transform(at, lambda i: F.struct(i.alias("idx"), F.try_element_at("w", i).alias("left"), F.try_element_at("w", i + 2).alias("right")))
    return w.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.idx", "p.left", "p.right")


def disagreements(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adjective and noun side by side that agree in no pair of readings: (doc_id, idx, left, right).

    Agreement is decided once for each distinct pair of forms, then joined to the places. Pairs with an unknown word agree.
    """
    pairs = adjacent(texts)
    adj = lexicon.filter("pos = 'ADJ'")
    noun = lexicon.filter("pos = 'NOUN'")
    places = pairs.join(adj.select(F.col("form").alias("left")).distinct(), "left", "left_semi").join(noun.select(F.col("form").alias("right")).distinct(), "right", "left_semi")
    kinds = places.select("left", "right").distinct()
    m = adj.select(F.col("form").alias("left"), *(F.col(c).alias("m_" + c) for c in ("case", "number", "gender", "animacy")))
    h = noun.select(F.col("form").alias("right"), *(F.col(c).alias("h_" + c) for c in ("case", "number", "gender", "animacy")))
    good = kinds.join(m, "left").join(h, "right").filter(agrees("m_", "h_")).select("left", "right").distinct()
    return places.join(good, ["left", "right"], "left_anti").select("doc_id", "idx", "left", "right")


def inflect(forms: DataFrame, lexicon: DataFrame, target: dict[str, str]) -> DataFrame:
    """(form) -> (form, inflected): the form of the same lexeme with the target features, where exactly one such form exists."""
    src = lexicon.select("form", "lexeme_id", "pos").distinct()
    dst = lexicon
    for k, v in target.items():
        dst = dst.filter(F.col(k).isNull() | (F.col(k) == v))
    got = forms.select("form").distinct().join(src, "form").join(dst.select("lexeme_id", F.col("form").alias("inflected")).distinct(), "lexeme_id")
    got = got.filter(T.fold_yo(F.col("form")) != T.fold_yo(F.col("inflected")))
    return got.groupBy("form").agg(F.countDistinct("inflected").alias("n"), F.min("inflected").alias("inflected")).filter("n = 1").drop("n")


def unify(texts: DataFrame, lexicon: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, idx, before, after): the one word of a noun phrase that does not fit, and its fitting form.

    A phrase is a noun and the chain of at most ``most`` adjectives directly before it, parted by single blanks. Every
    (case, number, gender) that a reading of its words offers is supported by the words that can take it; if one key leads
    alone and exactly one word lacks it, that word is inflected, where one form alone has the key. Ties change nothing.
    Phrases are islands of one window by document; readings meet words by an equi-join on the form.
    """
    parts = F.regexp_extract_all(F.lower("text"), F.lit(f"[{T.LETTER}]+|[^{T.LETTER}]+"), F.lit(0))
    t = texts.select("doc_id", F.posexplode(parts).alias("idx", "form"))
    kinds = lexicon.groupBy("form").agg(F.bool_or(F.col("pos") == "NOUN").alias("noun"), F.bool_or(F.col("pos") == "ADJ").alias("adj"))
    t = t.join(kinds, "form", "left").withColumn("gap", F.col("form") == " ")
    w = Window.partitionBy("doc_id").orderBy("idx")
    inside = F.coalesce(F.col("adj"), F.lit(False)) | F.col("gap")
    # A phrase ends behind its noun; a word that is neither adjective nor blank parts phrases.
    t = t.withColumn("cut", F.lag(~inside, 1, True).over(w)).withColumn("np", F.sum(F.col("cut").cast("int")).over(w))
    words = t.filter(~F.col("gap") & (F.coalesce("adj", F.lit(False)) | F.coalesce("noun", F.lit(False)))).select("doc_id", "np", "idx", "form", "noun")
    shape = words.groupBy("doc_id", "np").agg(F.count("*").alias("n"), F.max_by("noun", "idx").alias("headed"))
    words = words.join(shape.filter(f"headed and n between 3 and {most + 1}"), ["doc_id", "np"])
    readings = lexicon.select("form", "lexeme_id", "pos", F.col("case").alias("c"), F.col("number").alias("m"), F.when(F.col("number") != "plur", F.col("gender")).alias("g"))
    keyed = words.join(readings, "form").filter("c is not null and m is not null").select("doc_id", "np", "idx", "n", "c", "m", "g").distinct()
    votes = keyed.groupBy("doc_id", "np", "n", "c", "m", "g").agg(F.count("*").alias("support"))
    lead = Window.partitionBy("doc_id", "np")
    votes = votes.withColumn("best", F.max("support").over(lead)).filter("support = best").withColumn("leaders", F.count("*").over(lead)).filter("leaders = 1 and support = n - 1")
    odd = words.drop("n").join(votes.select("doc_id", "np", "c", "m", "g"), ["doc_id", "np"])
    same = keyed.select("doc_id", "np", "idx", "c", "m", F.coalesce("g", F.lit("-")).alias("gg"))
    odd = odd.withColumn("gg", F.coalesce("g", F.lit("-"))).join(same, ["doc_id", "np", "idx", "c", "m", "gg"], "left_anti")
    src = lexicon.select("form", "lexeme_id").distinct()
    dst = readings.select("lexeme_id", F.col("form").alias("after"), "c", "m", F.coalesce("g", F.lit("-")).alias("gg")).distinct()
    got = odd.select("doc_id", "idx", "form", "c", "m", "gg").join(src, "form").join(dst, ["lexeme_id", "c", "m", "gg"]).filter("form <> after")
    g = got.groupBy("doc_id", "idx", F.col("form").alias("before")).agg(F.countDistinct("after").alias("k"), F.min("after").alias("after"))
    return g.filter("k = 1").select("doc_id", "idx", "before", "after")


# ---- spell-check ---------------------------------------------------------------------------------------------------------


def _neighbourhood(form: Column) -> Column:
    """The form and all forms with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substr(form, F.lit(1), i - 1), F.substr(form, i + 1, F.length(form))))
    return F.array_distinct(F.concat(F.array(form), cut))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two forms differ by one insertion, deletion, substitution or swap of neighbours."""
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & swap & (a != b))


def spell_unique(forms: DataFrame, known: DataFrame, least: int = 5, most: int = 24) -> DataFrame:
    """(form) -> (form, fixed): unknown forms with exactly one known form at one edit.

    Deletion neighbourhoods of both sides meet in an equi-join: no alphabet is enumerated, no pair without a shared key is
    formed. Forms of digits, too short or too long, are left alone.
    """
    k = known.select(F.col("form").alias("fixed")).distinct()
    unknown = forms.select("form").distinct().filter(F.length("form").between(least, most) & ~F.col("form").rlike("[0-9_-]")).join(k.withColumnRenamed("fixed", "form"), "form", "left_anti")
    a = unknown.select("form", F.explode(_neighbourhood(F.col("form"))).alias("key"))
    b = k.filter(F.length("fixed").between(least - 1, most + 1)).select("fixed", F.explode(_neighbourhood(F.col("fixed"))).alias("key"))
    pairs = a.join(b, "key").select("form", "fixed").distinct().filter(one_edit(F.col("form"), F.col("fixed")) & (T.fold_yo(F.col("form")) != T.fold_yo(F.col("fixed"))))
    return pairs.groupBy("form").agg(F.count("*").alias("n"), F.min("fixed").alias("fixed")).filter("n = 1").drop("n")


def near_terms(words: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(form), (term) -> (form, term, distance): words at one to ``most`` (at most two) edits from a term.

    The forms that arise from leaving out up to two letters meet in an equi-join; only pairs that share one are measured.
    """
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    twice = lambda c: F.array_distinct(F.flatten(F.transform(_neighbourhood(c), _neighbourhood)))
    keys = _neighbourhood if most == 1 else twice
    a = words.select("form").distinct().select("form", F.explode(keys(F.col("form"))).alias("key"))
    b = terms.select("term").distinct().select("term", F.explode(keys(F.col("term"))).alias("key"))
    pairs = a.join(b, "key").select("form", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("form", "term")).filter(F.col("distance").between(1, most))


def spelled_words(text: Column) -> Column:
    """Words in small letters that a dictionary can tell about: of one script, without separate accents."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: w.rlike("^(?:[а-яё]+|[a-zà-öø-ÿ]+)$"))


def substitute(text: Column, fixes: Column) -> Column:
    """The text with each whole word that is a key of the map (in small letters) replaced, in the case of the original."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    new = F.transform(parts, lambda p: F.coalesce(F.when(F.try_element_at(fixes, F.lower(p)).isNotNull(), T.case_like(F.try_element_at(fixes, F.lower(p)), p)), p))
    return F.when(fixes.isNull() | (text == ""), text).otherwise(F.array_join(new, ""))
