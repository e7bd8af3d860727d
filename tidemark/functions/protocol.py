"""Functions around edits and prompts: context growth, safe deletions, renumbering, filters of changes, query planning, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

_WORD = f"[{T.LETTER}0-9_-]"


def grow(text: Column, start: Column, before: Column) -> Column:
    """struct<start, before>: a span grown to word edges and by one neighbouring word on each side."""
    left = F.regexp_extract(F.substr(text, F.lit(1), start), rf"(?:{_WORD}+\s+)?{_WORD}*$", 0)
    right = F.regexp_extract(F.substr(text, start + F.length(before) + 1, F.length(text)), rf"^{_WORD}*(?:\s+{_WORD}+)?", 0)
    return F.struct((start - F.length(left)).cast("int").alias("start"), F.concat(left, before, right).alias("before"))


def safe_deletion(text: Column, start: Column, before: Column, after: Column) -> Column:
    """struct<start, before, after>: an edit to nothing is anchored to the word on its left, else on its right, so that both sides
    hold text; other edits stay."""
    head, tail = F.substr(text, F.lit(1), start), F.substr(text, start + F.length(before) + 1, F.length(text))
    left = F.regexp_extract(head, rf"{_WORD}+\s*$", 0)
    right = F.regexp_extract(tail, rf"^\s*{_WORD}+", 0)
    kept = F.struct(start.cast("int").alias("start"), before.alias("before"), after.alias("after"))
    by_left = F.struct((start - F.length(left)).cast("int").alias("start"), F.concat(left, before).alias("before"), F.rtrim(left).alias("after"))
    by_right = F.struct(start.cast("int").alias("start"), F.concat(before, right).alias("before"), F.ltrim(right).alias("after"))
    return F.when(after != "", kept).when(F.length(left) > 0, by_left).when(F.length(right) > 0, by_right)


def renumber(lines: Column) -> Column:
    """Numbered lines of a block numbered 1, 2, 3 ...; indents and other lines stay."""
    is_item = lambda x: x.rlike(r"^\s*\d+[.)]\s")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        n = a["n"] + F.when(is_item(x), 1).otherwise(0)
        new = F.when(is_item(x), F.concat(F.regexp_extract(x, r"^\s*", 0), n.cast("string"), F.regexp_extract(x, r"^\s*\d+([.)]\s.*)$", 1))).otherwise(x)
        return F.struct(n.alias("n"), F.concat(a["out"], F.array(new)).alias("out"))

    return F.array_join(F.aggregate(F.split(lines, "\n"), start, step, lambda a: a["out"]), "\n")


def in_turn(text: Column, pairs: Column) -> Column:
    """Pairs applied in order, each to its first occurrence in what the pairs before it left."""

    def step(t, p):
        at = F.instr(t, p["before"])
        return F.when((F.length(p["before"]) > 0) & (at > 0), F.concat(F.substr(t, F.lit(1), at - 1), p["after"], F.substr(t, at + F.length(p["before"]), F.length(t)))).otherwise(t)

    return F.aggregate(pairs, text, step)


def keep_changes(changes: Column, raw: Column, protected: Column) -> Column:
    """Changes that are none, end in an ellipsis, are not in the raw text, differ in yo only or touch a protected word go."""
    def ok(c):
        folded = F.transform(T.words(c["before"]), lambda w: w)
        return (
            (c["before"] != c["after"])
            & ~c["before"].rlike(r"(\.\.\.|…)\s*$")
            & ~c["after"].rlike(r"(\.\.\.|…)\s*$")
            & (F.instr(raw, c["before"]) > 0)
            & ~T.only_yo_differs(c["before"], c["after"])
            & ~F.arrays_overlap(folded, F.coalesce(protected, F.array().cast("array<string>")))
        )

    return F.filter(changes, ok)


# Words that carry no query, and words that ask for norms.
STOP = "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по the a an of in on at to for by with and or le la les de des du et der die das und von mit".split()
NORM_CUES = r"(?iu)регламент|приказ|инструкци|положени|норматив|\bгост\b|\bснип\b|согласно|в соответствии"


def plan_queries(text: Column, most: int = 5) -> Column:
    """array<string> of retrieval queries of a text: abbreviations, what follows them (up to 160 characters of the sentence), then its first twelve content
    words; distinct without regard to case, in that order."""
    capital = F.filter(T.acronyms(text), lambda w: F.length(w) >= 2)
    tails = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])[A-ZА-ЯЁ]{2,12}\s+([^\n.]{3,160})"), F.lit(1)), lambda t: F.regexp_replace(t, r"\s+", " "))
    stop = F.array(*map(F.lit, STOP))
    content = F.slice(F.filter(T.skeleton(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2)), 1, 12)
    everything = F.filter(F.transform(F.concat(capital, tails, F.array(F.array_join(content, " "))), lambda q: F.btrim(q, F.lit(" ,;:"))), lambda q: F.length(q) > 1)
    folded = F.transform(everything, lambda q: F.lower(q))
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(everything), F.lit(1))), lambda i: (i <= F.size(everything)) & (F.array_position(folded, F.try_element_at(folded, i)) == i))
    return F.slice(F.transform(first, lambda i: F.trim(F.element_at(everything, i))), 1, most)


def wants_retrieval(text: Column) -> Column:
    """Whether a text asks for evidence: an abbreviation, a word of norms or a quoted name."""
    return (F.size(T.acronyms(text)) > 0) | text.rlike(NORM_CUES) | text.rlike("[«\"“][^»\"”]{3,80}[»\"”]")


def few_shot(examples: Column, text: Column, instruction: str) -> Column:
    """array<struct<role, content>>: the instruction, example pairs as turns, the text."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    shots = F.flatten(F.transform(examples, lambda e: F.array(turn("user", e["wrong"]), turn("assistant", e["right"]))))
    return F.concat(F.array(turn("system", F.lit(instruction))), shots, F.array(turn("user", text)))


def evidence_block(hits: Column) -> Column:
    """Bulleted evidence lines, 600 characters of each hit."""
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("— ["), h["doc_id"], F.lit("] "), F.substring(h["text"], 1, 600))), "\n")


def needs_review(length: Column, categories: Column) -> Column:
    """Whether the costly model is asked: nothing found in a long or signal text, or nothing but punctuation."""
    punctuation = F.forall(categories, lambda c: c.rlike("punctuation|comma"))
    rules = F.forall(categories, lambda c: F.startswith(c, F.lit("rule-")))
    some = F.size(categories) > 0
    return F.when(some & rules, False).when(some & ~punctuation, False).otherwise(length >= 180)
