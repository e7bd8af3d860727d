"""Scalar string functions as Column expressions: normalisation, cleanup, signatures, hashes. All stay in the JVM.

Java regular expressions are ASCII by default, so letters are spelled as classes or under (?U). Every function maps null to
null and '' to a defined result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"
LOWER = "a-zà-öø-ÿа-яё"

# Blanks that become the ordinary one, and characters that vanish.
ODD_BLANKS = "    "
INVISIBLE = "⁠​﻿­"

# Service lines of exported documents, matched against the trimmed line.
SERVICE_LINES = (
    r"(?iu)^система .+, выпуск \d+$",
    r"(?iu)^экз\. № \d+.*$",
    r"(?iu)^страница\s+\d+(\s+из\s+\d+)?$",
    r"(?iu)^page\s+\d+(\s+of\s+\d+)?$",
    r"(?iu)^дата (печати|выгрузки):? .*$",
    r"(?iu)^обновлено автоматически.*$",
    r"(?iu)^[©(c)]+ .*$",
    r"(?iu)^все права (сохранены|защищены)\.?$",
    r"(?iu)^читайте также:.*$",
    r"(?iu)^поделиться ссылкой:.*$",
    r"(?iu)^share this page:.*$",
    r"(?iu)^версия для печати$",
    r"(?iu)^[-=_*~ ]{3,}$",
    r"(?iu)^вверх \| к оглавлению.*$",
    r"(?iu)^\d{1,4}\s*/\s*\d{1,4}$",
    r"(?iu)^(информация об изменениях|об ожидаемых изменениях|внимание!).*$",
    r"(?iu)^см\.\s+(также|комментарии|энциклопедии).*$",
    r"(?iu)^документ предоставлен\s.*$",
    r"(?iu)^[0-9ivx.]+\s+[^\n]+?[\s.]{3,}\d{1,4}$",
)


def newlines_local(c: Column) -> Column:
    """CRLF, CR and the line separator become LF; more than two LF become two."""
    c = F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" "), F.lit("\n"))
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def newlines_double(c: Column) -> Column:
    """CRLF and CR become two LF (each is a paragraph), the line separator one; more than two become two."""
    c = F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n\n")), F.lit("\r"), F.lit("\n\n")), F.lit(" "), F.lit("\n"))
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def newlines_trimmed(c: Column) -> Column:
    """CRLF and CR become LF; blanks around the text go."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"^[ \n\t]+|[ \n\t]+$", "")


def visible_blanks(c: Column) -> Column:
    return F.translate(c, ODD_BLANKS + INVISIBLE, "    ")


def join_wraps(c: Column) -> Column:
    """Words broken by a hyphen at a line end, then lines broken within a clause."""
    c = F.regexp_replace(c, rf"([{LETTER}])-\n([{LOWER}])", "$1$2")
    return F.regexp_replace(c, rf"([{LOWER},;:])\n([{LOWER}])", "$1 $2")


def wrap_joins(c: Column) -> Column:
    """How many line breaks join_wraps removes."""
    return _count(c, "\n") - _count(join_wraps(c), "\n")


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def is_service_line(line: Column) -> Column:
    return F.trim(line).rlike("(?iu)" + "|".join(f"(?:{p.removeprefix('(?iu)')})" for p in SERVICE_LINES))


def kept_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: ~is_service_line(x))


def without_service_lines(c: Column) -> Column:
    """Service lines go, blanks within a line collapse, line ends are trimmed, more than two LF become two."""
    lines = F.transform(kept_lines(c), lambda x: F.rtrim(F.regexp_replace(x, "[ \t]{2,}", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def cleanup_stats(c: Column) -> Column:
    """struct<original_lines, kept_lines, removed_service, joined_wrapped, reduction_pct>."""
    lines, kept = F.size(F.split(c, "\n")), F.size(kept_lines(c))
    cut = F.when(F.length(c) > 0, F.round(F.lit(100.0) * (F.lit(1.0) - kept.cast("double") / lines), 1)).otherwise(F.lit(0.0))
    return F.when(
        c.isNotNull(),
        F.struct(lines.alias("original_lines"), kept.alias("kept_lines"), (lines - kept).alias("removed_service"), wrap_joins(c).alias("joined_wrapped"), cut.alias("reduction_pct")),
    )


def soft_breaks(c: Column) -> Column:
    """A single LF becomes a blank; paragraph breaks stay."""
    return F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")


def one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+", " "))


def detokenise(c: Column) -> Column:
    """No blank before closing punctuation nor behind opening brackets; runs of blanks collapse."""
    c = F.regexp_replace(c, r"\s+([.,;:!?…»)\]])", "$1")
    c = F.regexp_replace(c, r"([«(\[])\s+", "$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def model_output(c: Column) -> Column:
    """Answer of a language model without thoughts, fences, a leading label, a trailing note and paired outer quotes."""
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"```[a-zA-Z]*\n?", "")
    c = F.trim(F.regexp_replace(c, r"(?iu)^\s*(исправленный текст|исправлено|ответ|corrected|answer)\s*:\s*", ""))
    c = F.regexp_replace(c, r"(?isu)\n+\s*\(?(примечание|пояснение|note)\s*:.*$", "")
    for _ in range(3):
        c = F.trim(F.regexp_replace(c, r'^(?:"([^"]*)"|«([^«»]*)»|“([^“”]*)”|„([^„“]*)“)$', "$1$2$3$4"))
    return c


def fold_yo(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def only_yo_differs(a: Column, b: Column) -> Column:
    return (a != b) & (fold_yo(a) == fold_yo(b))


def case_like(word: Column, model: Column) -> Column:
    """word with a capital where the model has one; capitals throughout if the model is longer than one letter and all capitals."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))
    first = F.substring(model, 1, 1)
    return (
        F.when((F.length(model) > 1) & (F.upper(model) == model) & (F.lower(model) != model), F.upper(word))
        .when((F.upper(first) == first) & (F.lower(first) != first), capital)
        .otherwise(word)
    )


def delimiters(c: Column) -> Column:
    """Ordered delimiters of a text."""
    return F.regexp_replace(c, r"[^.,;:!?()\[\]«»\"—–-]", "")


def quotes(c: Column) -> Column:
    return F.regexp_replace(c, "[^«»\"„“”]", "")


def skeleton(c: Column) -> Column:
    """Words and numbers in order, folded: equal skeletons differ in punctuation only."""
    return F.regexp_extract_all(fold_yo(c), F.lit(f"[{LOWER}0-9]+"), F.lit(0))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))


def acronyms(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(f"[{LETTER}0-9]+"), F.lit(0)), lambda w: w.rlike("^[A-ZА-ЯЁ]{2,12}$"))


def words(c: Column) -> Column:
    """Tokens of the word index: lower case, ё as е."""
    return F.regexp_extract_all(fold_yo(c), F.lit("[a-zа-я0-9]+"), F.lit(0))


def trigrams(c: Column) -> Column:
    """Character trigrams of each word between two '$'; words of one letter give the padded word."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit("$"), w, F.lit("$")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))


def hash_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{LOWER}0-9_-]{{2,}}"), F.lit(0))


def bucket(token: Column, dim: int) -> Column:
    """First eight bytes of the md5, big endian, modulo a dimension that divides 4096: the last three hex digits of them."""
    return (F.conv(F.substring(F.md5(token), 14, 3), 16, 10).cast("int") % dim).cast("int")


def redact_key(c: Column) -> Column:
    return F.when(F.length(c) <= 16, F.concat(F.substring(c, 1, 4), F.lit("..."))).otherwise(F.concat(F.substring(c, 1, 12), F.lit("..."), F.right(c, F.lit(4))))


def valid_word(c: Column) -> Column:
    """A word a user may add to the dictionary."""
    t = F.trim(c)
    return F.coalesce(F.length(t).between(2, 64) & ~t.rlike(r"""[\s\x00-\x1f"'«»()\[\]{}<>]"""), F.lit(False))


def nested_quotes(c: Column) -> Column:
    """Whether an opening « stands within an open one."""
    steps = F.transform(F.filter(F.split(c, ""), lambda x: x.isin("«", "»")), lambda x: F.when(x == "«", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))
    return F.aggregate(
        steps,
        start,
        lambda s, x: F.struct(F.greatest(s["depth"] + x, F.lit(0)).alias("depth"), (s["bad"] | (s["depth"] + x > 1)).alias("bad")),
        lambda s: s["bad"],
    )


def excerpt(c: Column, terms: Column, before: int = 180, size: int = 650) -> Column:
    """A window of the text from a little before the first term found; from the start if there is none."""
    low = F.lower(c)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1))
    return F.substr(c, start, F.lit(size))


def change_line(n: Column, before: Column, after: Column, reason: Column, category: Column) -> Column:
    """One numbered line of the CHANGES block; long reasons are cut."""
    short = F.when(F.length(reason) > 140, F.concat(F.substring(reason, 1, 137), F.lit("..."))).otherwise(reason)
    return F.concat(n.cast("string"), F.lit(". «"), before, F.lit("» → «"), after, F.lit("» — ["), category, F.lit("] "), short)


def similar_enough(source: Column, produced: Column, drift: float = 0.35, kept: float = 0.6) -> Column:
    """Whether a produced text is a correction and no paraphrase: little length drift, most longer words retained."""
    long_words = lambda c: F.array_distinct(F.filter(words(c), lambda w: F.length(w) >= 3))
    a, b = long_words(source), long_words(produced)
    share = F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return (F.abs(F.length(produced) - F.length(source)) <= F.lit(drift) * F.greatest(F.length(source), F.lit(1))) & (share >= kept)


def reason_for(before: Column, after: Column, category: Column) -> Column:
    """Human-readable reason of an edit."""
    commas = lambda c: _count(c, ",")
    return (
        F.when(F.concat_ws("", skeleton(before)) == F.concat_ws("", skeleton(after)), F.when(commas(after) > commas(before), F.lit("comma added")).when(commas(after) < commas(before), F.lit("comma removed")).otherwise(F.lit("punctuation")))
        .when(category.rlike("spell"), F.lit("spelling"))
        .when(category.rlike("^rule-"), F.lit("grammar"))
        .when(category.rlike("draft|reason"), F.lit("suggested by the model"))
        .otherwise(F.lit("correction"))
    )
