"""Problem 3: text that looks the same but is written with other characters.

Method: script-aware repair. Full-width letters and digits, letters with a separate accent, zero-width characters and odd
blanks are brought to one form by fixed rules. In a token that mixes scripts the dominant script is determined (both of
two equally strong ones are tried) and the look-alikes of the other are substituted, but only where the result is a word of
the corpus vocabulary. A text is a case if the rules change it or a token mixes scripts; whether the vocabulary knows the
repaired token decides what is written in its place, not whether the row is found.

One narrow Arrow pass; most texts cost one search for a character that may matter. The vocabulary is never collected: each
task gives the words it has not given before, their distinct set is semi-joined with the few candidates.

Defined results: null -> null, '' -> ''; texts without a case come back unchanged; line breaks, quotes, dashes, the numero
sign, the ellipsis and Chinese punctuation are left as they are; an accent with no single character is left; a mixed token
without a known repair is left.
"""

from __future__ import annotations

import functools
import re as stdlib_re
import unicodedata
from collections.abc import Callable

import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_columns, map_rows, written

# Letters that look alike in Latin, Cyrillic and Greek print, column by column.
LATIN = "ABCEHIJKMNOPSTUXYZabceghijkmnopqrstuvwxyz"
CYRILLIC = {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "k": "к", "m": "м", "n": "п", "o": "о", "p": "р", "r": "г", "s": "ѕ", "t": "т", "u": "и", "x": "х", "y": "у"}
GREEK = {"A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "i": "ι", "k": "κ", "n": "η", "o": "ο", "p": "ρ", "t": "τ", "u": "υ", "v": "ν", "x": "χ", "y": "γ"}

ZERO_WIDTH = "­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁤⁪-⁯﻿"
BLANKS = "\t\u000b\u000c   -   　"
FULL_WIDTH = "０-９Ａ-Ｚａ-ｚ"
#: Words that a task remembers to have given to the vocabulary.
KNOWN_WORDS = 1_000_000
_WORDS = stdlib_re.compile(r"[^\W\d_]{2,}")


@functools.cache
def _composable() -> str:
    """Alternation 'bases of a mark, mark' of all pairs for which one character exists (built from the Unicode tables)."""
    by: dict[str, list[str]] = {}
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) >= 2 and unicodedata.normalize("NFC", parts) == chr(cp) and unicodedata.category(chr(cp))[0] == "L" and unicodedata.category(parts[-1]) == "Mn":
            base = unicodedata.normalize("NFC", parts[:-1])
            if len(base) == 1:
                by.setdefault(parts[-1], []).append(base)
    return "|".join(f"[{''.join(sorted(b))}]{m}" for m, b in sorted(by.items()))


_LATIN_RANGE, _CYRILLIC_RANGE, _GREEK_RANGE = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Ѐ-ҁҊ-ԯ", "Ͱ-ͳͶͷͻ-ͽΆΈ-Ͽἀ-ῼ"
_MARKS = "\u0300-\u036f\u0483-\u0487"

_ODD = stdlib_re.compile(f"[{ZERO_WIDTH}{BLANKS}{FULL_WIDTH}{_MARKS}{_GREEK_RANGE}]")
_CYRILLIC_LETTER = stdlib_re.compile(f"[{_CYRILLIC_RANGE}]")
_BESIDE = stdlib_re.compile(f"[{_LATIN_RANGE}](?:(?=[{_CYRILLIC_RANGE}])|(?<=[{_CYRILLIC_RANGE}].))")


def may_be_case(text: str) -> bool:
    """Whether a text holds a character of the fixed rules, an accent, a Greek letter, or a Latin one beside a Cyrillic one."""
    return bool(_ODD.search(text) or _CYRILLIC_LETTER.search(text) and _BESIDE.search(text))


_WORD = re.compile(r"[\p{L}\p{M}]+")
_ZW, _BL, _FW = (stdlib_re.compile(f"[{x}]") for x in (ZERO_WIDTH, BLANKS, FULL_WIDTH))
_MARK = re.compile(r"\p{L}\p{Mn}+")
_SCRIPTS = {"latin": re.compile(r"\p{Latin}"), "cyrillic": re.compile(r"\p{Cyrillic}"), "greek": re.compile(r"\p{Greek}")}
_MIXED = stdlib_re.compile(
    "|".join(f"[{a}][{_MARKS}]*[{b}]" for a, b in ((x, y) for x in (_LATIN_RANGE, _CYRILLIC_RANGE, _GREEK_RANGE) for y in (_LATIN_RANGE, _CYRILLIC_RANGE, _GREEK_RANGE) if x != y))
)
_ACCENTED = stdlib_re.compile(_composable())


@functools.cache
def _to(script: str) -> dict[str, str]:
    """Look-alikes of the other scripts -> letters of one script."""
    out: dict[str, str] = {}
    for latin in LATIN:
        same = {"latin": latin, "cyrillic": CYRILLIC.get(latin), "greek": GREEK.get(latin)}
        if same[script]:
            out |= {c: same[script] for s, c in same.items() if c and s != script}
    return out


def plain_form(text: str) -> str:
    """The part of the repair that needs no vocabulary."""
    text = _BL.sub(" ", _ZW.sub("", text))
    text = _FW.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)
    return _MARK.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def mixed_tokens(text: str) -> list[tuple[int, str, list[str]]]:
    """(offset, token, repairs) of each token that mixes scripts: the token in its dominant script, or the next one if not all
    its letters have look-alikes there; of two equally strong scripts both are given."""
    if not _MIXED.search(text):
        return []
    out = []
    for m in _WORD.finditer(text):
        token = m.group()
        if not _MIXED.search(token):
            continue
        counts = {s: len(p.findall(token)) for s, p in _SCRIPTS.items()}
        repairs: list[str] = []
        for n in sorted({n for n in counts.values() if n}, reverse=True):
            for script in (s for s in counts if counts[s] == n):
                got = "".join(_to(script).get(c, c) for c in token)
                if not any(p.search(got) for s, p in _SCRIPTS.items() if s != script):
                    repairs.append(got)
            if repairs:
                break
        out.append((m.start(), token, repairs))
    return out


def repair(text: str | None) -> tuple[str | None, list[tuple[int, str, list[str]]], bool]:
    """(text in plain form, its mixed tokens, whether the text is a case)."""
    if not text or not may_be_case(text):
        return text, [], False
    plain = plain_form(text)
    mixed = mixed_tokens(plain)
    case = bool(mixed or _ZW.search(text) or _BL.search(text) or _FW.search(text) or _ACCENTED.search(text))
    return plain, mixed, case


def found(df: DataFrame, leave_out: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(tab, row_key, text) -> (tab, row_key) of the cases; repeated rows collapse.

    leave_out: a function of (tab, text), run for cases only, that names those that are to be left out.
    """

    def make():
        def each(tab, key, text):
            if repair(text)[2] and not (leave_out and leave_out(tab, text)):
                yield tab, key

        return each

    return map_rows(df.select("tab", "row_key", "text"), make, "tab string, row_key string").dropDuplicates()


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(known): the distinct words of two letters and more in one script, in small letters; full-width letters and accents in plain form."""

    def make():
        given: set[str] = set()

        def each(column):
            new: set[str] = set()
            for t in column:
                if t:
                    new.update(_WORDS.findall((plain_form(t) if _ODD.search(t) else t).lower()))
            new -= given
            if len(given) > KNOWN_WORDS:
                given.clear()
            given.update(new)
            return [[w for w in new if w.isascii() or not _MIXED.search(w)]]

        return each

    return map_columns(texts.select(text), make, "known string").distinct()


def normalise(df: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(tab, row_key, text) -> (tab, row_key, text) in one consistent form; repeated rows collapse.

    corpus: a frame whose column ``text`` gives the vocabulary, df itself by default. A word is in the vocabulary if it
    stands somewhere in one script. Only rows with mixed tokens, their candidates and the distinct words are shuffled by word.
    """
    rows = df.select("tab", "row_key", "text").dropDuplicates()

    def make_plain():
        def each(tab, key, text):
            plain, mixed, _ = repair(text)
            if not mixed:
                yield tab, key, plain

        return each

    def make_mixed():
        def each(tab, key, text):
            plain, mixed, _ = repair(text)
            if mixed:
                yield tab, key, plain, [(at, at + len(token), word, word.lower()) for at, token, repairs in mixed for word in repairs]

        return each

    plain = map_rows(rows, make_plain, "tab string, row_key string, text string")
    mixed = written(map_rows(rows, make_mixed, "tab string, row_key string, text string, m array<struct<s:int,e:int,word:string,known:string>>"), "mixed")
    one = mixed.select("tab", "row_key", F.explode("m").alias("m")).select("tab", "row_key", "m.*")
    known = one.select("known").distinct().join(vocabulary(df if corpus is None else corpus), "known", "left_semi")
    # Where both scripts give a known word, the first in the order of the code points is taken, so that results do not vary.
    subs = one.join(known, "known").groupBy("tab", "row_key", "s").agg(F.min(F.struct("e", "word")).alias("w"))
    subs = subs.groupBy("tab", "row_key").agg(F.array_sort(F.collect_list(F.struct("s", "w.e", "w.word"))).alias("subs"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["done"], F.substr("text", a["at"] + 1, x["s"] - a["at"]), x["word"]).alias("done"))
    end = lambda a: F.concat(a["done"], F.substr("text", a["at"] + 1, F.length("text")))
    fixed = mixed.drop("m").join(subs, ["tab", "row_key"], "left").select("tab", "row_key", F.coalesce(F.aggregate("subs", start, step, end), "text").alias("text"))
    return plain.unionByName(fixed)
