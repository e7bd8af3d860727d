"""Sequence alignment of texts: token edits with offsets and the guard against rewrites.

Alignment has no relational form, so one narrow Arrow kernel gives, for each pair, the aligned changes of its words and of its
tokens as arrays. What they mean is told by columns over these arrays: nothing is shuffled.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]|\s+")
_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]+")
# What a correction may change at most. Words more or less; length against the shorter text; words of one change;
# changed words, at least and as a share; replaced stretches. And the longest fragment of an edit, in characters.
MORE_WORDS, DRIFT, ONE_CHANGE, CHANGED, CHANGED_SHARE, REPLACED = 1, 0.20, 2, 3, 0.12, 3
LONGEST_FRAGMENT = 90

_SCHEMA = "source_words int, target_words int, words array<struct<old:int,new:int>>, tokens array<struct<start:int,before:string,after:string>>"


def _changes(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    for kind, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            yield i1, i2, j1, j2


def aligned(source: str, target: str) -> tuple[int, int, list[dict], list[dict]]:
    """(words of the source, of the target, changes of words, changes of tokens); a token change that only adds or removes is
    widened by the token to its left, else to its right."""
    words, others = _WORD.findall(source), _WORD.findall(target)
    a, b = _TOKEN.findall(source), _TOKEN.findall(target)
    at = [0]
    for x in a:
        at.append(at[-1] + len(x))
    tokens = []
    for i1, i2, j1, j2 in _changes(a, b):
        if i1 == i2 or j1 == j2:
            left = 1 if i1 and j1 else 0
            right = 1 if not left and i2 < len(a) and j2 < len(b) else 0
            i1, j1, i2, j2 = i1 - left, j1 - left, i2 + right, j2 + right
        tokens.append({"start": at[i1], "before": "".join(a[i1:i2]), "after": "".join(b[j1:j2])})
    return len(words), len(others), [{"old": i2 - i1, "new": j2 - j1} for i1, i2, j1, j2 in _changes(words, others)], tokens


def alignment(pairs: DataFrame) -> DataFrame:
    """(case_id, source, target) -> the pairs with the columns of _SCHEMA. Pairs with a null text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [aligned(s, t) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*got)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.struct([("old", pa.int32()), ("new", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("before", pa.string()), ("after", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=[*batch.schema.names, "source_words", "target_words", "words", "tokens"])

    kind = dict(pairs.dtypes)["case_id"]
    rows = pairs.select("case_id", "source", "target").filter("source is not null and target is not null")
    return rows.mapInArrow(run, f"case_id {kind}, source string, target string, {_SCHEMA}")


def measures() -> dict[str, Column]:
    """What the guard looks at, over the columns of alignment()."""
    size = F.transform("words", lambda w: F.greatest(w["old"], w["new"]))
    shorter = F.greatest(F.lit(1), F.least(F.length("source"), F.length("target")))
    return {
        "changed": F.aggregate(size, F.lit(0), lambda n, x: n + x),
        "replaced": F.size(F.filter("words", lambda w: (w["old"] > 0) & (w["new"] > 0))),
        "longest": F.coalesce(F.array_max(size), F.lit(0)),
        "more_words": F.when(F.col("source_words") > 0, F.abs(F.col("target_words") - F.col("source_words"))).otherwise(0),
        "drift": F.abs(F.length("target") - F.length("source")) / shorter,
    }


def is_rewrite() -> Column:
    m = measures()
    allowed = F.greatest(F.lit(CHANGED), F.ceil(F.lit(CHANGED_SHARE) * F.greatest("source_words", F.lit(1))))
    return (m["more_words"] > MORE_WORDS) | (m["drift"] > DRIFT) | (m["longest"] > ONE_CHANGE) | (m["changed"] > allowed) | (m["replaced"] > REPLACED)


def rewrite_guard(pairs: DataFrame) -> DataFrame:
    """(case_id, source, target) -> (case_id, rewrite, changed, replaced, longest)."""
    m = measures()
    return alignment(pairs).select("case_id", is_rewrite().alias("rewrite"), *(m[x].alias(x) for x in ("changed", "replaced", "longest")))


def token_edits(pairs: DataFrame) -> DataFrame:
    """(case_id, source, target) -> (case_id, start, before, after) of each change.

    Nothing for a pair whose line breaks differ in number, whose change is a rewrite, or that has an edit with a line break in
    it, with an empty side or longer than LONGEST_FRAGMENT.
    """
    breaks = lambda c: F.size(F.split(c, "\n"))
    bad = F.exists("tokens", lambda t: (F.greatest(F.length(t["before"]), F.length(t["after"])) > LONGEST_FRAGMENT) | (F.length(t["before"]) * F.length(t["after"]) == 0) | F.contains(t["before"], F.lit("\n")) | F.contains(t["after"], F.lit("\n")))
    ok = alignment(pairs).filter((breaks(F.col("source")) == breaks(F.col("target"))) & ~is_rewrite() & ~bad)
    return ok.select("case_id", F.explode("tokens").alias("t")).select("case_id", "t.*").filter("before <> after")


def undo_yo(pairs: DataFrame) -> DataFrame:
    """(case_id, source, target) -> (case_id, text): the target with each yo for which the source has ye put back, where they are aligned
    character by character; a null source leaves the target as it is, a null target stays null."""

    def back(source: str | None, target: str | None) -> str | None:
        if not source or not target or not set(target) & set("ёЁ"):
            return target
        out = list(target)
        for i1, i2, j1, j2 in _changes(list(source), list(target)):
            if i2 - i1 == j2 - j1:
                for i, j in zip(range(i1, i2), range(j1, j2)):
                    if source[i] + target[j] in ("её", "ЕЁ"):
                        out[j] = source[i]
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [back(s, t) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=pa.string())], names=["case_id", "text"])

    kind = dict(pairs.dtypes)["case_id"]
    return pairs.select("case_id", "source", "target").mapInArrow(run, f"case_id {kind}, text string")
