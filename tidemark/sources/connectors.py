"""Connectors to models and servers: one interface, batches in and rows out, stubs for tests; and the parsing of what they answer.

No model ships with the engine. A connector is a function from a list of texts to a list of answers; it runs in Arrow batches on
the workers, so that batching, retries and fallback stay beside the data.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Answer = Callable[[list[str]], list[str]]


def ask(rows: DataFrame, key: str, text: str, answer: Answer, batch: int = 8, attempts: int = 3, pause: float = 0.2) -> DataFrame:
    """(key, text) -> (key, answer, error): blank texts are not asked and answer themselves; failures stay rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[str | None] = list(texts)
            err: list[str | None] = [None] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for k in range(attempts):
                    try:
                        got = answer([texts[i] for i in part])
                        if len(got) != len(part):
                            raise ValueError("answers do not match the texts")
                        for i, g in zip(part, got):
                            out[i] = g
                        break
                    except Exception as e:
                        if k + 1 == attempts:
                            for i in part:
                                out[i], err[i] = None, f"{type(e).__name__}: {e}"[:500]
                        else:
                            time.sleep(pause * 2**k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(err, pa.string())], names=["key", "answer", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, answer string, error string")


def first_of(*answers: Answer) -> Answer:
    """Ordered fallback: the first model that answers."""

    def go(texts: list[str]) -> list[str]:
        last: Exception | None = None
        for a in answers:
            try:
                return a(texts)
            except Exception as e:
                last = e
        raise RuntimeError("no model answered") from last

    return go


def stub(table: dict[str, str]) -> Answer:
    """A deterministic model for tests: known texts have answers, others answer themselves."""
    return lambda texts: [table.get(t, t) for t in texts]


EDITS = "edits array<struct<start:int,before:string,after:string,reason:string,confidence:string>>"


def parse_edits(answer: Column) -> Column:
    """array<struct<start, before, after, reason, confidence>> of a JSON answer: fences go, the outermost braces are taken, bad
    confidences are 0 and others held to 0..1. Anything else gives an empty array."""
    body = F.regexp_extract(F.regexp_replace(answer, "```[a-z]*", ""), r"(?s)\{.*\}", 0)
    edits = F.from_json(body, EDITS)["edits"]
    ok = F.filter(edits, lambda e: e["before"].isNotNull() & e["after"].isNotNull())
    clean = F.transform(
        ok,
        lambda e: F.struct(
            e["start"].alias("start"), e["before"].alias("before"), e["after"].alias("after"), e["reason"].alias("reason"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"),
        ),
    )
    return F.coalesce(clean, F.expr("cast(array() as array<struct<start:int,before:string,after:string,reason:string,confidence:double>>)"))


MATCHES = "matches array<struct<offset:int,length:int,message:string,replacements:array<struct<value:string>>,rule:struct<id:string,category:struct<id:string>>>>"


def parse_matches(answers: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, text, answer) of a rule server -> candidate columns (doc_id, start, before, after, category): useful matches only."""
    m = answers.select("doc_id", "text", F.slice(F.from_json("answer", MATCHES)["matches"], 1, most).alias("m"))
    e = m.select("doc_id", "text", F.explode("m").alias("x"))
    new = F.try_element_at(F.col("x.replacements"), F.lit(1))["value"]
    before = F.substr("text", F.col("x.offset") + 1, F.col("x.length"))
    return e.filter((F.col("x.offset") >= 0) & (F.col("x.length") > 0) & (F.length(new) > 0)).select(
        "doc_id", F.col("x.offset").alias("start"), before.alias("before"), new.alias("after"), F.concat(F.lit("languagetool-"), F.lower("x.rule.category.id")).alias("category")
    )


def second_opinion(after: Column, opinion: Column) -> Column:
    """agree, disagree or unknown: whether the second opinion holds the edit, blanks and the case of the first letter apart."""
    norm = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    a, o = norm(after), norm(opinion)
    swapped = F.concat(F.when(F.upper(F.left(a, F.lit(1))) == F.left(a, F.lit(1)), F.lower(F.left(a, F.lit(1)))).otherwise(F.upper(F.left(a, F.lit(1)))), F.substring(a, 2, 1_000_000))
    return F.when(opinion.isNull() | (F.trim(opinion) == ""), "unknown").when(F.contains(o, a) | F.contains(o, swapped), "agree").otherwise("disagree")
