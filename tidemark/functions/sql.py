"""The scalar functions under names of their own in SQL: ``register(spark)``, then ``select tm_fold_yo(text) from ...``.

They are SQL functions, inlined by the optimizer: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "tm_fold_yo": ("c string", "string", "translate(lower(c), 'ё', 'е')"),
    "tm_only_yo": ("a string, b string", "boolean", "a <> b and translate(lower(a), 'ё', 'е') = translate(lower(b), 'ё', 'е')"),
    "tm_one_blank": ("c string", "string", r"trim(regexp_replace(c, r'[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' '))"),
    "tm_soft_breaks": ("c string", "string", r"regexp_replace(c, r'(?<!\n)\n(?!\n)', ' ')"),
    "tm_quotes": ("c string", "string", "regexp_replace(c, r'[^«»\"„“”]', '')"),
    "tm_words": ("c string", "array<string>", "regexp_extract_all(translate(lower(c), 'ё', 'е'), r'[a-zа-я0-9]+', 0)"),
    "tm_valid_word": ("c string", "boolean", r"""coalesce(length(trim(c)) between 2 and 64 and not rlike(trim(c), r'[\s\x00-\x1f"\x27«»()\[\]{}<>]'), false)"""),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session and gives their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return sorted(FUNCTIONS)
