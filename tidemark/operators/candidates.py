"""Edit candidates: stages, vote, ordered decision, application, rendering. Candidates are rows.

Candidate schema: doc_id, stage_ord, seq, start (0-based code points, null if unknown), before, after, confidence, category.
Order is carried by (stage_ord, seq); nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Weight of a category by its first matching prefix, in order.
WEIGHTS = (("rule-", 1.0), ("dict-spell", 0.94), ("languagetool-", 0.90), ("russian-gec", 0.86), ("sage", 0.80), ("draft", 0.66))
OTHER_WEIGHT, EXTRA_SOURCE, SOLO_PENALTY, MIN_VOTES = 0.5, 0.10, 0.25, 2
MIN_CONFIDENCE, MAX_BEFORE = 0.55, 120
# Categories of texts made by models; of those, the ones that may not split, merge or inflect words on their own word;
# and the rules that may touch protected words.
GENERATIVE = ("sage", "russian-gec", "draft", "model", "surface", "unknown", "diff")
UNPROVEN = ("model", "unknown", "languagetool", "surface")
MAY_TOUCH = ("rule-rag-terminology", "rule-legal-repetition")


def weight(category: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for prefix, w in reversed(WEIGHTS):
        out = F.when(F.startswith(category, F.lit(prefix)), F.lit(w)).otherwise(out)
    return out


def deterministic(category: Column) -> Column:
    return category.rlike("^(rule-|dict-spell|languagetool-)")


def starts_with(category: Column, prefixes: tuple[str, ...]) -> Column:
    return category.rlike("^(" + "|".join(prefixes) + ")")


def _pairs(before: Column, after: Column) -> Column:
    """array<struct<a, b>> of the words that differ, position by position; null if the numbers of words differ."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"[{T.LETTER}]+"), F.lit(0))
    both = F.filter(F.zip_with(w(before), w(after), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"])
    return F.when(F.size(w(before)) == F.size(w(after)), both)


def inflections(edits: DataFrame, lexicon: DataFrame, same_pos: bool = False) -> DataFrame:
    """Distinct (before, after) of edits in which some word is exchanged for another form of its lemma.

    Words meet the lexicon by two equi-joins on forms; only distinct pairs of words take part.
    """
    e = edits.select("before", "after").distinct().select("before", "after", F.explode(_pairs(F.col("before"), F.col("after"))).alias("p")).select("before", "after", "p.a", "p.b")
    keys = ["lemma", "pos"] if same_pos else ["lemma"]
    forms = lexicon.select(F.lower("form").alias("form"), *keys).distinct()
    words = e.select("a", "b").distinct()
    hit = words.join(forms.withColumnRenamed("form", "a"), "a").join(forms.withColumnRenamed("form", "b"), ["b", *keys]).select("a", "b").distinct()
    return e.join(hit, ["a", "b"], "left_semi").select("before", "after").distinct()


def merge(candidates: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Votes: candidates of one (doc, start, before, after) become one row.

    sources: sorted distinct categories; confidence: the best weight plus a bonus for each further source, less a penalty where
    a lone source is no deterministic one and the edit inflects a word (without a lexicon none is known to). One pass over all
    stages, hence associative.
    """
    c = candidates.withColumn("w", weight(F.col("category"))).withColumn("ord", F.col("stage_ord") * F.lit(1_000_000) + F.col("seq"))
    g = c.groupBy("doc_id", "start", "before", "after").agg(
        F.max("w").alias("w"),
        F.max_by("category", F.struct("w", -F.col("ord"))).alias("category"),
        F.array_sort(F.collect_set("category")).alias("sources"),
        F.bool_or(deterministic(F.col("category"))).alias("safe"),
        F.min("ord").alias("ord"),
    )
    n = F.size("sources")
    raised = F.least(F.col("w") + F.lit(EXTRA_SOURCE) * (n - 1), F.lit(1.0))
    lone = ~F.col("safe") & (n < MIN_VOTES)
    if lexicon is None:
        score = raised
    else:
        inflects = inflections(g.filter(lone), lexicon).withColumn("inflects", F.lit(True))
        g = g.join(inflects, ["before", "after"], "left")
        score = raised - F.when(lone & F.col("inflects"), F.lit(SOLO_PENALTY)).otherwise(F.lit(0.0))
    return g.select("doc_id", "start", "before", "after", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 4).alias("confidence"), "category", "sources", "ord")


def resolve_span(text: Column, start: Column, before: Column) -> Column:
    """The offset of an edit: the given one if the text stands there, else the only occurrence, else null."""
    n = F.length(before)
    times = (F.length(text) - F.length(F.replace(text, before, F.lit("")))) / n
    return F.when((start >= 0) & (F.substr(text, start + 1, n) == before), start).when((n > 0) & (times == 1), F.instr(text, before) - 1)


def reject_reason(before: Column, after: Column, confidence: Column, category: Column, span: Column, protected: Column | None = None, unproven: Column | None = None, guard: Column | None = None) -> Column:
    """The first reason against an edit, in fixed order; null if there is none.

    unproven: whether an edit only inflects a word; guard: the reason of the guard of generative edits (see guards.py).
    """
    compound = lambda c: F.regexp_extract_all(c, F.lit("[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)+"), F.lit(0))
    word = "[А-Яа-яЁёA-Za-z]+"
    split = (before.rlike(f"^{word}$") & after.rlike(f"^{word} +{word}$")) | (before.rlike(f"^{word} +{word}$") & after.rlike(f"^{word}$"))
    out = F.when(F.coalesce(before, F.lit("")) == F.coalesce(after, F.lit("")), "no change")
    out = out.when((confidence < MIN_CONFIDENCE) | (F.length(before) > MAX_BEFORE), "weak or long")
    out = out.when(T.only_yo_differs(before, after), "only yo")
    if protected is not None:
        out = out.when(protected & ~starts_with(category, MAY_TOUCH), "protected word")
    out = out.when((F.size(compound(before)) > 0) & (F.concat_ws("|", compound(before)) != F.concat_ws("|", compound(after))), "compound changed")
    if unproven is not None:
        out = out.when(unproven & starts_with(category, UNPROVEN), "unproven inflection")
    out = out.when(split & starts_with(category, UNPROVEN), "words split or merged")
    if guard is not None:
        out = out.when(guard.isNotNull(), guard)
    return out.when(span.isNull(), "no span")


def choose(ordered: Column) -> Column:
    """Greedy choice over an ordered array of structs with s, e (half open): those that overlap no earlier choice."""
    empty = F.filter(ordered, lambda x: F.lit(False))
    free = lambda acc, x: ~F.exists(acc, lambda a: (a["s"] < x["e"]) & (x["s"] < a["e"]))
    return F.aggregate(ordered, empty, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def decide(merged: DataFrame, texts: DataFrame, cap: int | None = None, protected: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """merged candidates, texts (doc_id, text) -> (doc_id, text, edits array<struct<s,e,before,after,confidence,category>>, dropped).

    Every text comes back, in order of start within edits. Candidates meet their text in one join on doc_id; the choice is a
    fold over the candidates of one document, strongest first, longest first, then first come. cap: the most edits of a document,
    as one request may ask for; ``dropped`` tells how many more were chosen. Without a cap all are made.
    """
    c = merged.join(texts.select("doc_id", "text"), "doc_id")
    if protected is not None:
        words = protected.select(F.lower("word").alias("pword")).distinct()
        tokens = c.select("doc_id", "ord", F.explode(T.words(F.col("before"))).alias("pword"))
        hit = tokens.join(words, "pword", "left_semi").select("doc_id", "ord").distinct().withColumn("protected", F.lit(True))
        c = c.join(hit, ["doc_id", "ord"], "left")
        guard = F.coalesce("protected", F.lit(False))
    else:
        guard = None
    c = c.withColumn("span", resolve_span(F.col("text"), F.col("start"), F.col("before")))
    unproven = None
    if lexicon is not None:
        one_word = c.filter(F.col("before").rlike("^[А-Яа-яЁё-]+$") & F.col("after").rlike("^[А-Яа-яЁё-]+$") & starts_with(F.col("category"), UNPROVEN))
        c = c.join(inflections(one_word, lexicon, same_pos=True).withColumn("unproven", F.lit(True)), ["before", "after"], "left")
        unproven = F.coalesce("unproven", F.lit(False))
    reason = reject_reason(F.col("before"), F.col("after"), F.col("confidence"), F.col("category"), F.col("span"), guard, unproven)
    ok = c.filter(reason.isNull())
    key = F.struct(
        (-F.col("confidence")).alias("c"),
        (-F.length("before")).alias("l"),
        F.col("ord"),
        F.col("span").cast("int").alias("s"),
        (F.col("span") + F.length("before")).cast("int").alias("e"),
        "before",
        "after",
        "confidence",
        "category",
    )
    # A document has few candidates: the array is bounded by its length.
    picked = ok.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("cand")).select("doc_id", choose(F.col("cand")).alias("chosen"))
    made = F.col("chosen") if cap is None else F.slice("chosen", 1, cap)
    edits = F.array_sort(F.transform(made, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["before"].alias("before"), x["after"].alias("after"), x["confidence"].alias("confidence"), x["category"].alias("category"))))
    out = texts.select("doc_id", "text").join(picked, "doc_id", "left")
    return out.select("doc_id", "text", F.coalesce(edits, F.from_json(F.lit("[]"), "array<struct<s:int,e:int,before:string,after:string,confidence:double,category:string>>")).alias("edits"), F.coalesce(F.size("chosen") - F.size(made), F.lit(0)).alias("dropped"))


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with disjoint edits, ordered by start: kept gaps and replacements are concatenated, each character copied once."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["parts"], F.array(F.substr(text, a["at"] + 1, x["s"] - a["at"]), x["after"])).alias("parts"))
    done = lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1, F.length(text)))
    return F.aggregate(edits, start, step, done)


NO_ERRORS = "Ошибок не найдено."


def render(text: Column, edits: Column) -> Column:
    """The protocol block: the corrected text, then the numbered changes, or one fixed line where there are none."""
    lines = F.transform(edits, lambda x, i: T.change_line(i + 1, x["before"], x["after"], T.reason_for(x["before"], x["after"], x["category"]), x["category"]))
    body = F.when(F.size(edits) == 0, F.lit(NO_ERRORS)).otherwise(F.array_join(lines, "\n"))
    return F.concat(F.lit("===CORRECTED===\n"), text, F.lit("\n===CHANGES===\n"), body, F.lit("\n===END==="))


def parse_corrected(block: Column) -> Column:
    return F.substring_index(F.substring_index(block, "\n===CHANGES===\n", 1), "===CORRECTED===\n", -1)


def parse_changes(block: Column) -> Column:
    """array<struct<n, before, after>> of the numbered lines of a protocol block."""
    body = F.substring_index(F.substring_index(block, "\n===CHANGES===\n", -1), "\n===END===", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\d+\. «"))
    pat = r"(?s)^(\d+)\. «(.*?)» → «(.*?)» — \["
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pat, 1).cast("int").alias("n"), F.regexp_extract(x, pat, 2).alias("before"), F.regexp_extract(x, pat, 3).alias("after")))


# ---- stages --------------------------------------------------------------------------------------------------------------

# Misread words of scanned pages and their reading.
MISREAD = {"tbe": "the", "fhe": "the", "thc": "the", "witb": "with", "foir": "fair", "ond": "and", "anf": "auf", "trofz": "trotz", "dcr": "der", "lc": "le", "dcs": "des", "несмогря": "несмотря", "буpи": "бури"}


def _words(text: Column) -> Column:
    return F.split(F.translate(text, "\n", " "), " ")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, f"[^{T.LETTER}]+$", "")


def stage_misread(word: Column, prev: Column) -> tuple[Column, Column, Column]:
    """Whole words of a fixed table: (applies, before, after)."""
    mapping = F.create_map(*[F.lit(x) for kv in MISREAD.items() for x in kv])
    core = _core(word)
    return F.lower(core).isin(*MISREAD), core, T.case_like(F.try_element_at(mapping, F.lower(core)), core)


def stage_full_stops(word: Column, prev: Column) -> tuple[Column, Column, Column]:
    """Two full stops where one is meant."""
    return word.rlike(rf"[{T.LETTER}0-9]\.\.$"), word, F.left(word, F.length(word) - 1)


def stage_commas(word: Column, prev: Column) -> tuple[Column, Column, Column]:
    """A comma without a blank behind it."""
    return word.rlike(rf"^[{T.LETTER}]+,[{T.LETTER}]+$"), word, F.replace(word, F.lit(","), F.lit(", "))


def stage_repeats(word: Column, prev: Column) -> tuple[Column, Column, Column]:
    """A word of four letters and more that stands twice in a row; the second, and the blank before it, go."""
    return word.rlike(rf"^[{T.LETTER}]{{4,}}$") & (F.lower(word) == F.lower(prev)), F.concat(prev, F.lit(" "), word), prev


#: Stages of one word and the word before it: order, category, confidence, whether the edit starts at the word before.
WORD_STAGES = (
    (1, "rule-misread", 1.0, False, stage_misread),
    (2, "rule-punctuation", 0.98, False, stage_full_stops),
    (2, "rule-punctuation", 0.98, False, stage_commas),
    (3, "rule-repeat", 0.9, True, stage_repeats),
)


def word_candidates(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> candidates of all word stages.

    One narrow pass: words, neighbours and rules are looked at inside one array, only hits are exploded, and only for hits
    is an offset summed up. No shuffle.
    """
    w = texts.select("doc_id", _words(F.col("text")).alias("w"))
    any_rule = None
    for *_, rule in WORD_STAGES:
        test = lambda x, p, rule=rule: F.coalesce(rule(x, p)[0], F.lit(False))
        any_rule = test if any_rule is None else (lambda x, p, a=any_rule, b=test: a(x, p) | b(x, p))
    pairs = F.transform("w", lambda x, i: F.struct(i.alias("idx"), x.alias("word"), F.when(i > 0, F.try_element_at("w", i)).alias("prev")))
    hits = w.select("doc_id", "w", F.explode(F.filter(pairs, lambda t: any_rule(t["word"], t["prev"]))).alias("t"))
    start = F.col("t.idx") + F.aggregate(F.slice("w", F.lit(1), F.col("t.idx")), F.lit(0), lambda a, x: a + F.length(x))
    word, prev = F.col("t.word"), F.col("t.prev")
    made = []
    for order, category, confidence, from_prev, rule in WORD_STAGES:
        applies, before, after = rule(word, prev)
        at = start - (F.length(prev) + 1) if from_prev else start
        row = F.struct(
            F.lit(order).alias("stage_ord"), F.col("t.idx").alias("seq"), at.cast("int").alias("start"), before.alias("before"), after.alias("after"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category")
        )
        made.append(F.when(F.coalesce(applies, F.lit(False)), row))
    return hits.select("doc_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("doc_id", "c.*")


def correct(texts: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_changes, dropped, corrected): all stages, vote, decision, application."""
    d = decide(merge(word_candidates(texts)), texts, cap)
    return d.select("doc_id", F.size("edits").alias("n_changes"), "dropped", apply_edits(F.col("text"), F.col("edits")).alias("corrected"))
