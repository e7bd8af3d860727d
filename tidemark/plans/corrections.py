"""Queries of the correction pipeline: stages, vote, decision, application, evaluation, spans, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import candidates as C
from tidemark.operators import diff, evaluate, lexicon, spans
from tidemark.plans.base import Registry, table

QUERIES = Registry()
L = T.LETTER


def _pages(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).filter("text is not null")


def _cases(spark, d):
    return table(spark, d, "eval_cases").dropDuplicates(["id"])


_TABLE = ", ".join(f"('{a}', '{b}')" for a, b in C.MISREAD.items())
#: Tokens of pages, the candidates of the three stages and their vote, in SQL.
_STAGES = f"""
    with page as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id),
    raw as (select doc_id, unnest(string_split(translate(text, chr(10), ' '), ' ')) as word, generate_subscripts(string_split(translate(text, chr(10), ' '), ' '), 1) - 1 as idx from page),
    tok as (select doc_id, idx, word, sum(length(word) + 1) over w - length(word) - 1 as start, lag(word) over w as prev from raw window w as (partition by doc_id order by idx)),
    tok2 as (select *, lag(start) over (partition by doc_id order by idx) as prev_start from tok),
    fix(bad, good) as (values {_TABLE}),
    cand as (
        select t.doc_id, 1 as stage_ord, t.idx as seq, t.start, regexp_replace(t.word, '[^{L}]+$', '') as before, f.good as good, 'rule-misread' as category
        from tok2 t join fix f on lower(regexp_replace(t.word, '[^{L}]+$', '')) = f.bad
        union all select doc_id, 2, idx, start, word, left(word, length(word) - 1), 'rule-punctuation' from tok2 where regexp_matches(word, '[{L}0-9]\\.\\.$')
        union all select doc_id, 2, idx, start, word, replace(word, ',', ', '), 'rule-punctuation' from tok2 where regexp_matches(word, '^[{L}]+,[{L}]+$')
        union all select doc_id, 3, idx, prev_start, prev || ' ' || word, prev, 'rule-repeat' from tok2 where regexp_matches(word, '^[{L}]{{4,}}$') and lower(word) = lower(prev)
    ),
    cased as (select doc_id, stage_ord, seq, start, before, category, case when category <> 'rule-misread' then good
        when length(before) > 1 and upper(before) = before and lower(before) <> before then upper(good)
        when upper(left(before, 1)) = left(before, 1) and lower(left(before, 1)) <> left(before, 1) then upper(left(good, 1)) || substr(good, 2) else good end as after from cand),
    voted as (
        select doc_id, start, before, after, round(least(1.0::double + 0.10::double * (count(distinct category) - 1), 1.0::double), 4) as confidence,
            arg_min(category, stage_ord * 1000000 + seq) as category, min(stage_ord * 1000000 + seq) as ord
        from cased group by doc_id, start, before, after
    )"""


@QUERIES.add(
    _STAGES
    + f""",
    ok as (
        select v.*, p.text from voted v join page p using (doc_id)
        where v.before <> v.after and length(v.before) <= 120
            and not (v.before <> v.after and translate(lower(v.before), 'ё', 'е') = translate(lower(v.after), 'ё', 'е'))
            and (array_to_string(regexp_extract_all(v.before, '[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)+'), '|') in ('', array_to_string(regexp_extract_all(v.after, '[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)+'), '|')))
            and substr(p.text, cast(v.start + 1 as bigint), length(v.before)) = v.before
    ),
    lst as (select doc_id, any_value(text) as text, list(struct_pack(s := cast(start as integer), e := cast(start + length(before) as integer), after := after) order by -confidence, -length(before), ord) as c from ok group by doc_id),
    picked as (select doc_id, text, list_sort(list_reduce(list_transform(c, lambda y: [y]), lambda acc, x: case when len(list_filter(acc, lambda a: a.s < x[1].e and x[1].s < a.e)) = 0 then list_concat(acc, x) else acc end, c[1:0])) as ed from lst),
    cut as (select doc_id, text, ed, list_prepend(0, list_transform(ed, lambda x: x.e)) as tails from picked),
    done as (select doc_id, len(ed) as n,
        array_to_string(list_transform(range(1, len(ed) + 1), lambda i: substr(text, tails[i] + 1, ed[i].s - tails[i]) || ed[i].after), '') || substr(text, tails[len(tails)] + 1) as corrected from cut)
    select p.doc_id, cast(coalesce(d.n, 0) as integer) as n_changes, 0 as dropped, coalesce(d.corrected, p.text) as corrected from page p left join done d using (doc_id)"""
)
def correct_documents(spark, d):
    return C.correct(_pages(spark, d))


@QUERIES.add(_STAGES + " select doc_id, cast(start as integer) as start, before, after, confidence, category from voted")
def merge_votes(spark, d):
    m = C.merge(C.word_candidates(_pages(spark, d)))
    return m.select("doc_id", "start", "before", "after", "confidence", "category")


@QUERIES.add(
    """with page as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id),
    c as (select doc_id, text, (substr(text, 1, 8)) as head, substr(text, 41, 12) as mid from page where length(text) >= 60),
    x as (select doc_id, text, 'head' as kind, 0 as start, head as before from c union all select doc_id, text, 'wrong', 3, mid from c union all select doc_id, text, 'none', null, mid || '~' from c),
    n as (select *, (length(text) - length(replace(text, before, ''))) / length(before) as times from x)
    select doc_id, kind, cast(case when start is not null and substr(text, start + 1, length(before)) = before then start when times = 1 then instr(text, before) - 1 end as integer) as span from n"""
)
def span_resolution(spark, d):
    c = _pages(spark, d).filter(F.length("text") >= 60)
    head, mid = F.substring("text", 1, 8), F.substring("text", 41, 12)
    rows = c.select("doc_id", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).cast("int").alias("start"), b.alias("before")) for k, s, b in (("head", 0, head), ("wrong", 3, mid), ("none", None, F.concat(mid, F.lit("~"))))))).alias("x"))
    return rows.select("doc_id", "x.kind", C.resolve_span(F.col("text"), F.col("x.start"), F.col("x.before")).cast("int").alias("span"))


@QUERIES.add(
    """with e as (select event_id // 200 as grp, event_id, cast(trunc(value) as integer) % 97 as s, cast(trunc(value) as integer) % 97 + 1 + event_id % 9 as e from events),
    l as (select grp, list(struct_pack(s := cast(s as integer), e := cast(e as integer), id := event_id) order by -(e - s), s, event_id) as c from e group by grp),
    p as (select grp, list_reduce(list_transform(c, lambda y: [y]), lambda acc, x: case when len(acc) < 12 and len(list_filter(acc, lambda a: a.s < x[1].e and x[1].s < a.e)) = 0 then list_concat(acc, x) else acc end, c[1:0]) as got from l)
    select grp, cast(len(got) as integer) as chosen, list_sum(list_transform(got, lambda a: a.id))::bigint as ids from p"""
)
def decide_greedy(spark, d):
    """The ordered fold over groups of at most 200 intervals, as a document has candidates."""
    s = F.col("value").cast("int") % 97
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 200).alias("grp"), "event_id", s.alias("s"), (s + 1 + F.col("event_id") % 9).cast("int").alias("e"))
    key = F.struct((F.col("s") - F.col("e")).alias("o"), "s", F.col("event_id").alias("id"), "e")
    c = e.groupBy("grp").agg(F.array_sort(F.collect_list(key)).alias("c")).select("grp", F.slice(C.choose(F.col("c")), 1, 12).alias("got"))
    return c.select("grp", F.size("got").alias("chosen"), F.aggregate("got", F.lit(0).cast("long"), lambda a, x: a + x["id"]).alias("ids"))


@QUERIES.add(
    """with c as (select id, any_value(text) as text, any_value(coalesce(expected, text)) as expected, any_value(kind) as kind from eval_cases where text is not null group by id)
    select id, expected as corrected, true as same from c"""
)
def render_parse_roundtrip(spark, d):
    """Cases rendered as protocol blocks and parsed again: text and number of changes survive."""
    c = _cases(spark, d).filter("text is not null").select("id", F.coalesce("expected", "text").alias("expected"), "text")
    one = F.struct(F.lit(0).alias("s"), F.length("text").alias("e"), F.col("text").alias("before"), F.col("expected").alias("after"), F.lit(1.0).alias("confidence"), F.lit("rule-case").alias("category"))
    edits = F.filter(F.array(one), lambda x: x["before"] != x["after"])
    b = c.withColumn("n", F.size(edits)).withColumn("block", C.render(C.apply_edits(F.col("text"), edits), edits))
    return b.select("id", C.parse_corrected(F.col("block")).alias("corrected"), (F.size(C.parse_changes(F.col("block"))) == F.col("n")).alias("same"))


@QUERIES.add(
    """with c as (select id, any_value(text) as text, any_value(coalesce(expected, text)) as expected from eval_cases where text is not null group by id),
    w as (select id, text, expected, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as a, list_filter(regexp_split_to_array(expected, '\\s+'), lambda x: x <> '') as b from c),
    s as (select id, unnest(a) as before, unnest(b) as after, generate_subscripts(a, 1) - 1 as pos from w where len(a) = len(b))
    select id as case_id, cast(pos as integer) as pos, before, after from s where before <> after
    union all select id, -1, text, expected from w where len(a) <> len(b) and text <> expected"""
)
def positional_word_diff(spark, d):
    c = _cases(spark, d).filter("text is not null")
    return evaluate.edit_rows(c.select(F.col("id").alias("case_id"), F.col("text").alias("source"), F.coalesce("expected", "text").alias("target")))


def _spelling(spark, d):
    """The words of the cases, and the fixes of the spell-check, whose dictionary is what stands often in clean cases and chunks."""
    c = _cases(spark, d).filter("text is not null")
    words = lambda df: df.select(F.explode(lexicon.spelled_words(F.col("text"))).alias("form"))
    known = words(c.filter("kind = 'clean'")).union(words(table(spark, d, "rag_chunks"))).groupBy("form").agg(F.count("*").alias("n")).filter("n >= 5")
    toks = c.select(F.col("id").alias("case_id"), F.explode(F.array_distinct(lexicon.spelled_words(F.col("text")))).alias("form"))
    fixes = lexicon.spell_unique(toks.select("form"), known.select("form"))
    return toks, fixes


def _spell_rows(spark, d):
    """Eval cases with what the dictionary spell-check makes of them."""
    c = _cases(spark, d).filter("text is not null")
    toks, fixes = _spelling(spark, d)
    sub = toks.join(fixes, "form").groupBy("case_id").agg(F.map_from_entries(F.collect_set(F.struct("form", "fixed"))).alias("m"))
    return c.withColumnRenamed("id", "case_id").join(sub, "case_id", "left").withColumn("produced", lexicon.substitute(F.col("text"), F.col("m")))


# Edits are counted over bytes there, so each letter becomes one byte first, by script.
_CYR_BYTES = "'абвгдежзийклмнопрстуфхцчшщъыьэюяё', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456'"
_LATIN_BYTES = "'" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)])) + "', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ01234'"
_BYTES = f"case when regexp_matches(f, '[а-яё]') then translate(f, {_CYR_BYTES}) else '#' || translate(f, {_LATIN_BYTES}) end"


@QUERIES.add(
    rf"""with c as (select id, any_value(text) as text, any_value(kind) as kind from eval_cases where text is not null group by id),
    w as (select kind, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+'), lambda w: regexp_full_match(w, '[а-яё]+|[a-zà-öø-ÿ]+'))) as f from (select kind, text from c union all select 'chunk', text from rag_chunks)),
    known as (select f from w where kind in ('clean', 'chunk') group by f having count(*) >= 5),
    asked as (select distinct f, {_BYTES} as b from w where kind <> 'chunk' and length(f) between 5 and 24 and f not in (select f from known)),
    base as (select f, {_BYTES} as b from known where length(f) between 4 and 25),
    pairs as (select a.f as form, k.f as fixed from asked a, base k where abs(length(a.b) - length(k.b)) <= 1 and damerau_levenshtein(a.b, k.b) = 1 and translate(a.f, 'ё', 'е') <> translate(k.f, 'ё', 'е'))
    select form, min(fixed) as fixed from pairs group by form having count(*) = 1"""
)
def spell_unique(spark, d):
    """Unknown words of the cases with exactly one known word at one edit."""
    return _spelling(spark, d)[1]


@QUERIES.add(None)
def quality_report(spark, d):
    return evaluate.quality(_spell_rows(spark, d).select("case_id", "kind", "text", "expected", "produced"))


_BENCH = """
    with c as (select *, case when id like '%7' then replace(text, ' ', '  ') when id like '%3' then text || ' ' || coalesce(must_not_contain[1], 'x') else text end as produced from bench_cases),
    r as (select *, len(list_filter(coalesce(must_contain, []), lambda m: not contains(produced, m))) as missing, len(list_filter(coalesce(must_not_contain, []), lambda m: contains(produced, m))) as forbidden,
        length(text) - length(replace(text, chr(10), '')) = length(produced) - length(replace(produced, chr(10), '')) as layout from c),
    p as (select *, missing = 0 and forbidden = 0 and layout and (not coalesce(clean, false) or produced = text) as passed, length(text)::double as latency from r)"""


def _bench(spark, d):
    c = table(spark, d, "bench_cases")
    produced = F.when(F.col("id").endswith("7"), F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("id").endswith("3"), F.concat("text", F.lit(" "), F.coalesce(F.try_element_at("must_not_contain", F.lit(1)), F.lit("x")))).otherwise(F.col("text"))
    return evaluate.case_checks(c.withColumn("produced", produced)).withColumn("latency", F.length("text").cast("double"))


@QUERIES.add(_BENCH + " select id, cast(missing as integer) as missing, cast(forbidden as integer) as forbidden, layout, passed from p")
def benchmark_checks(spark, d):
    return _bench(spark, d).select("id", "missing", "forbidden", "layout", "passed")


@QUERIES.add(
    _BENCH
    + """, q as (select passed, latency, coalesce(category, 'unspecified') as category, coalesce(source, 'unspecified') as source from p)
    select coalesce(category, '*') as category, coalesce(source, '*') as source, count(*) as cases, count(*) filter (where passed) as passes,
        round(count(*) filter (where passed) / count(*)::double, 4) as rate, round(avg(latency), 2) as mean_latency
    from q group by grouping sets ((), (category), (source))"""
)
def benchmark_rollup(spark, d):
    return evaluate.rollup(_bench(spark, d), "category", "source")


@QUERIES.add(
    """with b as (select id, text, must_contain, must_not_contain from bench_cases
        union all select 'again-' || source, text, must_contain, must_not_contain from bench_cases union all select 'blank-' || id, ' ', must_contain, must_not_contain from bench_cases
        union all select 'both-' || id, text, list_concat(coalesce(must_contain, []), ['x']), list_concat(coalesce(must_not_contain, []), ['x']) from bench_cases)
    select id, 'id not unique' as fault from b group by id having count(*) > 1
    union all select id, 'no text' from b where coalesce(trim(text), '') = ''
    union all select id, 'required and forbidden' from b where len(list_intersect(coalesce(must_contain, []), coalesce(must_not_contain, []))) > 0"""
)
def benchmark_constraints(spark, d):
    """Faults of the cases and of faulty copies: ids that are not unique, blank texts, phrases both required and forbidden."""
    b = table(spark, d, "bench_cases").select("id", "text", "must_contain", "must_not_contain", "source")
    x = lambda c: F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array(F.lit("x")))
    copies = (
        b.withColumn("id", F.concat(F.lit("again-"), "source")),
        b.withColumns({"id": F.concat(F.lit("blank-"), "id"), "text": F.lit(" ")}),
        b.withColumns({"id": F.concat(F.lit("both-"), "id"), "must_contain": x("must_contain"), "must_not_contain": x("must_not_contain")}),
    )
    for c in copies:
        b = b.unionByName(c)
    return evaluate.corpus_faults(b)


_SPANS = """
    with page as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id),
    ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from page),
    line as (select doc_id, k, line, sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1 as s from ln),
    dot as (select doc_id, unnest(string_split(text, '. ')) as part, generate_subscripts(string_split(text, '. '), 1) - 1 as j from page),
    sent as (select doc_id, j, sum(length(part) + 2) over (partition by doc_id order by j) - length(part) - 2 as s, part from dot)"""


def _line_spans(spark, d):
    return spans_of(_pages(spark, d), "\n", "k")


def spans_of(pages, sep: str, name: str):
    from pyspark.sql.window import Window

    n = len(sep)
    t = pages.select("doc_id", F.posexplode(F.split("text", r"\Q" + sep + r"\E")).alias(name, "part"))
    s = F.sum(F.length("part") + n).over(Window.partitionBy("doc_id").orderBy(name)) - F.length("part") - n
    return t.withColumn("s", s).withColumn("e", F.col("s") + F.length("part")).select("doc_id", name, "s", "e")


@QUERIES.add(_SPANS + " select a.doc_id, a.k, count(*) as n from line a join sent b on a.doc_id = b.doc_id and a.s < b.s + length(b.part) and b.s < a.s + length(a.line) group by a.doc_id, a.k")
def interval_overlap_join(spark, d):
    p = _pages(spark, d)
    return spans.overlapping(spans_of(p, "\n", "k"), spans_of(p, ". ", "j")).groupBy("doc_id", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@QUERIES.add(
    _SPANS
    + """, taint as (select doc_id, s, s + length(part) as e from sent where regexp_matches(part, '[0-9]'))
    select doc_id, k from line l where not exists (select 1 from taint t where t.doc_id = l.doc_id and t.s < l.s + length(l.line) and l.s < t.e)"""
)
def tainted_antijoin(spark, d):
    p = _pages(spark, d)
    sent = spans_of(p, ". ", "j").join(p, "doc_id").filter(F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")).rlike("[0-9]")).select("doc_id", "s", "e")
    return spans.without_overlap(spans_of(p, "\n", "k"), sent, ["doc_id", "k"]).select("doc_id", F.col("k").cast("long").alias("k"))


@QUERIES.add(
    """with page as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id),
    raw as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as idx from page),
    mark as (select doc_id, idx, word from raw where regexp_matches(word, '^[A-ZА-ЯЁ][a-zа-яё]+$')),
    point as (select doc_id, idx from raw where right(word, 1) = ',')
    select p.doc_id, p.idx, m.word as nearest, p.idx - m.idx as distance from point p asof left join mark m on p.doc_id = m.doc_id and p.idx > m.idx"""
)
def asof_nearest_left(spark, d):
    t = _pages(spark, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    points = t.filter(F.col("word").endswith(",")).select("doc_id", "p")
    marks = t.filter(F.col("word").rlike("^[A-ZА-ЯЁ][a-zа-яё]+$")).select("doc_id", "p", F.col("word").alias("value"))
    got = spans.nearest_left(points, marks)
    return got.select("doc_id", F.col("p").cast("long").alias("idx"), F.col("value").alias("nearest"), F.col("distance").cast("long").alias("distance"))


@QUERIES.add(
    """with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from (select doc_id, any_value(text) as text from documents where text is not null group by doc_id)),
    r as (select doc_id, k, sum(case when upper(line) = line and regexp_matches(line, '[A-ZА-ЯЁÀ-Ü]') then 1 else 0 end) over (partition by doc_id order by k) as run from raw)
    select doc_id, cast(run as bigint) as run, count(*) as lines from r group by doc_id, run"""
)
def clause_islands(spark, d):
    """Articles of a page: runs of lines between headings in capitals."""
    t = _pages(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    head = (F.upper("line") == F.col("line")) & F.col("line").rlike("[A-ZА-ЯЁÀ-Ü]")
    return spans.islands(t.withColumn("head", head), "doc_id", "k", "head").groupBy("doc_id", "run").agg(F.count("*").alias("lines"))


@QUERIES.add(None)
def token_diff_edits(spark, d):
    c = _cases(spark, d).filter("text is not null").select(F.col("id").alias("case_id"), F.col("text").alias("source"), F.coalesce("expected", "text").alias("target"))
    return diff.token_edits(c)


@QUERIES.add(None)
def rewrite_guard(spark, d):
    c = _cases(spark, d).filter("text is not null").select(F.col("id").alias("case_id"), F.col("text").alias("source"), F.coalesce("expected", "text").alias("target"))
    return diff.rewrite_guard(c)


@QUERIES.add(
    """with c as (select id, any_value(text) as text, any_value(coalesce(expected, text)) as produced from eval_cases where text is not null group by id),
    w as (select id, text, produced, list_distinct(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+'), lambda x: length(x) >= 3)) as a,
        list_distinct(list_filter(regexp_extract_all(translate(lower(produced), 'ё', 'е'), '[a-zа-я0-9]+'), lambda x: length(x) >= 3)) as b from c)
    select id, abs(length(produced) - length(text)) <= 0.35::double * greatest(length(text), 1) and (case when len(a) = 0 then 1.0::double else len(list_intersect(a, b)) / len(a)::double end) >= 0.6::double as similar from w"""
)
def similarity_guard(spark, d):
    c = _cases(spark, d).filter("text is not null")
    return c.select("id", T.similar_enough(F.col("text"), F.coalesce("expected", "text")).alias("similar"))


@QUERIES.add(
    f"""with page as (select id as doc_id, replace(any_value(text), 'архивная группа', 'плановая архивный группа') as text from rag_chunks where text is not null group by id),
    w as (select doc_id, regexp_extract_all(lower(text), '[{L}]+|[^{L}]+') as w from page), u as (select doc_id, w, unnest(range(3, len(w) - 1)) as i from w)
    select doc_id, cast(i - 1 as integer) as idx, 'архивный' as before, 'архивная' as after from u where w[i] = 'архивный' and w[i - 1] = ' ' and w[i + 1] = ' ' and w[i - 2] = 'плановая' and w[i + 2] = 'группа'"""
)
def noun_phrase_unification(spark, d):
    """Noun phrases of the lexicon with exactly one word that does not fit, over chunks in which such phrases are planted."""
    t = table(spark, d, "rag_chunks").select(F.col("id").alias("doc_id"), "text").filter("text is not null").dropDuplicates(["doc_id"])
    return lexicon.unify(t.withColumn("text", F.replace("text", F.lit("архивная группа"), F.lit("плановая архивный группа"))), lexicon.fixture(spark))
