"""Queries of protocol functions and safety rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import protocol as P
from tidemark.functions import text as T
from tidemark.operators import safety
from tidemark.plans.base import Registry, table
from tidemark.plans.corrections import spans_of

QUERIES = Registry()
W = f"[{T.LETTER}0-9_-]"
CASES = "(select id, any_value(text) as text, any_value(coalesce(expected, text)) as expected from eval_cases where text is not null group by id)"


def _cases(spark, d):
    return table(spark, d, "eval_cases").dropDuplicates(["id"]).filter("text is not null").select("id", "text", F.coalesce("expected", "text").alias("expected"))


@QUERIES.add(
    f"""with c as (select id, text, cast(length(text) // 3 as integer) as s, substr(text, cast(length(text) // 3 as integer) + 1, 4) as b from {CASES} c where length(text) >= 20),
    g as (select id, s, b, regexp_extract(left(text, s), '(?:{W}+\\s+)?{W}*$') as l, regexp_extract(substr(text, s + length(b) + 1), '^{W}*(?:\\s+{W}+)?') as r from c)
    select id, cast(s - length(l) as integer) as start, l || b || r as before from g"""
)
def word_context(spark, d):
    c = _cases(spark, d).filter(F.length("text") >= 20).withColumn("s", F.floor(F.length("text") / 3).cast("int"))
    g = P.grow(F.col("text"), F.col("s"), F.substr("text", F.col("s") + 1, F.lit(4)))
    return c.select("id", g["start"].alias("start"), g["before"].alias("before"))


@QUERIES.add(
    f"""with c as (select id, text, instr(text, ',') - 1 as s from {CASES} c where contains(text, ',')),
    g as (select id, s, regexp_extract(left(text, s), '{W}+\\s*$') as l, regexp_extract(substr(text, s + 2), '^\\s*{W}+') as r from c)
    select id, cast(case when length(l) > 0 then s - length(l) else s end as integer) as start, case when length(l) > 0 then l || ',' else ',' || r end as before, case when length(l) > 0 then rtrim(l, ' ') else ltrim(r, ' ') end as after
    from g where length(l) > 0 or length(r) > 0"""
)
def safe_deletion(spark, d):
    c = _cases(spark, d).filter(F.contains("text", F.lit(","))).withColumn("s", F.instr("text", ",") - 1)
    e = P.safe_deletion(F.col("text"), F.col("s"), F.lit(","), F.lit(""))
    return c.select("id", e.alias("e")).filter("e is not null").select("id", "e.start", "e.before", "e.after")


@QUERIES.add(
    """with l as (select doc_id, string_split(text, chr(10)) as x from (select doc_id, any_value(text) as text from documents where text is not null group by doc_id)),
    u as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as k from l),
    n as (select doc_id, k, case when length(line) > 40 then k || '. ' || line else line end as line from u),
    m as (select doc_id, k, line, regexp_matches(line, '^\\s*\\d+[.)]\\s') as item, sum(case when regexp_matches(line, '^\\s*\\d+[.)]\\s') then 1 else 0 end) over (partition by doc_id order by k) as i from n)
    select doc_id, md5(string_agg(case when item then regexp_extract(line, '^\\s*') || i || regexp_extract(line, '^\\s*\\d+([.)]\\s.*)$', 1) else line end, chr(10) order by k)) as renumbered_md5 from m group by doc_id"""
)
def renumber_items(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).filter("text is not null")
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.length(x) > 40, F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(x)), "\n")
    return t.select("doc_id", F.md5(P.renumber(numbered)).alias("renumbered_md5"))


@QUERIES.add(
    f"""with c as (select id, text, 'о' as a, 'и' as b from {CASES} c),
    x as (select id, a, b, case when instr(text, a) > 0 then left(text, instr(text, a) - 1) || 'O' || substr(text, instr(text, a) + 1) else text end as t from c),
    y as (select id, case when instr(t, a) > 0 then left(t, instr(t, a) - 1) || '' || substr(t, instr(t, a) + 1) else t end as t, b from x)
    select id, case when instr(t, b) > 0 then left(t, instr(t, b) - 1) || 'ии' || substr(t, instr(t, b) + 1) else t end as replaced from y"""
)
def sequential_replace(spark, d):
    pairs = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in (("о", "O"), ("о", ""), ("и", "ии"))))
    return _cases(spark, d).select("id", P.in_turn(F.col("text"), pairs).alias("replaced"))


@QUERIES.add(
    f"""with c as (select id, text, expected from {CASES} c)
    select id, (case when text <> expected and not regexp_matches(text, '(\\.\\.\\.|…)\\s*$') and not regexp_matches(expected, '(\\.\\.\\.|…)\\s*$') and translate(lower(text), 'ё', 'е') <> translate(lower(expected), 'ё', 'е')
        and not list_has_any(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+'), ['насоса']) then 1 else 0 end) as kept from c"""
)
def change_filters(spark, d):
    one = F.array(F.struct(F.col("text").alias("before"), F.col("expected").alias("after")))
    kept = P.keep_changes(one, F.col("text"), F.array(F.lit("насоса")))
    return _cases(spark, d).select("id", F.size(kept).alias("kept"))


_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP) + "]"


@QUERIES.add(
    f"""with c as (select id, text from bench_cases), p as (select id, list_concat(list_concat(
            list_filter(list_filter(regexp_extract_all(text, '[{T.LETTER}0-9]+'), lambda w: regexp_matches(w, '^[A-ZА-ЯЁ]{{2,12}}$')), lambda w: length(w) >= 2),
            list_transform(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-ZА-ЯЁ]{{2,12}}\\s+([^\\n.]{{3,160}})', 1), lambda x: regexp_replace(x, '\\s+', ' ', 'g'))),
            [array_to_string(list_slice(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[{T.LOWER}0-9]+'), lambda w: not list_contains({_STOP}, w) and length(w) > 2), 1, 12), ' ')]) as q from c),
    f as (select id, list_filter(list_transform(q, lambda x: trim(x, ' ,;:')), lambda x: length(x) > 1) as q from p)
    select id, array_to_string(list_slice(list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i), 1, 5), '|') as queries from f"""
)
def query_plan_terms(spark, d):
    return table(spark, d, "bench_cases").select("id", F.array_join(P.plan_queries(F.col("text")), "|").alias("queries"))


@QUERIES.add(
    f"""select id, len(list_filter(regexp_extract_all(text, '[{T.LETTER}0-9]+'), lambda w: regexp_matches(w, '^[A-ZА-ЯЁ]{{2,12}}$'))) > 0
        or regexp_matches(text, '(?i)регламент|приказ|инструкци|положени|норматив|согласно|в соответствии') or regexp_matches(text, '[«"“][^»"”]{{3,80}}[»"”]') as wanted from {CASES} c"""
)
def retrieval_trigger(spark, d):
    return _cases(spark, d).select("id", P.wants_retrieval(F.col("text")).alias("wanted"))


@QUERIES.add(
    f"""with c as (select id, text, expected from {CASES} c)
    select id, 3 as turns, 'system|user|user' as roles, length(text) as last_len from c where text = expected
    union all select id, 4, 'system|user|assistant|user', length(text) from c where text <> expected"""
)
def few_shot_messages(spark, d):
    ex = F.filter(F.array(F.struct(F.col("text").alias("wrong"), F.col("expected").alias("right"))), lambda e: F.lit(True))
    m = P.few_shot(ex, F.col("text"), "Исправьте ошибки.")
    shown = F.filter(m, lambda x: ~((x["role"] == "assistant") & (F.col("text") == F.col("expected"))))
    return _cases(spark, d).select("id", F.size(shown).alias("turns"), F.array_join(F.transform(shown, lambda x: x["role"]), "|").alias("roles"), F.length(F.element_at(m, -1)["content"]).cast("long").alias("last_len"))


@QUERIES.add(
    f"""with c as (select id, text as b, expected as a from {CASES} c where text <> expected),
    r as (select id, case when regexp_extract_all(b, '[0-9]+') <> regexp_extract_all(a, '[0-9]+') then 'digits'
        when list_filter(regexp_extract_all(b, '[{T.LETTER}0-9]+'), lambda w: regexp_matches(w, '^[A-ZА-ЯЁ]{{2,12}}$')) <> list_filter(regexp_extract_all(a, '[{T.LETTER}0-9]+'), lambda w: regexp_matches(w, '^[A-ZА-ЯЁ]{{2,12}}$')) then 'acronym'
        when regexp_replace(b, '[^«»"„“”]', '', 'g') <> regexp_replace(a, '[^«»"„“”]', '', 'g') then 'quotes'
        when regexp_replace(b, '[^;:!?()\\[\\]«»"—–-]', '', 'g') <> regexp_replace(a, '[^;:!?()\\[\\]«»"—–-]', '', 'g') then 'delimiters'
        when len(regexp_extract_all(translate(lower(b), 'ё', 'е'), '[{T.LOWER}0-9]+')) <> len(regexp_extract_all(translate(lower(a), 'ё', 'е'), '[{T.LOWER}0-9]+')) then 'words'
        when len(list_filter(range(1, len(regexp_extract_all(translate(lower(a), 'ё', 'е'), '[{T.LOWER}0-9]+'))), lambda i: regexp_extract_all(translate(lower(a), 'ё', 'е'), '[{T.LOWER}0-9]+')[i] = regexp_extract_all(translate(lower(a), 'ё', 'е'), '[{T.LOWER}0-9]+')[i + 1])) > 0 then 'repetition'
        else 'solo draft' end as reason from c)
    select reason, count(*) as n from r group by reason"""
)
def safety_reasons(spark, d):
    c = _cases(spark, d).filter("text <> expected")
    r = safety.reason(F.col("text"), F.col("expected"), F.lit("draft"), F.lit(True))
    return c.select(r.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@QUERIES.add(
    """with page as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id),
    u as (select doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(19\\d\\d|20\\d\\d|2100)\\s+(?:год(?:а|у|ом|е)?|г\\.)', 1)) as y from page)
    select doc_id, cast(y as integer) as year from u"""
)
def year_phrases(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).filter("text is not null")
    return safety.year_phrases(t)


@QUERIES.add(
    f"""with c as (select id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '[{T.LOWER}0-9]+') as w from {CASES} c), u as (select id, unnest(w) as word, generate_subscripts(w, 1) - 1 as idx from c)
    select id as doc_id, cast(idx as integer) as idx, word, lag(word) over w as prev1, lag(word, 2) over w as prev2, lead(word) over w as next1, lead(word, 2) over w as next2 from u window w as (partition by id order by idx)"""
)
def neighbour_words(spark, d):
    return safety.neighbours(_cases(spark, d).select(F.col("id").alias("doc_id"), "text"))


@QUERIES.add(
    f"""with c as (select id as doc_id, text from {CASES} c),
    wr as (select doc_id, unnest(string_split(text, ' ')) as part, generate_subscripts(string_split(text, ' '), 1) - 1 as k from c),
    w as (select doc_id, k, sum(length(part) + 1) over (partition by doc_id order by k) - length(part) - 1 as s, length(part) as n from wr),
    sr as (select doc_id, unnest(string_split(text, '. ')) as part, generate_subscripts(string_split(text, '. '), 1) - 1 as j from c),
    se as (select doc_id, sum(length(part) + 2) over (partition by doc_id order by j) - length(part) - 2 as s, length(part) as n from sr),
    e as (select doc_id, k as seq, s, s + n as e, case k % 3 when 0 then 'draft' when 1 then 'russian-gec' else 'sage' end as category, case when k % 7 = 3 then 'digits' end as reason from w where n > 0)
    select doc_id, cast(seq as integer) as seq, s, e, category, reason from e where reason is null and not exists (
        select 1 from e b join se x on x.doc_id = b.doc_id and x.s <= b.s and b.s < x.s + x.n where b.reason is not null and b.doc_id = e.doc_id and b.category = e.category and x.s <= e.s and e.s < x.s + x.n)"""
)
def tainted_sentences(spark, d):
    """Generative edits over the words of cases: those of a family that broke the structure of their sentence fall."""
    c = _cases(spark, d).select(F.col("id").alias("doc_id"), "text")
    words = spans_of(c, " ", "k")
    kind = F.when(F.col("k") % 3 == 0, "draft").when(F.col("k") % 3 == 1, "russian-gec").otherwise("sage")
    why = F.when(F.col("k") % 7 == 3, "digits")
    edits = words.filter("e > s").select("doc_id", F.col("k").alias("seq"), "s", "e", kind.alias("category"), why.alias("reason"))
    return safety.untainted(edits, spans_of(c, ". ", "j").select("doc_id", "s", "e"))


@QUERIES.add(
    f"""with c as (select id as doc_id, text from {CASES} c),
    wr as (select doc_id, unnest(string_split(text, ' ')) as part, generate_subscripts(string_split(text, ' '), 1) - 1 as idx from c),
    w as (select doc_id, idx, sum(length(part) + 1) over (partition by doc_id order by idx) - length(part) - 1 as s, length(part) as n from wr),
    p as (select doc_id, s, s + 8 as e, case when s % 24 = 0 then 'COMMA' else 'O' end as label, (s % 100) / 100.0::double as score from (select doc_id, unnest(range(0, length(text) + 1, 8)) as s from c)),
    j as (select w.doc_id, w.idx, arg_max(p.label, p.e) as label, arg_max(p.score, p.e) as score from w join p on w.doc_id = p.doc_id and w.n > 0 and w.s < p.e and p.s < w.s + w.n group by 1, 2),
    ok as (select doc_id from (select doc_id, count(*) as n from w where n > 0 group by doc_id) join (select doc_id, count(*) as m from j group by doc_id) using (doc_id) where n = m)
    select doc_id, cast(idx as integer) as idx, label, score from j where doc_id in (select doc_id from ok)"""
)
def word_label_join(spark, d):
    """Predictions over blocks of eight characters meet the words of cases; the last-ending one wins."""
    c = _cases(spark, d).select(F.col("id").alias("doc_id"), "text")
    words = spans_of(c, " ", "idx").filter("e > s")
    at = F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(8)))
    pred = c.select("doc_id", at.alias("s")).withColumns({"e": F.col("s") + 8, "label": F.when(F.col("s") % 24 == 0, "COMMA").otherwise("O"), "score": (F.col("s") % 100) / 100.0})
    return safety.word_labels(words, pred)


@QUERIES.add(
    """with e as (select event_id // 200 as doc_id, event_id, cast(trunc(value) as integer) % 50 as s, cast(trunc(value) as integer) % 50 + 5 as e from events),
    l as (select doc_id, list(struct_pack(s := s, e := e, id := event_id) order by s, e, event_id) as c from e group by doc_id),
    p as (select doc_id, list_reduce(list_transform(c, lambda y: [y]), lambda a, x: case when len(a) = 0 or a[len(a)].e <= x[1].s then list_concat(a, x) else a end, c[1:0]) as got from l)
    select doc_id, unnest(list_transform(got, lambda x: x.id)) as event_id from p"""
)
def start_ordered_choice(spark, d):
    s = F.col("value").cast("int") % 50
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 200).alias("doc_id"), s.alias("s"), (s + 5).alias("e"), "event_id")
    return safety.by_start(e).select("doc_id", "event_id")
