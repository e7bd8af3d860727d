"""Queries of guards, frames, lexical joins, forms, fingerprints and term lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import sql as functions_sql
from tidemark.functions import text as T
from tidemark.operators import candidates as C
from tidemark.operators import catalog, diff, evaluate, forms, frames, guards, lexicon, retrieval
from tidemark.plans.base import Registry, table

QUERIES = Registry()
L = T.LETTER
CASES = "(select id, any_value(text) as text, any_value(coalesce(expected, text)) as expected, any_value(kind) as kind from eval_cases where text is not null group by id)"


def _cases(spark, d):
    return table(spark, d, "eval_cases").dropDuplicates(["id"]).filter("text is not null").select("id", "text", F.coalesce("expected", "text").alias("expected"), "kind")


def _sql(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


_LEXICON = "lx(form, lexeme_id, lemma, pos, cas, number, gender, animacy, pref) as (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in lexicon.fixture_rows()) + ")"
#: Chunks in which errors are planted by rule: adjectives of one phrase lose their agreement, nouns behind governors their case.
_PLANT = (("архивная группа", "архивный группа"), ("складского учёта", "складской учёта"), ("Дежурная смена", "Дежурные смена"), ("журнал показаний", "согласно журнала показаний"), ("график обходов", "после график обходов"))
_PLANTED_SQL = "page as (select id as doc_id, " + "".join("replace(" for _ in _PLANT) + "any_value(text)" + "".join(f", '{a}', '{b}')" for a, b in _PLANT) + " as text from rag_chunks where text is not null group by id)"
_PAIRS_SQL = f"""w as (select doc_id, regexp_extract_all(lower(text), '[{L}]+| |[^{L} ]+') as w from page),
    adj as (select doc_id, cast(i as integer) as idx, w[i] as l, w[i + 2] as r from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w) where w[i + 1] = ' ')"""
_AGREES = """(m.number is null or h.number is null or m.number = h.number) and (m.cas is null or h.cas is null or m.cas = h.cas)
    and (coalesce(m.number = 'plur' or h.number = 'plur', false) or m.gender is null or h.gender is null or m.gender = h.gender)
    and (coalesce(h.cas, '') <> 'accs' or m.animacy is null or h.animacy is null or m.animacy = h.animacy)"""


def _planted(spark, d):
    t = table(spark, d, "rag_chunks").select(F.col("id").alias("doc_id"), "text").filter("text is not null").dropDuplicates(["doc_id"])
    text = F.col("text")
    for a, b in _PLANT:
        text = F.replace(text, F.lit(a), F.lit(b))
    return t.select("doc_id", text.alias("text"))


@QUERIES.add(
    f"""with {_LEXICON}, {_PLANTED_SQL}, {_PAIRS_SQL},
    place as (select * from adj where l in (select form from lx where pos = 'ADJ') and r in (select form from lx where pos = 'NOUN')),
    good as (select distinct m.form as l, h.form as r from lx m, lx h where m.pos = 'ADJ' and h.pos = 'NOUN' and {_AGREES})
    select doc_id, idx, l as "left", r as "right" from place p where not exists (select 1 from good g where g.l = p.l and g.r = p.r)"""
)
def agreement_pairs(spark, d):
    """Adjacent modifier and noun of the lexicon that agree in no reading, over chunks with planted errors."""
    return lexicon.disagreements(_planted(spark, d), lexicon.fixture(spark))


@QUERIES.add(
    f"""with {_LEXICON}, src as (select distinct form, lexeme_id from lx where form in (select form from lx where pos = 'ADJ' and cas = 'nomn' and number = 'sing' and gender = 'masc')),
    got as (select s.form, x.form as inflected from src s join lx x using (lexeme_id) where x.cas = 'gent' and x.number = 'sing' and (x.gender is null or x.gender = 'femn') and x.form <> s.form)
    select form, min(inflected) as inflected from got group by form having count(distinct inflected) = 1"""
)
def inflect_unique(spark, d):
    lx = lexicon.fixture(spark)
    wanted = lx.filter("pos = 'ADJ' and `case` = 'nomn' and number = 'sing' and gender = 'masc'").select("form").distinct()
    return lexicon.inflect(wanted, lx, {"case": "gent", "number": "sing", "gender": "femn"})


@QUERIES.add(
    f"""with {_LEXICON}, {_PLANTED_SQL}, {_PAIRS_SQL}, rule(rule, gov, want, num) as (values {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in frames.RULES)}),
    place as (select * from adj join rule on l = gov where r in (select form from lx where pos = 'NOUN')),
    wrong as (select * from place p where not exists (select 1 from lx where pos = 'NOUN' and form = r and cas = want and (num is null or number = num))),
    fix as (select p.doc_id, p.idx, p.rule, p.r, t.form as good from wrong p join lx s on s.pos = 'NOUN' and s.form = p.r join lx t on t.pos = 'NOUN' and t.lexeme_id = s.lexeme_id and t.cas = p.want and t.number = coalesce(p.num, s.number))
    select doc_id, idx, rule, r as before, min(good) as after from fix group by doc_id, idx, rule, r having count(distinct good) = 1"""
)
def government_frames(spark, d):
    """Nouns behind words that demand another case, over chunks with planted errors."""
    return frames.governed(_planted(spark, d), lexicon.fixture(spark), frames.rules(spark))


_GUARD = f"""with {_LEXICON}, {_PLANTED_SQL}, {_PAIRS_SQL},
    place as (select doc_id, idx, l, r from adj where l in (select form from lx where pos = 'ADJ') and r in (select form from lx where pos = 'NOUN')),
    made as (select doc_id, idx * 5 as ord, r as before, lemma as after, 'russian-gec' as category, r as word, l from (select distinct doc_id, idx, l, r, lemma from place join lx on pos = 'NOUN' and form = r) where r <> lemma
        union all select doc_id, idx * 5 + 1, r, 'протокол', 'draft', r, l from place where r <> 'протокол'
        union all select doc_id, idx * 5 + 2, r, r || ' 7', 'sage', r, l from place
        union all select doc_id, idx * 5 + 3, r, r || ',', 'model', r, l from place
        union all select doc_id, idx * 5 + 4, l || ' ' || r, r, 'model', r, l from place),
    wl as (select doc_id, list_transform(regexp_extract_all(text, '[{L}]+'), lambda x: x) as ws from page),
    good as (select distinct m.form as l, h.form as r from lx m, lx h where m.pos = 'ADJ' and h.pos = 'NOUN' and {_AGREES}),
    near as (select m.*, list_position(ws, word) as p, ws from made m join wl using (doc_id)),
    fit as (select *, coalesce((p > 1 and exists (select 1 from good g where g.l = lower(ws[p - 1]) and g.r = word)), false) or coalesce((p > 0 and exists (select 1 from good g where g.l = word and g.r = lower(ws[p + 1]))), false) as ok from near)
    select doc_id, ord, case when category = 'sage' then 'digits changed' when category = 'model' and after = before || ',' then null when category = 'model' then 'number of words changed'
        when exists (select 1 from lx a join lx b using (lemma) where a.form = before and b.form = after) then case when ok then 'agrees as it is' end
        else 'another word' end as guard from fit"""


@QUERIES.add(_GUARD)
def guard_reasons(spark, d):
    """Edits of models around nouns with an adjective: another form, another word, a number, a comma, a lost word; and why each falls."""
    t, lx = _planted(spark, d), lexicon.fixture(spark)
    adj, noun = (lx.filter(F.col("pos") == p).select(F.col("form").alias(n)).distinct() for p, n in (("ADJ", "left"), ("NOUN", "right")))
    place = lexicon.adjacent(t).join(adj, "left", "left_semi").join(noun, "right", "left_semi")
    lemma = lx.filter("pos = 'NOUN'").select(F.col("form").alias("right"), "lemma").distinct()
    made = lambda df, k, before, after, cat: df.select("doc_id", (F.col("idx") * 5 + k).alias("ord"), before.alias("before"), after.alias("after"), F.lit(cat).alias("category"))
    r, both = F.col("right"), F.concat_ws(" ", "left", "right")
    c = made(place.join(lemma, "right").filter("right <> lemma"), 0, r, F.col("lemma"), "russian-gec")
    c = c.unionByName(made(place.filter(r != "протокол"), 1, r, F.lit("протокол"), "draft")).unionByName(made(place, 2, r, F.concat(r, F.lit(" 7")), "sage"))
    c = c.unionByName(made(place, 3, r, F.concat(r, F.lit(",")), "model")).unionByName(made(place, 4, both, r, "model"))
    return guards.generative_guard(c, t, lx).select("doc_id", "ord", "guard")


@QUERIES.add(f"select guard, count(*) as n from ({_GUARD}) group by guard")
def guard_counters(spark, d):
    """How many edits fell for which reason."""
    return guard_reasons(spark, d).groupBy("guard").agg(F.count("*").alias("n"))


@QUERIES.add(
    f"""with c as (select id, text as b, expected as a from {CASES} c where text <> expected), s(category, sources) as (values ('draft', ['draft']), ('sage', ['sage', 'draft']), ('model', ['rupunct-model']), ('rule-x', ['rule-x'])),
    x as (select *, regexp_extract_all(' ' || regexp_replace(b, '([^А-Яа-яЁёA-Za-z])', '\\1\\1', 'g') || ' ', '[^А-Яа-яЁёA-Za-z]([А-ЯЁA-Z]{{2,}})[^А-Яа-яЁёA-Za-z]', 1) as ab, regexp_extract_all(' ' || regexp_replace(b, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ', '[^\\p{{L}}\\p{{N}}_]([0-9]+)[^\\p{{L}}\\p{{N}}_]', 1) as nu from c, s)
    select id, category, case when category <> 'rule-x' and (regexp_replace(b, '[^«»"„“”]', '', 'g') <> regexp_replace(a, '[^«»"„“”]', '', 'g')
        or (len(sources) = 1 and not contains(sources[1], 'rupunct') and length(a) - length(replace(a, ',', '')) > length(b) - length(replace(b, ',', '')))
        or len(list_filter(list_concat(ab, nu), lambda t: not contains(a, t))) > 0
        or (len(regexp_extract_all(b, '[А-Яа-яЁё]+')) >= 2 and len(regexp_extract_all(a, '[А-Яа-яЁё]+')) = 1 and regexp_matches(b, '\\s'))) then 0.49::double else 0.8::double end as confidence from x"""
)
def solo_punctuation(spark, d):
    """Confidence of whole-text edits under several sources; doubtful ones of models fall below what is accepted."""
    kinds = F.array(*(F.struct(F.lit(c).alias("category"), F.array(*map(F.lit, s)).alias("sources")) for c, s in (("draft", ["draft"]), ("sage", ["sage", "draft"]), ("model", ["rupunct-model"]), ("rule-x", ["rule-x"]))))
    c = _cases(spark, d).filter("text <> expected").select("id", F.col("text").alias("before"), F.col("expected").alias("after"), F.explode(kinds).alias("k")).select("id", "before", "after", "k.*", F.lit(0.8).alias("confidence"))
    return guards.lowered(c).select("id", "category", "confidence")


@QUERIES.add(
    f"""with c as (select id, text || case when length(text) % 2 = 0 then ', учитывая, что срок прошёл' else ', и учитывая срок, что прошёл' end as text from {CASES} c)
    select id, regexp_matches(substr(text, greatest(instr(text, 'учитывая') - 1 - 20, 0) + 1, instr(text, 'учитывая') - 1 + 9 + 80 - greatest(instr(text, 'учитывая') - 1 - 20, 0)), '(?i),\\s*(?:учитывая|принимая\\s+во\\s+внимание)\\s*,\\s*что([^\\p{{L}}]|$)') and substr(text, instr(text, 'учитывая'), 9) = 'учитывая,' as closed from c"""
)
def contextual_commas(spark, d):
    """Whether the comma behind a word of a planted phrase may not be taken away by a model."""
    c = _cases(spark, d).select("id", F.concat("text", F.when(F.length("text") % 2 == 0, ", учитывая, что срок прошёл").otherwise(", и учитывая срок, что прошёл")).alias("text"))
    start = F.instr("text", "учитывая") - 1
    before = F.substr("text", start + 1, F.lit(9))
    return c.select("id", guards.opens_closed_comma(F.col("text"), start, before, F.rtrim(F.replace(before, F.lit(","), F.lit(""))), F.lit("draft")).alias("closed"))


@QUERIES.add(
    f"""with u as (select id, text, unnest(range(1, length(text) + 1)) as i from {CASES} c)
    select id, i - 1 as at, length(substr(text, 1, i - 1)) - length(replace(substr(text, 1, i - 1), '«', '')) > length(substr(text, 1, i - 1)) - length(replace(substr(text, 1, i - 1), '»', '')) as quoted from u where substr(text, i, 1) = ','"""
)
def commas_in_quotes(spark, d):
    c = _cases(spark, d).select("id", "text", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substr("text", i, F.lit(1)) == ",")).alias("i"))
    return c.select("id", (F.col("i") - 1).cast("long").alias("at"), guards.inside_quotes(F.col("text"), F.col("i") - 1).alias("quoted"))


@QUERIES.add(
    f"""with c as (select id, text, s, n from {CASES} c, (values (0, 3), (2, 5), (7, 4)) v(s, n) where length(text) > 12), e as (select *, '[{L}0-9_]' as w from c)
    select id, s as start, not (s >= 1 and s < length(text) and regexp_matches(substr(text, s, 1), '[{L}0-9_]') and regexp_matches(substr(text, s + 1, 1), '[{L}0-9_]'))
        and not (s + n < length(text) and regexp_matches(substr(text, s + n, 1), '[{L}0-9_]') and regexp_matches(substr(text, s + n + 1, 1), '[{L}0-9_]')) as on_edges from e"""
)
def word_edges(spark, d):
    spans = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in ((0, 3), (2, 5), (7, 4))))
    c = _cases(spark, d).filter(F.length("text") > 12).select("id", "text", F.explode(spans).alias("x"))
    return c.select("id", F.col("x.s").alias("start"), guards.on_word_edges(F.col("text"), F.col("x.s"), F.col("x.n")).alias("on_edges"))


@QUERIES.add(
    """with c as (select id, text, unnest(must_contain) as phrase from bench_cases)
    select id, phrase, len(regexp_extract_all(replace(text, ' ', chr(10) || ' '), array_to_string(list_transform(list_filter(regexp_split_to_array(phrase, '\\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+'))) as places from c where trim(phrase) <> ''"""
)
def loose_literals(spark, d):
    """Required phrases found in texts whose blanks became line breaks with blanks."""
    c = table(spark, d, "bench_cases").select("id", F.replace("text", F.lit(" "), F.lit("\n ")).alias("text"), F.explode("must_contain").alias("phrase")).filter("trim(phrase) <> ''")
    return c.select("id", "phrase", F.regexp_count("text", guards.loose_pattern(F.col("phrase"))).cast("long").alias("places"))


@QUERIES.add("select distinct id, nfc_normalize(text) as text from rag_chunks")
def nfc_text(spark, d):
    return forms.composed(table(spark, d, "rag_chunks").select(F.col("id").alias("key"), "text").dropDuplicates(["key"])).withColumnRenamed("key", "id")


@QUERIES.add(f"select id, text from {CASES} c")
def yo_put_back(spark, d):
    """Texts in which each ye became yo, with the yo put back that the source does not have."""
    c = _cases(spark, d).select(F.col("id").alias("case_id"), F.col("text").alias("source"), F.translate("text", "еЕ", "ёЁ").alias("target"))
    return diff.undo_yo(c).withColumnRenamed("case_id", "id")


@QUERIES.add(
    f"""with w as (select id, regexp_split_to_array(trim(text), '\\s+') as a, regexp_split_to_array(trim(expected), '\\s+') as b from {CASES} c),
    s as (select id, unnest(a) as x, unnest(b) as y, generate_subscripts(a, 1) - 1 as pos from w where len(a) = len(b))
    select id, count(*) as changes, count(*) filter (where pos % 2 = 1) as added from s where x <> y group by id"""
)
def completed_changes(spark, d):
    """Changes listed for every other position only, completed by those that the corrected text shows."""
    c = _cases(spark, d).select(F.col("id").alias("case_id"), F.col("text").alias("source"), F.col("expected").alias("target"))
    listed = evaluate.edit_rows(c).filter("pos >= 0 and pos % 2 = 0")
    done = evaluate.complete(c, listed).filter("pos >= 0")
    return done.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("changes"), F.count_if("added").alias("added"))


@QUERIES.add(
    f"""with w as (select id, kind, text, expected, case when length(text) % 3 = 0 then expected else text end as produced from {CASES} c)
    select case when kind = 'clean' then 'clean' else 'error' end as kind, count(*) as cases, count(*) filter (where regexp_replace(produced, '[^.,;:!?()\\[\\]«»"—–-]', '', 'g') <> regexp_replace(text, '[^.,;:!?()\\[\\]«»"—–-]', '', 'g')) as touched,
        count(*) filter (where regexp_replace(produced, '[^.,;:!?()\\[\\]«»"—–-]', '', 'g') = regexp_replace(expected, '[^.,;:!?()\\[\\]«»"—–-]', '', 'g')) as exact from w group by 1"""
)
def punctuation_report(spark, d):
    c = _cases(spark, d).withColumn("produced", F.when(F.length("text") % 3 == 0, F.col("expected")).otherwise(F.col("text")))
    return evaluate.punctuation(c.select("kind", "text", "expected", "produced"))


_FINGER = "select doc_id, sha256(string_agg(chunk_id || ':' || md5(coalesce(text, '')), chr(10) order by chunk_id)) as fingerprint from (select distinct doc_id, chunk_id, text from rag_chunks) group by doc_id"


@QUERIES.add(_FINGER)
def document_fingerprints(spark, d):
    return catalog.fingerprints(table(spark, d, "rag_chunks"))


@QUERIES.add(f"with f as ({_FINGER}), k as (select doc_id, fingerprint from f where doc_id not like '%3' and doc_id not like '%7') select doc_id, case when doc_id like '%3' then 'new' else 'changed' end as state from f where doc_id like '%3' or doc_id like '%7'")
def stale_indexes(spark, d):
    """Documents whose index must be built anew: their fingerprint is unknown or not the one the index was built with."""
    now = catalog.fingerprints(table(spark, d, "rag_chunks"))
    built = now.filter(~F.col("doc_id").endswith("3")).withColumn("fingerprint", F.when(F.col("doc_id").endswith("7"), F.lit("old")).otherwise(F.col("fingerprint")))
    return catalog.stale(now, built)


@QUERIES.add(
    """with t as (select distinct id, text from rag_chunks where id % 10 <> 3), w as (select id, unnest(regexp_extract_all(translate(lower(case when id % 10 = 7 then text || ' дополнение' else text end), 'ё', 'е'), '[a-zа-я0-9]+')) as term from t)
    select term, count(*) as tf, count(distinct id) as df from w group by term"""
)
def maintained_postings(spark, d):
    """Postings of which some documents were removed and some read again: as if built from what there is now."""
    chunks = table(spark, d, "rag_chunks").select(F.col("id").alias("key"), "text").dropDuplicates(["key"])
    old = retrieval.postings(chunks, T.words(F.col("text")))
    changed = chunks.filter("key % 10 = 7").withColumn("text", F.concat("text", F.lit(" дополнение")))
    now = retrieval.maintain(old, chunks.filter("key % 10 in (3, 7)").select("key"), changed)
    return now.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


# The distance is measured over bytes there, so each letter becomes one byte first.
_ONE_BYTE = "'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345'"
_DISTANCE = f"levenshtein(translate(word, {_ONE_BYTE}), translate(term, {_ONE_BYTE}))"
#: Terms of a term base, as users write them; the text may hold them with up to two letters wrong.
TERMS = ("инвентарный", "сопроводительное", "ответственного", "заведующий", "распоряжение", "свидетелей", "приложение", "наложенный")


@QUERIES.add(
    f"""with w as (select distinct unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[а-я]+')) as word from rag_chunks), t(term) as (values {", ".join(f"('{t}')" for t in TERMS)})
    select word, term, {_DISTANCE} as distance from w, t where length(word) >= 8 and abs(length(word) - length(term)) <= 2 and {_DISTANCE} between 1 and 2"""
)
def term_aliases(spark, d):
    """Words of the chunks that are at one or two edits from a term."""
    words = table(spark, d, "rag_chunks").select(F.explode(F.regexp_extract_all(T.fold_yo(F.col("text")), F.lit("[а-я]+"), F.lit(0))).alias("form")).distinct()
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return lexicon.near_terms(words.filter(F.length("form") >= 8), terms).select(F.col("form").alias("word"), "term", F.col("distance").cast("long").alias("distance"))


@QUERIES.add(
    """select distinct seg_id, translate(lower(text), 'ё', 'е') as folded, regexp_replace(text, '[^«»"„“”]', '', 'g') as quotes, len(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) as words from segments"""
)
def sql_functions(spark, d):
    """The functions registered for SQL."""
    functions_sql.register(spark)
    table(spark, d, "segments").createOrReplaceTempView("tm_segments")
    return spark.sql("select distinct seg_id, tm_fold_yo(text) as folded, tm_quotes(text) as quotes, cast(size(tm_words(text)) as bigint) as words from tm_segments")


@QUERIES.add(
    f"""with {_LEXICON} select a.form as form, b.form as other, count(distinct a.lemma) as lemmas from lx a join lx b using (lemma) where a.pos = 'NOUN' and b.pos = 'NOUN' and a.form < b.form group by 1, 2"""
)
def shared_lemmas(spark, d):
    lx = lexicon.fixture(spark).filter("pos = 'NOUN'").select("form", "lemma").distinct()
    j = lx.join(lx.withColumnRenamed("form", "other"), "lemma").filter("form < other")
    return j.groupBy("form", "other").agg(F.countDistinct("lemma").alias("lemmas"))


def _votes(spark, d):
    """Candidates of several families around the adjective-noun places of the lexicon."""
    t, lx = _planted(spark, d), lexicon.fixture(spark)
    adj, noun = (lx.filter(F.col("pos") == p).select(F.col("form").alias(n)).distinct() for p, n in (("ADJ", "left"), ("NOUN", "right")))
    place = lexicon.adjacent(t).join(adj, "left", "left_semi").join(noun, "right", "left_semi")
    cat = F.when(F.col("idx") % 3 == 0, F.array(F.lit("russian-gec-x"))).when(F.col("idx") % 3 == 1, F.array(F.lit("draft"), F.lit("sage"))).otherwise(F.array(F.lit("draft")))
    after = F.when(F.col("idx") % 2 == 0, F.lit("отделом")).otherwise(F.lit("протокол"))
    c = place.select("doc_id", "idx", "right", after.alias("after"), F.posexplode(cat).alias("stage_ord", "category"))
    return c.select("doc_id", "stage_ord", F.col("idx").alias("seq"), F.lit(None).cast("int").alias("start"), F.col("right").alias("before"), "after", F.lit(0.9).alias("confidence"), "category"), lx


@QUERIES.add(
    f"""with {_LEXICON}, {_PLANTED_SQL}, {_PAIRS_SQL},
    place as (select doc_id, idx, r from adj where l in (select form from lx where pos = 'ADJ') and r in (select form from lx where pos = 'NOUN')),
    c as (select doc_id, r as before, case when idx % 2 = 0 then 'отделом' else 'протокол' end as after, unnest(case idx % 3 when 0 then ['russian-gec-x'] when 1 then ['draft', 'sage'] else ['draft'] end) as category from place),
    v as (select doc_id, before, after, list_sort(list(distinct category)) as sources, max(case when category like 'russian-gec%' then 0.86::double when category = 'sage' then 0.8::double else 0.66::double end) as w from c group by 1, 2, 3)
    select doc_id, before, after, round(least(w + 0.1::double * (len(sources) - 1), 1.0::double) - case when len(sources) < 2 and exists (select 1 from lx a join lx b using (lemma) where a.form = before and b.form = after and before <> after) then 0.25::double else 0.0::double end, 4) as confidence,
        array_to_string(sources, '|') as sources from v"""
)
def family_votes(spark, d):
    """Votes of several model families: weights, bonus, and the penalty of lone inflections."""
    c, lx = _votes(spark, d)
    return C.merge(c, lx).select("doc_id", "before", "after", "confidence", F.array_join("sources", "|").alias("sources"))


@QUERIES.add(
    f"""with w as (select id, regexp_extract_all(text, '\\S+') as w from {CASES} c), u as (select id, unnest(w) as word, generate_subscripts(w, 1) - 1 as idx from w)
    select id, cast(idx as integer) as idx, word, cast(sum(length(word) + 1) over (partition by id order by idx) - length(word) - 1 as integer) as start from u"""
)
def rejoined_words(spark, d):
    """Words joined by single blanks, and where each stands then."""
    w = _cases(spark, d).select("id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    at = F.transform("w", lambda x, i: F.struct(i.alias("idx"), x.alias("word"), F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y) + 1).alias("start")))
    return w.select("id", F.explode(at).alias("x")).select("id", "x.*")


@QUERIES.add(
    f"""with w as (select id, regexp_extract_all(text, '\\S+') as w from {CASES} c), u as (select id, unnest(w) as word, generate_subscripts(w, 1) - 1 as idx from w),
    p as (select id, idx, word, sum(length(word) + 1) over (partition by id order by idx) - length(word) - 1 as start from u)
    select id, cast(idx as integer) as idx, count(*) over (partition by id order by start range between 40 preceding and 60 following) - 1 as near from p"""
)
def text_distance_frames(spark, d):
    """How many other words begin at most 40 characters before a word or 60 behind its start."""
    w = Window.partitionBy("id").orderBy("start").rangeBetween(-40, 60)
    return rejoined_words(spark, d).select("id", "idx", (F.count("*").over(w) - 1).alias("near"))


@QUERIES.add(
    """with s as (select distinct seg_id, req_id, seg_idx, text from segments), r as (select *, row_number() over (partition by req_id order by seg_idx, seg_id) as n, count(*) over (partition by req_id) as total from s)
    select req_id, seg_id, greatest(total - 8, 0) as left_out from r where n <= 8"""
)
def capped_segments(spark, d):
    """The first eight segments of each request, as one call may ask for, and how many more there are."""
    s = table(spark, d, "segments").select("req_id", "seg_id", "seg_idx", "text").distinct()
    w = Window.partitionBy("req_id")
    s = s.withColumn("n", F.row_number().over(w.orderBy("seg_idx", "seg_id"))).withColumn("left_out", F.greatest(F.count("*").over(w) - 8, F.lit(0)))
    return s.filter("n <= 8").select("req_id", "seg_id", "left_out")


@QUERIES.add(
    f"""with c as (select id, text as a, expected as b from {CASES} c where length(text) = length(expected) and text <> expected), u as (select id, a, b, unnest(range(1, length(a) + 1)) as i from c)
    select id, i - 1 as at, substr(a, i, 1) as before, substr(b, i, 1) as after from u where substr(a, i, 1) <> substr(b, i, 1)"""
)
def character_changes(spark, d):
    """Characters that differ in texts of equal length."""
    c = _cases(spark, d).filter((F.length("text") == F.length("expected")) & (F.col("text") != F.col("expected")))
    pairs = F.filter(F.zip_with(F.split("text", ""), F.split("expected", ""), lambda a, b: F.struct(a.alias("before"), b.alias("after"))), lambda x: F.lit(True))
    at = c.select("id", F.posexplode(pairs).alias("at", "x")).filter("x.before <> x.after")
    return at.select("id", F.col("at").cast("long").alias("at"), "x.before", "x.after")


@QUERIES.add(
    f"""with p as (select id, replace(any_value(text), 'с ИНН ', 'с ИНК № ') as text from rag_chunks where text is not null group by id),
    a as (select id, unnest(regexp_extract_all(text, '[А-ЯЁ]{{2,12}} +№')) as found from p), k(abbr) as (values ('ГОСТ'), ('ИНН'), ('ТУ'))
    select id, split_part(found, ' ', 1) as before, min(abbr) as after, count(*) as places from a, k
    where split_part(found, ' ', 1) not in (select abbr from k) and {_DISTANCE.replace("word", "lower(split_part(found, ' ', 1))").replace("term", "lower(abbr)")} <= 1 and length(abbr) > 2 group by id, found having count(distinct abbr) = 1"""
)
def abbreviation_terms(spark, d):
    """Abbreviations before a number sign that are one edit from exactly one of the known ones, over chunks in which some are planted."""
    known = spark.createDataFrame([("ГОСТ",), ("ИНН",), ("ТУ",)], "abbr string")
    t = table(spark, d, "rag_chunks").select("id", "text").filter("text is not null").dropDuplicates(["id"])
    t = t.withColumn("text", F.replace("text", F.lit("с ИНН "), F.lit("с ИНК № ")))
    a = t.select("id", F.explode(F.regexp_extract_all("text", F.lit("[А-ЯЁ]{2,12} +№"), F.lit(0))).alias("found")).withColumn("before", F.substring_index("found", " ", 1))
    near = lexicon.near_terms(a.select(F.col("before").alias("form")).distinct().join(known.withColumnRenamed("abbr", "form"), "form", "left_anti"), known.filter("length(abbr) > 2").withColumnRenamed("abbr", "term"), 1)
    one = near.groupBy("form").agg(F.count("*").alias("k"), F.min("term").alias("after")).filter("k = 1")
    return a.join(one.withColumnRenamed("form", "before"), "before").groupBy("id", "before", "after", "found").agg(F.count("*").alias("places")).drop("found")
