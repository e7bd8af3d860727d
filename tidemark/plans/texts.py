"""Queries of the text functions: normalisation, cleanup, signatures, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import segments
from tidemark.plans.base import Registry, table

QUERIES = Registry()
L = T.LETTER
LOW = T.LOWER


def _chunks(spark, d):
    return table(spark, d, "rag_chunks").select("id", "text").dropDuplicates(["id"])


CHUNKS = "(select id, any_value(text) as text from rag_chunks group by id)"


@QUERIES.add(
    f"""select id,
        md5(regexp_replace(replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(8232), chr(10)), '\\n{{3,}}', chr(10)||chr(10), 'g')) as local_md5,
        md5(regexp_replace(replace(replace(replace(text, chr(13)||chr(10), chr(10)||chr(10)), chr(13), chr(10)||chr(10)), chr(8232), chr(10)), '\\n{{3,}}', chr(10)||chr(10), 'g')) as double_md5,
        md5(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g')) as trimmed_md5
    from {CHUNKS} c"""
)
def normalize_newlines(spark, d):
    c = F.col("text")
    return _chunks(spark, d).select("id", F.md5(T.newlines_local(c)).alias("local_md5"), F.md5(T.newlines_double(c)).alias("double_md5"), F.md5(T.newlines_trimmed(c)).alias("trimmed_md5"))


@QUERIES.add(
    f"""select id, md5(translate(text, chr(160)||chr(8239)||chr(8201)||chr(8199)||chr(8288)||chr(8203)||chr(65279)||chr(173), '    ')) as visible_md5,
        cast(length(text) - length(translate(text, chr(8288)||chr(8203)||chr(65279)||chr(173), '')) as integer) as removed
    from {CHUNKS} c"""
)
def normalize_spaces(spark, d):
    c = F.col("text")
    return _chunks(spark, d).select("id", F.md5(T.visible_blanks(c)).alias("visible_md5"), (F.length(c) - F.length(F.translate(c, T.INVISIBLE, ""))).alias("removed"))


@QUERIES.add(
    f"""with j as (select id, text, regexp_replace(regexp_replace(text, '([{L}])-\\n([{LOW}])', '\\1\\2', 'g'), '([{LOW},;:])\\n([{LOW}])', '\\1 \\2', 'g') as joined from {CHUNKS} c)
    select id, md5(joined) as joined_md5, cast((length(text) - length(replace(text, chr(10), ''))) - (length(joined) - length(replace(joined, chr(10), ''))) as integer) as joins from j"""
)
def hard_wrap_join(spark, d):
    c = F.col("text")
    return _chunks(spark, d).select("id", F.md5(T.join_wraps(c)).alias("joined_md5"), T.wrap_joins(c).alias("joins"))


# (?u) of Java is implied in RE2, which folds the case of all letters.
_SERVICE = "|".join("(?:" + p.replace("(?iu)", "").replace("'", "''") + ")" for p in T.SERVICE_LINES)


@QUERIES.add(
    f"""with s as (select id, string_split(text, chr(10)) as lines from {CHUNKS} c where text is not null),
    k as (select id, lines, list_filter(lines, lambda x: not regexp_matches(trim(x, ' '), '(?i){_SERVICE}')) as kept from s)
    select id, cast(len(lines) as integer) as original_lines, cast(len(kept) as integer) as kept_lines, cast(len(lines) - len(kept) as integer) as removed_service,
        case when len(lines) > 1 or lines[1] <> '' then round(100.0::double * (1 - len(kept)::double / len(lines)), 1) else 0.0::double end as reduction_pct,
        md5(regexp_replace(array_to_string(list_transform(kept, lambda x: rtrim(regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g'), ' ')), chr(10)), '\\n{{3,}}', chr(10)||chr(10), 'g')) as cleaned_md5
    from k"""
)
def service_line_cleanup(spark, d):
    c = F.col("text")
    s = T.cleanup_stats(c)
    rows = _chunks(spark, d).filter("text is not null")
    return rows.select(
        "id", *(s[x].alias(x) for x in ("original_lines", "kept_lines", "removed_service", "reduction_pct")), F.md5(T.without_service_lines(c)).alias("cleaned_md5")
    )


@QUERIES.add(
    """with s as (select distinct seg_id, text from segments)
    select seg_id, replace(replace(replace(text, chr(10)||chr(10), chr(1)), chr(10), ' '), chr(1), chr(10)||chr(10)) as flowing from s"""
)
def soft_break_collapse(spark, d):
    return table(spark, d, "segments").select("seg_id", "text").distinct().select("seg_id", T.soft_breaks(F.col("text")).alias("flowing"))


@QUERIES.add(
    """with s as (select distinct seg_id, text from segments)
    select seg_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\s+([.,;:!?…»)\\]])', '\\1', 'g'), '([«(\\[])\\s+', '\\1', 'g'), '\\s+', ' ', 'g'), ' ') as tidy,
        trim(regexp_replace(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'), ' ') as one_blank from s"""
)
def detokenize(spark, d):
    c = F.col("text")
    return table(spark, d, "segments").select("seg_id", "text").distinct().select("seg_id", T.detokenise(c).alias("tidy"), T.one_blank(c).alias("one_blank"))


@QUERIES.add(
    f"""with s as (select distinct seg_id, text from segments)
    select seg_id, regexp_replace(text, '[^.,;:!?()\\[\\]«»"—–-]', '', 'g') as delimiters, regexp_replace(text, '[^«»"„“”]', '', 'g') as quotes,
        array_to_string(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[{LOW}0-9]+'), ' ') as skeleton,
        array_to_string(regexp_extract_all(text, '[0-9]+'), ' ') as numbers,
        array_to_string(list_filter(regexp_extract_all(text, '[{L}0-9]+'), lambda w: regexp_matches(w, '^[A-ZА-ЯЁ]{{2,12}}$')), ' ') as acronyms
    from s"""
)
def text_signatures(spark, d):
    c = F.col("text")
    join = lambda x: F.array_join(x, " ")
    return table(spark, d, "segments").select("seg_id", "text").distinct().select(
        "seg_id", T.delimiters(c).alias("delimiters"), T.quotes(c).alias("quotes"), join(T.skeleton(c)).alias("skeleton"), join(T.numbers(c)).alias("numbers"), join(T.acronyms(c)).alias("acronyms")
    )


@QUERIES.add(
    """select distinct id, sha1(text) as text_sha1, sha256(text) as text_sha256,
        cast(('0x' || substr(md5(text), 14, 3))::integer % 64 as integer) as bucket,
        case when length(text) <= 16 then left(text, 4) || '...' else left(text, 12) || '...' || right(text, 4) end as redacted from eval_cases"""
)
def stable_hashes(spark, d):
    c = F.col("text")
    return table(spark, d, "eval_cases").select("id", F.sha1(c).alias("text_sha1"), F.sha2(c, 256).alias("text_sha256"), T.bucket(c, 64).alias("bucket"), T.redact_key(c).alias("redacted")).distinct()


@QUERIES.add(
    """with t as (select distinct doc_id, text from documents), w as (select unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) as term from t)
    select term, count(*) as n from w group by term"""
)
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    return t.select(F.explode(T.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@QUERIES.add(
    """with t as (select id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+') as w from bench_cases),
    p as (select id, '$' || unnest(w) || '$' as p from t),
    g as (select id, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) as gram from p)
    select gram, count(*) as n, count(distinct id) as cases from g group by gram"""
)
def trigram_counts(spark, d):
    t = table(spark, d, "bench_cases").select("id", F.explode(T.trigrams(F.col("text"))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("id").alias("cases"))


@QUERIES.add(
    """with w as (select distinct user_agent as word from audit_events where user_agent is not null union select distinct error from audit_events where error is not null)
    select word, coalesce(length(trim(word, ' ')) between 2 and 64 and not regexp_matches(trim(word, ' '), '[\\s\\x00-\\x1f"''«»()\\[\\]{}<>]'), false) as valid from w"""
)
def word_validation(spark, d):
    a = table(spark, d, "audit_events")
    w = a.select(F.col("user_agent").alias("word")).union(a.select("error")).filter("word is not null").distinct()
    return w.select("word", T.valid_word(F.col("word")).alias("valid"))


@QUERIES.add(
    """with e as (select distinct id, text, coalesce(expected, text) as expected from eval_cases)
    select id, text <> expected and translate(lower(text), 'ё', 'е') = translate(lower(expected), 'ё', 'е') as only_yo,
        case when length(text) - length(replace(text, '«', '')) > 1 and regexp_matches(text, '«[^»]*«') then true else false end as nested
    from e where text is not null"""
)
def yo_and_quotes(spark, d):
    e = table(spark, d, "eval_cases").select("id", "text", F.coalesce("expected", "text").alias("expected")).distinct().filter("text is not null")
    return e.select("id", T.only_yo_differs(F.col("text"), F.col("expected")).alias("only_yo"), T.nested_quotes(F.col("text")).alias("nested"))


@QUERIES.add(
    """with e as (select distinct id, '<think>draft</think>Исправленный текст: «' || text || '»' || chr(10) || 'Примечание: проверено' as answer, text from eval_cases where text is not null)
    select id, text as cleaned from e where not regexp_matches(text, '[«»]') and trim(text, ' ') = text and length(text) > 0"""
)
def model_output_cleanup(spark, d):
    e = table(spark, d, "eval_cases").select("id", "text").distinct()
    e = e.filter((~F.col("text").rlike("[«»]")) & (F.trim("text") == F.col("text")) & (F.length("text") > 0))
    answer = F.concat(F.lit("<think>draft</think>Исправленный текст: «"), "text", F.lit("»\nПримечание: проверено"))
    return e.select("id", T.model_output(answer).alias("cleaned"))


@QUERIES.add(None)
def sentence_segments(spark, d):
    s = table(spark, d, "segments").select(F.col("seg_id").alias("key"), "text").dropDuplicates(["key"])
    return segments.sentences(s)


@QUERIES.add(None)
def logical_segments(spark, d):
    s = table(spark, d, "segments").select(F.col("seg_id").alias("key"), "text").dropDuplicates(["key"])
    return segments.sentences(s, breaks=2)


_TRIM = r"'^\s+|\s+$', '', 'g'"


@QUERIES.add(
    f"""with recursive doc as (select doc_id, list_filter(list_transform(regexp_split_to_array(any_value(text), '\\n{{2,}}'), lambda p: regexp_replace(p, {_TRIM})), lambda p: p <> '') as ps from documents where text is not null group by doc_id),
    f as (
        select doc_id, ps, 1 as i, '' as open, 0::bigint as n, '' as last, 0 as k, null::varchar as done from doc
        union all
        select doc_id, ps, i + 1,
            case when full_ then right(last, 150) || chr(10) || chr(10) || p when open = '' then p else open || chr(10) || chr(10) || p end,
            case when full_ then least(length(last), 150) else n end + length(p) + 2, p, k + cast(full_ as integer), case when full_ then open end
        from (select *, ps[i] as p, n + length(ps[i]) + 2 > 1200 and open <> '' as full_ from f where i <= len(ps))
    ),
    c as (select doc_id, k - 1 as k, done as text from f where done is not null union all select doc_id, k, open from f where i > len(ps) and open <> '')
    select doc_id as key, cast(k as integer) as chunk_id, cast(length(regexp_replace(text, {_TRIM})) as integer) as n, md5(regexp_replace(text, {_TRIM})) as text_md5 from c"""
)
def paragraph_chunks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").dropDuplicates(["key"])
    return segments.paragraph_chunks(t, 1200, 150).select("key", "chunk_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def _last(mark: str) -> str:
    """Where a mark last stands in the second half of the window, as an offset; null if it does not."""
    m, back = f"'{mark}'".replace("\n", "' || chr(10) || '"), f"'{mark[::-1]}'".replace("\n", "' || chr(10) || '")
    return f"case when contains(w, {m}) then lo + 300 + length(w) - (instr(list_aggregate(list_reverse(string_split(w, '')), 'string_agg', ''), {back}) - 1) - {len(mark)} end"


@QUERIES.add(
    f"""with recursive doc as (select doc_id, regexp_replace(regexp_replace(any_value(text), '[ \\t]+', ' ', 'g'), {_TRIM}) as t from documents where text is not null group by doc_id),
    f as (
        select doc_id, t, 0::bigint as lo, null::bigint as s, null::bigint as e, 0 as i from doc
        union all
        select doc_id, t, case when hi = length(t) then hi else coalesce(case when instr(substr(t, nx + 1, least(hi, nx + 80) - nx), ' ') > 0 then nx + instr(substr(t, nx + 1, least(hi, nx + 80) - nx), ' ') end, nx) end, lo, hi, i + 1
        from (select *, greatest(lo + 1, hi - 80) as nx from (select doc_id, t, lo, i, case when length(t) - lo <= 600 then length(t) else
            coalesce({_last(chr(10) * 2)} + 2, {_last(chr(10))} + 1, {_last('. ')} + 2, {_last('; ')} + 2, {_last(', ')} + 2, {_last(' ')}, lo + 600) end as hi
            from (select *, substr(t, lo + 301, 300) as w from f where lo < length(t) and coalesce(e, -1) < length(t))))
    ),
    p as (select doc_id, i, regexp_replace(substr(t, s + 1, e - s), {_TRIM}) as x from f where s is not null)
    select doc_id as key, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as chunk_id, cast(length(x) as integer) as n, md5(x) as text_md5 from p where x <> ''"""
)
def hard_limit_chunks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").dropDuplicates(["key"])
    return segments.hard_chunks(t, 600, 80).select("key", "chunk_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@QUERIES.add(
    """with s as (select distinct seg_id, text from segments where text is not null),
    p as (select seg_id, text, regexp_extract(text, '^\\s*(?:\\d{1,3}[.)]|[а-яa-z]\\)|[-•*])\\s+') as lead from s)
    select seg_id, cast(case when length(lead) < length(text) then length(lead) else 0 end as integer) as shift,
        case when length(lead) < length(text) then substr(text, length(lead) + 1) else text end as body from p"""
)
def enumeration_strip(spark, d):
    s = table(spark, d, "segments").select("seg_id", "text").distinct().filter("text is not null")
    shift, body = segments.strip_enumeration(F.col("text"))
    return s.select("seg_id", shift.alias("shift"), body.alias("body"))
