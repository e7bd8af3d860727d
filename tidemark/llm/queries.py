"""Queries of the training-data operators over the project's tables, and the SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import abuse, leakage, lookalike, mixing, mojibake, pii, repeats, sentences, splitting
from tidemark.llm.arrow import map_rows, read
from tidemark.session import checkpoint_dir


def _keyed(df: DataFrame, tab: str, key: str, text: str) -> DataFrame:
    return df.select(F.lit(tab).alias("tab"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.kinds(pii.both_tables(read(spark, d, "audit_events"), read(spark, d, "rag_chunks")))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = pii.both_tables(read(spark, d, "audit_events"), read(spark, d, "rag_chunks"))
    return pii.redact(rows.dropDuplicates(["tab", "row_id"]))


def _p2_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = _keyed(read(spark, d, "rag_chunks"), "chunk", "id", "text")
    return chunks.unionByName(_keyed(read(spark, d, "rag_documents"), "path", "doc_id", "path")).filter(F.length("text") > 0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(_p2_rows(spark, d))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(_p2_rows(spark, d))


def _p3_rows(spark: SparkSession, d: str) -> DataFrame:
    cases = read(spark, d, "eval_cases")
    rows = _keyed(read(spark, d, "rag_chunks"), "chunk", "id", "text")
    return rows.unionByName(_keyed(cases, "case_text", "id", "text")).unionByName(_keyed(cases, "case_expected", "id", "expected"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(_p3_rows(spark, d), lambda tab, text: tab == "chunk" and mojibake.is_garbled(text))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise(_p3_rows(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.oversized(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))
    return splitting.split_rows(items).filter("cut is not null").select("doc_id", "chunk_id", "cut").dropDuplicates()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.with_limits(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))
    return splitting.renumber(splitting.split_rows(items))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The newspaper pages, joined by source into files in the shared folder, cut by byte ranges: (source, file, piece, byte_start, char_start, text).

    Files hold ranges of (source, doc_id), so that the pages of a large source are spread over several.
    """
    pages = read(spark, d, "documents").select("source", "doc_id", "text").filter("source is not null and text is not null").dropDuplicates(["doc_id"])
    folder = f"{checkpoint_dir(spark)}/tidemark-files-{uuid.uuid4().hex}"
    pages.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(folder)
    got = splitting.split_files(spark, folder, range_bytes=1 << 20)
    return got.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "piece", "byte_start", "char_start", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = repeats.repeated_lines(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))
    return got.select("id", "line_no").dropDuplicates()


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each site: how many documents hold each and in how many chunks it stands."""
    got = repeats.repeated_lines(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))
    return got.groupBy("site", "line", "n", "total").agg(F.count("*").alias("places"))


def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeats(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))


def p5_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without the content-defined pieces that are repeated in their site, wherever lines break."""
    return repeats.without_pieces(read(spark, d, "rag_chunks"), read(spark, d, "rag_documents"))


def _p6_rows(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    segments = read(spark, d, "segments").select(F.lit("segment").alias("tab"), F.col("seg_id").alias("row_id"), "text", F.lit(False).alias("line_breaks_end"))
    return segments.unionByName(chunks).filter(F.length("text") > 0)


def _p6_chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "rag_chunks").select(F.lit("chunk").alias("tab"), F.col("id").alias("row_id"), "text", F.lit(True).alias("line_breaks_end"), "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the chunks only those with chunk_id 0 that are not garbled, as this query is defined; p6_units takes all."""

    def make():
        def each(tab, row_id, text, breaks):
            if not mojibake.is_garbled(text):
                yield tab, row_id, text, breaks

        return each

    first = _p6_chunks(spark, d).filter("chunk_id = 0").drop("chunk_id")
    clean = map_rows(first, make, "tab string, row_id long, text string, line_breaks_end boolean")
    return sentences.found(_p6_rows(spark, d, clean))


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(_p6_rows(spark, d, _p6_chunks(spark, d).drop("chunk_id")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    got = leakage.contaminated(read(spark, d, "documents"), read(spark, d, "bench_cases"))
    return got.select("item_id", "doc_id").dropDuplicates()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: pages and the highest coverage of each."""
    got = leakage.contaminated(read(spark, d, "documents"), read(spark, d, "bench_cases"))
    return got.groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"), F.max("coverage").alias("most_covered"))


def p7_cut(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(read(spark, d, "documents"), read(spark, d, "bench_cases"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_order(spark: SparkSession, d: str) -> DataFrame:
    return mixing.order(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(read(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(read(spark, d, "documents"))


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How reviews agree with what is found: (topic, part, pages, labelled, flagged, both) over the pages that were reviewed.

    A page is labelled with a topic if at least half of its reviews say so. part: doc_id modulo 2, so that whoever changes the
    lexicon with one half in view can measure on the other.
    """
    reviews = read(spark, d, "review_labels").filter("label is not null").dropDuplicates()
    votes = reviews.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum((F.col("label") == t).cast("int")).alias(t) for t in abuse.TOPICS))
    asked = votes.select("doc_id", F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), (2 * F.col(t) >= F.col("n")).cast("int").alias("labelled")) for t in abuse.TOPICS))).alias("x")).select("doc_id", "x.*")
    pages = read(spark, d, "documents").join(votes.select("doc_id"), "doc_id", "left_semi")
    got = abuse.found(pages).withColumn("flagged", F.lit(1))
    j = asked.join(got, ["doc_id", "topic"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))
    return j.groupBy("topic", (F.col("doc_id") % 2).cast("int").alias("part")).agg(F.count("*").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("flagged").alias("flagged"), F.sum(F.col("labelled") * F.col("flagged")).alias("both"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_redacted, p2_found, p2_restored, p3_found, p3_normalised, p4_found, p4_pieces, p4_files, p5_found, p5_lines, p5_chunks, p5_unwrapped]
    own += [p6_found, p6_units, p7_found, p7_items, p7_cut, p8_mix, p8_order, p8_shares, p9_found, p9_scores, p9_rates, p9_agreement]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
            with limits as (select distinct doc_id, chunk_chars from rag_documents),
            big as (
                select distinct c.doc_id, c.chunk_id, c.text, coalesce(l.chunk_chars, 1200) as most
                from rag_chunks c left join limits l using (doc_id)
                where length(c.text) > coalesce(l.chunk_chars, 1200)
            )
            select distinct doc_id, chunk_id,
                case when list_max(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: length(x))) > most then 'hard' else 'soft' end as cut
            from big""",
        "p5_found": r"""
            with place as (select distinct doc_id, split_part(path, '/', 1) as site from rag_documents where path is not null),
            total as (select site, count(*) as total from place group by site),
            chunk as (select distinct id, doc_id, text from rag_chunks where text is not null),
            numbered as (select id, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from chunk),
            line as (
                select n.id, n.doc_id, p.site, n.line_no, regexp_replace(lower(n.line), '[\s\p{Z}\p{Nd}]', '', 'g') as key
                from numbered n join place p using (doc_id)
                where regexp_replace(n.line, '[\s\p{Z}]', '', 'g') <> ''
            ),
            often as (
                select l.site, l.key from line l join total t using (site) group by l.site, l.key, t.total
                having count(distinct l.doc_id) >= 4 and count(distinct l.doc_id) >= 0.3::double * t.total
            )
            select distinct l.id, cast(l.line_no as integer) as line_no from line l join often o on l.site = o.site and l.key = o.key""",
    }
