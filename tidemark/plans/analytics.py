"""Queries of the audit log, corpus preparation, events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, corpus, evaluate
from tidemark.plans.base import Registry, table
from tidemark.streaming import events as streams

QUERIES = Registry()

LOG = "(select distinct * from audit_events)"


def _log(spark, d):
    return table(spark, d, "audit_events").dropDuplicates(["id"])


def _stats_sql(by: str) -> str:
    g = f" group by {by}" if by else ""
    return f"""with a as {LOG}, c as (select max(ts) - interval 30 days as cut from a)
        select {by + ',' if by else ''} count(*) as total, count(*) filter (where ok) as succeeded, count(*) - count(*) filter (where ok) as failed,
            round(avg(duration_ms), 1) as mean_ms, round(avg(changes_count), 2) as mean_changes from a, c where ts >= cut{g}"""


def _recent(spark, d, *by):
    cut = table(spark, d, "audit_events").agg((F.max("ts") - F.expr("interval 30 days")).alias("cut")).scalar()
    # The window reaches the scan; repeated rows are full copies, so what is left of them still meets.
    recent = table(spark, d, "audit_events").filter(F.col("ts") >= cut)
    return audit.window_stats(recent.dropDuplicates(["id"]), cut, *by)


@QUERIES.add(_stats_sql(""))
def audit_stats_window(spark, d):
    return _recent(spark, d)


@QUERIES.add(_stats_sql("server, model"))
def audit_stats_by_server(spark, d):
    return _recent(spark, d, "server", "model")


@QUERIES.add(
    f"""with a as {LOG}, c as (select max(ts) - interval 180 days as cut from a)
    select date_trunc('month', ts) as month, count(*) as kept from a, c where ts >= cut group by 1"""
)
def audit_retention_purge(spark, d):
    now = table(spark, d, "audit_events").agg(F.max("ts")).scalar()
    kept = audit.retain(table(spark, d, "audit_events"), now, 180).dropDuplicates(["id"])
    return kept.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("kept"))


@QUERIES.add(
    """with s as (select distinct seg_id, text, lang from segments)
    select seg_id, length(coalesce(text, '')) as text_len, length(coalesce(lang, '')) as context_len, case when coalesce(text, '') = '' then '' else sha1(text) end as text_sha1, substr(coalesce(text, ''), 1, 200) as text_snippet from s"""
)
def audit_record(spark, d):
    s = table(spark, d, "segments").select("seg_id", "text", F.col("lang").alias("context")).distinct()
    rows = audit.record(s.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "error": F.lit(None).cast("string")}))
    return rows.select("seg_id", F.col("text_len").cast("long").alias("text_len"), F.col("context_len").cast("long").alias("context_len"), "text_sha1", "text_snippet")


@QUERIES.add(
    f"""with a as {LOG} select server, list_sort(list(duration_ms))[greatest(1, cast(floor(0.95 * count(duration_ms)) as integer))] as p95, count(duration_ms) as n from a where duration_ms is not null group by server"""
)
def latency_p95(spark, d):
    return evaluate.exact_p95(_log(spark, d), "duration_ms", "server")


@QUERIES.add(
    f"""with a as {LOG} select id, server, round(avg(duration_ms) over (partition by server order by ts, id rows between 199 preceding and current row), 4) as trailing_ms from a"""
)
def trailing_200(spark, d):
    return audit.trailing_mean(_log(spark, d), 200)


@QUERIES.add(f"with a as {LOG} select user_agent, count(*) as n from a where user_agent is not null group by user_agent order by n desc, user_agent limit 5")
def top_user_agents(spark, d):
    return audit.top_values(_log(spark, d), "user_agent", 5)


@QUERIES.add(
    f"""with a as {LOG} select coalesce(server, '*') as server, coalesce(model, '*') as model, count(*) as requests, round(avg(case when ok then 1.0::double else 0.0::double end), 4) as rate
    from (select coalesce(server, 'unspecified') as server, coalesce(nullif(model, ''), 'unspecified') as model, ok from a) group by rollup(server, model)"""
)
def audit_success_rate(spark, d):
    a = _log(spark, d).select(F.coalesce("server", F.lit("unspecified")).alias("server"), F.coalesce(F.nullif("model", F.lit("")), F.lit("unspecified")).alias("model"), "ok")
    g = a.rollup("server", "model").agg(F.count("*").alias("requests"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("rate"))
    return g.select(F.coalesce("server", F.lit("*")).alias("server"), F.coalesce("model", F.lit("*")).alias("model"), "requests", "rate")


@QUERIES.add("with d as (select distinct doc_id, text from documents) select doc_id, min(doc_id) over (partition by coalesce(text, '')) as first, count(*) over (partition by coalesce(text, '')) as copies from d")
def dedup_exact_sha256(spark, d):
    return corpus.exact_duplicates(table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id", "text")


@QUERIES.add(
    """with e as (select distinct id, text from eval_cases), k as (select text from e where id like '%0'), n as (select text, min(id) as id from e where id not like '%0' and text is not null group by text)
    select id, text from n where text not in (select text from k where text is not null)"""
)
def dedup_anti_join(spark, d):
    e = table(spark, d, "eval_cases").select("id", "text").distinct().filter("text is not null")
    return corpus.new_only(e.filter(~F.col("id").endswith("0")), e.filter(F.col("id").endswith("0")), "text", "id")


@QUERIES.add("select id, category from (select id, category, row_number() over (partition by category order by id) as n from bench_cases) where n <= 20")
def category_balance(spark, d):
    return corpus.balanced(table(spark, d, "bench_cases"), "category", "id", 20).select("id", "category")


@QUERIES.add("select distinct id from eval_cases where length(text) between 30 and 400 and not regexp_matches(lower(text), 'пломб|mr\\.|насос')")
def corpus_selection(spark, d):
    return corpus.select_pairs(table(spark, d, "eval_cases"), F.col("text"), 30, 400, r"пломб|mr\.|насос").select("id").distinct()


@QUERIES.add(
    """with d as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id), w as (select doc_id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+') as w from d)
    select doc_id, cast(len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 2] and w[i + 1] = w[i + 3] and (length(w[i]) >= 4 or length(w[i + 1]) >= 4))) as integer) as repeats from w"""
)
def repeated_ngrams(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).filter("text is not null")
    return corpus.repeated_ngrams(t, 2)


@QUERIES.add("select p_brand, min(p_type) as p_type from part where p_size < 3 group by p_brand having count(distinct p_type) = 1")
def alias_unambiguous(spark, d):
    return corpus.unambiguous(table(spark, d, "part").filter("p_size < 3"), "p_brand", "p_type")


@QUERIES.add("select n_name, s_name from nation, supplier where s_nationkey = n_nationkey and levenshtein(lower(n_name), lower(substr(s_name, 1, length(n_name)))) <= length(n_name)")
def alias_levenshtein(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    j = n.join(s, n.n_nationkey == s.s_nationkey)
    return j.filter(F.levenshtein(F.lower("n_name"), F.lower(F.substr("s_name", F.lit(1), F.length("n_name")))) <= F.length("n_name")).select("n_name", "s_name")


@QUERIES.add("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@QUERIES.add("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark, d):
    g = streams.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")
    return g.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@QUERIES.add(
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, k"""
)
def event_session(spark, d):
    return streams.sessions(table(spark, d, "events"), "30 minutes")


@QUERIES.add("select time_bucket(interval 1 day, ts) as day, count(*) as n from events group by 1")
def event_watermark_stream(spark, d):
    """The daily counts, made by a stream over the table that is driven to its end."""
    return streams.daily_counts(spark, f"{d}/events.parquet")


@QUERIES.add(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def star_pricing(spark, d):
    return (
        table(spark, d, "lineitem")
        .filter("l_shipdate <= timestamp_ntz '1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


@QUERIES.add(
    """select n_name, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey where o_orderstatus = 'F' group by n_name"""
)
def star_nation_revenue(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    j = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@QUERIES.add("select c_mktsegment, count(*) as idle from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= date '2001-06-01') group by 1")
def star_idle_customers(spark, d):
    """Customers without an order since a day."""
    recent = table(spark, d, "orders").filter("o_orderdate >= date'2001-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").join(recent, "c_custkey", "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("idle"))


@QUERIES.add("select coalesce(p_brand, '*') as brand, coalesce(cast(p_size as varchar), '*') as size, count(*) as parts, round(sum(p_retailprice), 2) as price from part group by cube(p_brand, p_size)")
def star_part_cube(spark, d):
    g = table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    return g.select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce(F.col("p_size").cast("string"), F.lit("*")).alias("size"), "parts", "price")


@QUERIES.add(
    """with l as (select distinct doc_id, rater, label from review_labels where label is not null), g as (select doc_id, count(distinct label) as labels, count(*) as n, max(case when label <> 'none' then 1 else 0 end) as flagged from l group by doc_id),
    d as (select doc_id, any_value(source) as source from documents group by doc_id)
    select source, count(*) as reviewed, sum(flagged)::bigint as flagged, count(*) filter (where labels > 1) as disputed from g join d using (doc_id) group by source"""
)
def label_quality_report(spark, d):
    lab = table(spark, d, "review_labels").filter("label is not null").select("doc_id", "rater", "label").distinct()
    g = lab.groupBy("doc_id").agg(F.countDistinct("label").alias("labels"), F.max((F.col("label") != "none").cast("long")).alias("flagged"))
    docs = table(spark, d, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    return g.join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("reviewed"), F.sum("flagged").alias("flagged"), F.count_if(F.col("labels") > 1).alias("disputed"))
