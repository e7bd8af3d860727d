"""Queries of retrieval: sparse, dense, fusion, tiers, evidence, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators import catalog, retrieval
from tidemark.plans.base import Registry, table

QUERIES = Registry()


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").dropDuplicates(["key"])


def _asked(spark, d):
    return table(spark, d, "bench_cases").select(F.col("id").alias("qid"), "text")


_INDEX = """
    with doc as (select doc_id as key, any_value(text) as text from documents group by doc_id),
    tok as (select key, unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) as term from doc),
    dl as (select key, coalesce(len(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')), 0) as dl from doc),
    post as (select term, key, count(*) as tf from tok group by term, key),
    st as (select count(*) as n, avg(len(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')))::double as avgdl from doc),
    df as (select term, count(*) as df from post group by term),
    idf as (select term, df, ln((n - df + 5e-1) / (df + 5e-1) + 1e0) as idf from df, st)"""
_BM25 = (
    _INDEX
    + """,
    q as (select id as qid, unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) as term from bench_cases),
    qf as (select qid, term, count(*) as qf from q group by qid, term),
    score as (select qid, key, sum(qf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) as score from qf join post using (term) join idf using (term) join dl using (key), st group by qid, key),
    ranked as (select *, row_number() over (partition by qid order by round(score, 6) desc, key) as rank from score)"""
)


@QUERIES.add(_INDEX + " select term, df, round(idf, 9) as idf from idf")
def bm25_idf(spark, d):
    docs = _docs(spark, d)
    tokens = T.words(F.col("text"))
    got = retrieval.idf(retrieval.postings(docs, tokens), retrieval.collection(docs, tokens))
    return got.select("term", "df", F.round("idf", 9).alias("idf"))


@QUERIES.add(_BM25 + " select qid, key, cast(rank as integer) as rank, round(score, 6) as score from ranked where rank <= 5")
def bm25_topk(spark, d):
    s = retrieval.bm25_top_k(_asked(spark, d), _docs(spark, d), T.words(F.col("text")), 5)
    return retrieval.top_k(s, 5, "rank")


_HASH = """
    with doc as (select id as key, text from bench_cases),
    tok as (select key, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿа-яё0-9_-]{2,}')) as term from doc),
    slot as (select key, cast(('0x' || substr(md5(term), 14, 3))::integer % 64 as integer) as slot, count(*) as c from tok group by all),
    norm as (select key, sqrt(sum(c * c)::double) as norm from slot group by key)"""


@QUERIES.add(_HASH + " select s.key, s.slot, round(s.c / n.norm, 9) as weight from slot s join norm n using (key)")
def hash_vectors(spark, d):
    t = table(spark, d, "bench_cases").select(F.col("id").alias("key"), "text")
    v = retrieval.hashed(t, 64).select("key", F.posexplode("vec").alias("slot", "weight"))
    return v.filter("weight <> 0").select("key", "slot", F.round("weight", 9).alias("weight"))


_EMB = """
    with e as (select vec_id as key, list_transform(embedding, lambda x: x::double) as v from embeddings),
    u as (select key, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from e),
    s as (select q.key as qid, r.key, round(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])), 6) as score from u q join u r on q.key <> r.key where q.key % 50 = 0),
    k as (select *, row_number() over (partition by qid order by score desc, key) as rank from s)"""


def _embedding_hits(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    q = e.filter("key % 50 = 0").select(F.col("key").alias("qid"), "vec")
    return retrieval.cosine_top_k(q, e, 10).withColumn("score", F.round("score", 6))


@QUERIES.add(_EMB + " select qid, key, score from k where rank <= 5")
def embedding_cosine_topk(spark, d):
    """The five nearest rows of every row whose id is divisible by 50, against all rows."""
    return retrieval.top_k(_embedding_hits(spark, d), 5)


@QUERIES.add(_EMB + " select k.qid, round(avg(case when a.label = b.label then 1.0::double else 0.0::double end), 4) as purity from k join embeddings a on a.vec_id = k.qid join embeddings b on b.vec_id = k.key where rank <= 5 group by k.qid")
def embedding_label_purity(spark, d):
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    hits = retrieval.top_k(_embedding_hits(spark, d), 5).join(lab, "key").join(lab.select(F.col("key").alias("qid"), F.col("label").alias("own")), "qid")
    return hits.groupBy("qid").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 4).alias("purity"))


def _chunk_hits(spark, d):
    """Stored chunk vectors: the nearest chunks of every chunk whose id is divisible by 50. Vectors of zeros have no direction and are left out."""
    c = table(spark, d, "rag_chunks").select(F.col("id").alias("key"), F.col("vec")).filter(F.exists("vec", lambda x: x != 0)).dropDuplicates(["key"])
    return retrieval.cosine_top_k(c.filter("key % 50 = 0").select(F.col("key").alias("qid"), "vec"), c, 5)


@QUERIES.add(
    """with c as (select id as key, any_value(vec) as vec from rag_chunks where vec is not null group by id),
    u as (select key, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) as v from c where list_sum(list_transform(vec, lambda y: y * y)) > 0),
    s as (select q.key as qid, r.key, round(list_inner_product(q.v, r.v), 9) as score from u q join u r on q.key <> r.key and len(q.v) = len(r.v) where q.key % 50 = 0),
    k as (select *, row_number() over (partition by qid order by score desc, key) as rank from s)
    select qid, key, round(score, 6) as score from k where rank <= 5"""
)
def chunk_vector_topk(spark, d):
    return _chunk_hits(spark, d).select("qid", "key", F.round("score", 6).alias("score"))


@QUERIES.add(
    _BM25
    + """, a as (select qid, key, row_number() over (partition by qid order by round(score, 6) desc, key) as r from score),
    b as (select qid, key, row_number() over (partition by qid order by round(score / dl, 9) desc, key) as r from score join dl using (key)),
    f as (select qid, key, sum(1e0 / (60 + r)) as score from (select * from a where r <= 20 union all select * from b where r <= 20) group by qid, key),
    k as (select *, row_number() over (partition by qid order by round(score, 9) desc, key) as rank from f)
    select qid, key, round(score, 9) as score from k where rank <= 5"""
)
def rrf_fusion(spark, d):
    """BM25 fused with BM25 for the length of the page."""
    asked, docs, tokens = _asked(spark, d), _docs(spark, d), T.words(F.col("text"))
    both = retrieval.bm25_scores(asked, docs, tokens, 20, {"whole": (6, False), "per word": (9, True)})
    r = F.row_number().over(Window.partitionBy("kind", "qid").orderBy(F.desc("score"), "key"))
    pool = both.withColumn("r", r).filter("r <= 20").withColumn("score", F.lit(1.0) / (retrieval.RRF_K + F.col("r")))
    f = pool.groupBy("qid", "key").agg(F.round(F.sum("score"), 9).alias("score"))
    return retrieval.top_k(f, 5)


_PHRASES = "(select id as qid, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё]+'), 3, 5), ' ') as phrase from bench_cases)"


def _phrases(spark, d):
    w = F.slice(F.regexp_extract_all("text", F.lit(f"[{T.LETTER}]+"), F.lit(0)), 3, 3)
    return table(spark, d, "bench_cases").select(F.col("id").alias("qid"), F.array_join(w, " ").alias("phrase"))


@QUERIES.add(
    f"""with doc as (select doc_id as key, lower(any_value(text)) as text from documents group by doc_id), ph as (select qid, lower(phrase) as phrase from {_PHRASES} p),
    hit as (select p.qid, d.key, string_split(' ' || d.text || ' ', p.phrase) as parts from ph p join doc d on contains(d.text, p.phrase))
    select qid, key from hit where len(list_filter(range(1, len(parts)), lambda i: not regexp_matches(parts[i], '[\\p{{L}}\\p{{N}}_]$') and not regexp_matches(parts[i + 1], '^[\\p{{L}}\\p{{N}}_]'))) > 0"""
)
def contains_exact_phrase(spark, d):
    """The exact tier over all hits: pages that hold three given words as a phrase, found through the postings of the words."""
    got = retrieval.tiered(_phrases(spark, d), _docs(spark, d), 1_000_000_000)
    return got.filter("tier = 1").select("qid", "key")


@QUERIES.add(
    _INDEX
    + f""",
    ph as (select qid, lower(phrase) as phrase, regexp_extract_all(translate(lower(phrase), 'ё', 'е'), '[a-zа-я0-9]+') as w from {_PHRASES} p),
    qf as (select qid, phrase, len(list_distinct(w)) as m, term, count(*) as qf from (select qid, phrase, w, unnest(w) as term from ph) group by all),
    every as (select qid, phrase, key, sum(qf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) as score from qf join post using (term) join idf using (term) join dl using (key), st group by qid, phrase, m, key having count(*) = m),
    hit as (select e.*, string_split(' ' || lower(d.text) || ' ', e.phrase) as parts from every e join doc d using (key)),
    tier as (select qid, key, score, len(list_filter(range(1, len(parts)), lambda i: not regexp_matches(parts[i], '[\\p{{L}}\\p{{N}}_]$') and not regexp_matches(parts[i + 1], '^[\\p{{L}}\\p{{N}}_]'))) > 0 as whole from hit),
    ranked as (select qid, key, case when whole then 1 else 2 end as tier, case when whole then 1e0 else 95e-2 - least(row_number() over (partition by qid order by round(score, 6) desc, key), 100) * 1e-3 end as score from tier),
    k as (select *, row_number() over (partition by qid order by tier, score desc, key) as r from ranked)
    select qid, key, tier, round(score, 4) as score from k where r <= 10"""
)
def tiered_search(spark, d):
    return retrieval.tiered(_phrases(spark, d), _docs(spark, d), 10).select("qid", "key", "tier", F.round("score", 4).alias("score"))


@QUERIES.add(
    """with h as (select user_id as req, event_id % 5 as qi, case event_type when 'purchase' then 'exact' when 'view' then 'lexical' else 'semantic' end as kind, event_id % 12 as rank, event_id % 37 as key from events),
    s as (select req, key, sum(case kind when 'exact' then 3e0 / (qi + 1) when 'lexical' then 2e0 / (qi + rank + 1) else 1e0 / (rank + 1) end) as score from h group by req, key),
    k as (select *, row_number() over (partition by req order by round(score, 9) desc, key) as r from s)
    select req, key, round(score, 6) as score from k where r <= 3"""
)
def evidence_accumulate(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "exact").when(F.col("event_type") == "view", "lexical").otherwise("semantic")
    e = F.col("event_id")
    h = table(spark, d, "events").select(F.col("user_id").alias("req"), (e % 5).alias("qi"), kind.alias("kind"), (e % 12).alias("rank"), (e % 37).alias("key"))
    s = retrieval.evidence(h, 1_000_000_000).withColumn("score", F.round("score", 9)).withColumnRenamed("req", "qid")
    return retrieval.top_k(s, 3).select(F.col("qid").alias("req"), "key", F.round("score", 6).alias("score"))


_TWO = """
    with cat as (select doc_id, any_value(file_hash) as file_hash, any_value(status) as status from rag_documents where not regexp_matches(doc_id, '3$') group by doc_id),
    seen as (select doc_id, any_value(case when doc_id like '%7' then 'x' || file_hash else file_hash end) as file_hash from rag_documents where not regexp_matches(doc_id, '5$') group by doc_id),
    st as (select coalesce(c.doc_id, s.doc_id) as doc_id, c.status, case when c.doc_id is null then 'new' when s.doc_id is null then 'missing' when c.file_hash = s.file_hash then 'unchanged' else 'changed' end as state
        from cat c full join seen s on c.doc_id = s.doc_id)"""


def _states(spark, d):
    r = table(spark, d, "rag_documents").select("doc_id", "file_hash", "status").dropDuplicates(["doc_id"])
    cat = r.filter(~F.col("doc_id").endswith("3"))
    seen = r.filter(~F.col("doc_id").endswith("5")).withColumn("file_hash", F.when(F.col("doc_id").endswith("7"), F.concat(F.lit("x"), "file_hash")).otherwise(F.col("file_hash")))
    return catalog.diff(seen, cat)


@QUERIES.add(_TWO + " select doc_id, state from st")
def snapshot_sync_plan(spark, d):
    return _states(spark, d).select("doc_id", "state")


@QUERIES.add(_TWO + " select doc_id, state from st where state in ('new', 'changed') or state = 'unchanged' and status <> 'active'")
def sync_to_process(spark, d):
    return catalog.to_process(_states(spark, d))


@QUERIES.add(_TWO + """, o as (select case state when 'new' then 'added' when 'changed' then 'updated' when 'missing' then 'missing' else case when status = 'active' then 'unchanged' else 'updated' end end as operation from st)
    select operation, count(*) as documents from o group by operation""")
def sync_summary(spark, d):
    return catalog.summary(_states(spark, d))


@QUERIES.add(
    """with c as (select doc_id, chunk_id, any_value(text) as text from rag_chunks group by doc_id, chunk_id), d as (select doc_id, any_value(path) as path, any_value(version) as version from rag_documents where status = 'active' group by doc_id)
    select c.doc_id, c.chunk_id, d.path, d.version, length(c.text) as n from c join d using (doc_id)"""
)
def active_chunks(spark, d):
    got = catalog.active_chunks(table(spark, d, "rag_chunks"), table(spark, d, "rag_documents"))
    return got.select("doc_id", "chunk_id", "path", "version", F.length("text").cast("long").alias("n"))


@QUERIES.add("select distinct doc_id from rag_documents d where status = 'active' and not exists (select 1 from rag_chunks c where c.chunk_id > 0 and c.doc_id = d.doc_id)")
def documents_without_chunks(spark, d):
    """Active documents without a chunk behind the first."""
    return catalog.without_active(table(spark, d, "rag_documents"), table(spark, d, "rag_chunks").filter("chunk_id > 0")).distinct()


@QUERIES.add(
    """with n as (select doc_id, count(distinct chunk_id) as stored from rag_chunks group by doc_id), d as (select distinct doc_id, chunks as declared from rag_documents)
    select d.doc_id, d.declared, coalesce(n.stored, 0) as stored from d left join n using (doc_id) where d.declared is distinct from coalesce(n.stored, 0)"""
)
def declared_chunks(spark, d):
    r = table(spark, d, "rag_documents").select("doc_id", "chunks").distinct()
    return catalog.declared_against_stored(r, table(spark, d, "rag_chunks"))


@QUERIES.add(
    """with c as (select doc_id, chunk_id, any_value(length(text)) as n from rag_chunks where text is not null group by doc_id, chunk_id)
    select doc_id, chunk_id, cast(sum(n + 1) over (partition by doc_id order by chunk_id) - n - 1 as bigint) as start, n from c"""
)
def show_document(spark, d):
    """Every document laid out from its chunks: where each begins."""
    return catalog.offsets(table(spark, d, "rag_chunks"))


@QUERIES.add(
    """with c as (select id, any_value(text) as text from rag_chunks where text is not null group by id), t as (select id, text, ['регламент', 'ledger', 'registre', 'waage'] as terms from c),
    p as (select id, text, list_min(list_filter(list_transform(terms, lambda t: instr(lower(text), t)), lambda x: x > 0)) as pos from t)
    select id, substr(text, greatest(coalesce(pos, 1) - 180, 1), 650) as excerpt from p"""
)
def evidence_excerpt(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "text").dropDuplicates(["id"]).filter("text is not null")
    terms = F.array(*map(F.lit, ("регламент", "ledger", "registre", "waage")))
    return c.select("id", T.excerpt(F.col("text"), terms).alias("excerpt"))
