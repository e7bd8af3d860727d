"""Retrieval: inverted index, BM25, hashed and dense vectors, rank fusion, tiered search, evidence.

Scores use double literals throughout (Spark's decimals would round). Ties are broken by key, never by input order.
Query sides are the stated query sets; documents are never joined to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T

K1, B = 1.5, 0.75
RRF_K = 60
QUERY_BLOCK_BYTES = 64 << 20
QUERY_TILE, ROW_TILE, PAIRS = 512, 2048, 1 << 14


# ---- sparse ------------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """docs (key, text) -> (term, key, tf, dl). Term counts are made inside each document, so no shuffle is needed."""
    t = docs.select("key", tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    return t.select("key", "dl", F.explode("tokens").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf")).select("term", "key", "tf", "dl")


def collection(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents, empty ones included, and their average length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens).cast("double")).alias("avgdl"))


def idf(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    n = stats.select("n").scalar()
    return df.select("term", "df", F.log((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0)).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, tokens: Column, k: int | None = None) -> DataFrame:
    """queries (qid, text), docs (key, text) -> (qid, key, score), the best k for each query if k is given.

    Repeated query terms count repeatedly. Postings meet the query terms in one equi-join on the term; only terms of the
    queries survive the semi-join that precedes it, so that the index is pruned before it is shuffled.
    """
    q = queries.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))
    wanted = q.select("term").distinct()
    index = postings(docs, tokens).join(wanted, "term", "left_semi")
    stats = collection(docs, tokens)
    avgdl = stats.select("avgdl").scalar()
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1.0) / (tf + K1 * (F.lit(1.0 - B) + B * F.col("dl") / avgdl))
    weighted = index.join(idf(index, stats), "term").select("term", "key", part.alias("part"))
    scores = q.join(weighted, "term").groupBy("qid", "key").agg(F.sum(F.col("qf") * F.col("part")).alias("score"))
    return top_k(scores, k) if k else scores


def bm25_top_k(queries: DataFrame, docs: DataFrame, tokens: Column, k: int, digits: int = 6, per_word: bool = False) -> DataFrame:
    """The best k documents of each query by rounded BM25 score, ties by key; per_word: by the score for the length of the document."""
    return top_k(bm25_scores(queries, docs, tokens, k, {"score": (digits, per_word)}).drop("kind"), k)


def bm25_scores(queries: DataFrame, docs: DataFrame, tokens: Column, k: int, kinds: dict[str, tuple[int, bool]]) -> DataFrame:
    """(kind, qid, key, score): for each kind, (digits, whether by the length of the document), at least the best k of each query; one
    pass over the documents serves all kinds.

    The query set meets the corpus in blocks of queries whose weight matrix is held to QUERY_BLOCK_BYTES: every document is
    read once for each block, its scores against all queries of the block are one sparse product, and a task keeps its best k
    for each query. So the shuffle holds k rows for each query and task, however large the corpus, where a join of postings
    would shuffle a row for each query and document. Document frequencies are taken over all documents beforehand.
    """
    counts: dict = {}
    for qid, terms in queries.select("qid", tokens.alias("terms")).toLocalIterator():
        c: dict = {}
        for t in terms or ():
            c[t] = c.get(t, 0) + 1
        if c:
            counts[qid] = c
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(tokens), F.lit(0)).cast("double")).alias("avgdl")).first()
    out = None
    for block in _query_blocks(counts):
        got = _bm25_scan(docs, tokens, block, stats.n, stats.avgdl or 1.0, k, kinds)
        out = got if out is None else out.unionByName(got)
    if out is None:
        types = dict(queries.dtypes)["qid"], dict(docs.dtypes)["key"]
        return docs.sparkSession.createDataFrame([], f"kind string, qid {types[0]}, key {types[1]}, score double")
    return out


def _best(state: tuple[np.ndarray, np.ndarray], s: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k (score, key) of each row of a state and of new scores; ties by key."""
    s, kk = np.hstack([state[0], s]), np.hstack([state[1], np.broadcast_to(keys, s.shape)])
    if s.shape[1] <= k:
        return s, kk
    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    keep_s, keep_k = np.full((len(s), k), -np.inf), np.empty((len(s), k), dtype=object)
    for q in range(len(s)):
        own = np.flatnonzero((s[q] >= edge[q]) & np.isfinite(s[q]))
        own = sorted(own, key=lambda c: (-s[q, c], kk[q, c]))[:k]
        keep_s[q, : len(own)], keep_k[q, : len(own)] = s[q, own], kk[q, own]
    return keep_s, keep_k


def _query_blocks(counts: dict) -> Iterator[list[tuple[object, dict]]]:
    block: list[tuple[object, dict]] = []
    terms: set = set()
    for qid, c in counts.items():
        if block and (len(block) + 1) * len(terms | c.keys()) * 8 > QUERY_BLOCK_BYTES:
            yield block
            block, terms = [], set()
        block.append((qid, c))
        terms |= c.keys()
    if block:
        yield block


def _bm25_scan(docs: DataFrame, tokens: Column, block: list[tuple[object, dict]], n: int, avgdl: float, k: int, kinds: dict[str, tuple[int, bool]]) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
    spark = docs.sparkSession
    words = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    held = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).join(words, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = np.zeros((len(vocabulary), len(block)))
    for term, df in held.collect():  # at most the words of the block
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        for q, (_, c) in enumerate(block):
            if term in c:
                weight[vocabulary[term], q] = idf * c[term]
    names = [qid for qid, _ in block]
    key_kind = dict(docs.dtypes)["key"]
    qkind = "string" if isinstance(names[0], str) else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {kind: (np.full((len(names), 0), -np.inf), np.empty((len(names), 0), dtype=object)) for kind in kinds}
        terms = pa.array(list(vocabulary))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = np.asarray(part.column(0).to_pylist(), dtype=object)
                lists = part.column(1)
                # Words become numbers of the vocabulary in one call; the rows they stand in come from the lengths of the lists.
                at = pc.index_in(lists.flatten(), terms).to_numpy(zero_copy_only=False)
                dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.float64)
                row = np.repeat(np.arange(len(keys)), dl.astype(np.int64))
                known = ~np.isnan(at.astype(np.float64))
                cell = row[known] * len(vocabulary) + at[known].astype(np.int64)
                tf = np.bincount(cell, minlength=len(keys) * len(vocabulary)).reshape(len(keys), -1).astype(np.float64)
                d, t = np.nonzero(tf)
                f = tf[d, t]
                tf[d, t] = f * (K1 + 1.0) / (f + K1 * (1.0 - B + B * dl[d] / avgdl))
                s = (tf @ weight).T
                for kind, (digits, per_word) in kinds.items():
                    own = np.round(s / np.where(dl == 0, 1.0, dl) if per_word else s, digits)
                    own[own <= 0] = -np.inf
                    best[kind] = _best(best[kind], own, keys, k)
        for kind, (s, kk) in best.items():
            q, c = np.nonzero(np.isfinite(s))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(q)), pa.array([names[i] for i in q]), pa.array(kk[q, c].tolist()), pa.array(s[q, c])], names=["kind", "qid", "key", "score"])

    return docs.select("key", tokens.alias("terms")).mapInArrow(run, f"kind string, qid {qkind}, key {key_kind}, score double")


def top_k(scores: DataFrame, k: int, rank: str | None = None) -> DataFrame:
    """The best k keys of each query by (score, key); Spark pre-ranks in each task before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    ranked = scores.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def both_indexes(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Word and trigram scores added, zeros dropped."""
    q, d = queries.select("qid", "text"), docs.select("key", "text")
    both = bm25(q, d, T.words(F.col("text"))).unionByName(bm25(q, d, T.trigrams(F.col("text"))))
    return top_k(both.groupBy("qid", "key").agg(F.sum("score").alias("score")).filter("score > 0"), k)


# ---- dense -------------------------------------------------------------------------------------------------------------


def hashed(docs: DataFrame, dim: int) -> DataFrame:
    """(key, text) -> (key, vec, norm): counts of hashed tokens, length one; the norm of a zero vector is taken as one."""
    counts = (
        docs.select("key", F.explode_outer(T.hash_words(F.col("text"))).alias("term"))
        .withColumn("slot", T.bucket(F.col("term"), dim))
        .groupBy("key", "slot")
        .agg(F.count("term").alias("c"))
    )
    slots = counts.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", F.col("c").cast("double"))))).alias("m"),
        F.sqrt(F.sum(F.when(F.col("slot").isNotNull(), F.col("c") * F.col("c")).otherwise(0)).cast("double")).alias("norm"),
    )
    safe = F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / safe)
    return slots.select("key", vec.alias("vec"), safe.alias("norm"))


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, same: bool = False) -> DataFrame:
    """queries (qid, vec), rows (key, vec) -> (qid, key, score): exact cosine, the best k of all rows for each query.

    The query set is collected in blocks of at most QUERY_BLOCK_BYTES and meets every row once, in matrix products of at most
    QUERY_TILE queries and ROW_TILE rows. A task keeps its best k for each query; only those candidates are shuffled. Vectors of another
    dimension, null vectors and null keys never match. same: whether a row may answer its own query.
    """
    out = None
    for ids, matrix in _blocks(queries):
        got = _scan(rows, ids, matrix, k, same)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.sparkSession.createDataFrame([], "qid long, key long, score double")
    return top_k(out, k)


def _blocks(queries: DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
    ids: list[int] = []
    vecs: list[np.ndarray] = []
    for qid, vec in queries.filter("qid is not null and vec is not null").select("qid", "vec").toLocalIterator():
        if ids and (len(vec) != len(vecs[0]) or len(ids) * len(vec) * 8 > QUERY_BLOCK_BYTES):
            yield ids, _unit(np.asarray(vecs, dtype=np.float64))
            ids, vecs = [], []
        ids.append(qid)
        vecs.append(np.asarray(vec, dtype=np.float64))
    if ids:
        yield ids, _unit(np.asarray(vecs, dtype=np.float64))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _scan(rows: DataFrame, ids: list[int], matrix: np.ndarray, k: int, same: bool) -> DataFrame:
    order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
    qids, matrix = np.asarray(ids, dtype=np.int64)[order], matrix[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(qids, matrix, k, same)
        for batch in batches:
            vec = batch.column(1)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            sizes = np.asarray(vec.value_lengths())
            if (sizes != matrix.shape[1]).any():
                own = np.flatnonzero(sizes == matrix.shape[1])
                flat = np.concatenate([vec[int(i)].values.to_numpy(zero_copy_only=False) for i in own]) if len(own) else np.empty(0)
                keys = keys[own]
            if not len(keys):
                continue
            unit = _unit(flat.reshape(len(keys), -1).astype(np.float64))
            for r in range(0, len(keys), ROW_TILE):
                best.add(keys[r : r + ROW_TILE], unit[r : r + ROW_TILE])
        real = np.flatnonzero(np.isfinite(best.score.ravel()))
        for at in range(0, len(real), 1 << 16):
            i = real[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(qids[i // k]), pa.array(best.key.ravel()[i]), pa.array(best.score.ravel()[i])], names=["qid", "key", "score"])

    return rows.filter("key is not null and vec is not null").select(F.col("key").cast("long"), "vec").mapInArrow(run, "qid long, key long, score double")


class _Nearest:
    """The best k (score, key) of each query over the rows added so far; ties by key. qids must be sorted.

    Products are made in single precision, tile by tile, so memory doesn't grow with queries or rows. Whatever lies within the
    error of such a product below a query's k-th score so far is scored again in double precision: the result is exact.
    """

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int, same: bool):
        self.qids, self.matrix, self.k, self.same = qids, matrix, k, same
        self.single = matrix.astype(np.float32)
        self.slack = (matrix.shape[1] + 8) * 2.0**-23  # unit vectors: rounding of both, of their product and of the score to nine digits
        self.score, self.key = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), dtype=np.int64)
        self.floor = np.full(len(qids), -np.inf, dtype=np.float32)

    def add(self, keys: np.ndarray, unit: np.ndarray) -> None:
        needed = self._needed(keys, unit)
        keys, unit = keys[needed], unit[needed]
        n, single = len(keys), np.ascontiguousarray(unit.astype(np.float32).T)
        products, hits = np.empty((QUERY_TILE, n), dtype=np.float32), np.zeros((QUERY_TILE, n + -n % 8), dtype=bool)
        first, end = np.searchsorted(self.qids, keys, "left"), np.searchsorted(self.qids, keys, "right")
        own_r = np.repeat(np.arange(n), 0 if self.same else end - first)
        own_q = first[own_r] + np.arange(len(own_r)) - np.searchsorted(own_r, own_r)
        for a in range(0, len(self.qids), QUERY_TILE):
            some = self.single[a : a + QUERY_TILE]
            s, hit, floor = products[: len(some)], hits[: len(some)], self.floor[a : a + QUERY_TILE]
            np.matmul(some, single, out=s)
            own = (own_q >= a) & (own_q < a + len(some))
            s[own_q[own] - a, own_r[own]] = np.nan  # neither a hit nor one of the k best below
            np.greater_equal(s, floor[:, None], out=hit[:, :n])
            at = _few(hit)
            if len(at) > 8 * self.k * len(some) and n > self.k:
                kth = np.partition(np.where(np.isnan(s), -np.inf, s), n - self.k, axis=1)[:, n - self.k]
                np.greater_equal(s, np.maximum(floor, kth - np.float32(2 * self.slack))[:, None], out=hit[:, :n])
                at = _few(hit)
            for c in range(0, len(at), PAIRS):
                q, r = np.divmod(at[c : c + PAIRS], hit.shape[1])
                q += a
                self._merge(q, keys[r], np.round(np.einsum("ij,ij->i", self.matrix[q], unit[r]), 9))

    def _needed(self, keys: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of rows with equal vectors those of the k smallest keys, and all that are queries, as they don't answer themselves."""
        _, vector = np.unique(np.ascontiguousarray(unit).view(np.dtype((np.void, unit.itemsize * unit.shape[1]))).ravel(), return_inverse=True)
        asked = np.isin(keys, self.qids)
        order = np.lexsort((keys, asked, vector))
        vector = vector[order]
        return np.sort(order[asked[order] | (np.arange(len(keys)) - np.searchsorted(vector, vector) < self.k)])

    def _merge(self, q: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        k, old = self.k, np.unique(q)
        q = np.concatenate([np.repeat(old, k), q])
        key, score = np.concatenate([self.key[old].ravel(), key]), np.concatenate([self.score[old].ravel(), score])
        order = np.lexsort((key, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        self.score[q[best], rank[best]], self.key[q[best], rank[best]] = score[order][best], key[order][best]
        self.floor[old] = self.score[old, k - 1] - self.slack


def _few(hit: np.ndarray) -> np.ndarray:
    """np.flatnonzero where little is true: eight flags at a time. The rows must be multiples of eight."""
    some = np.flatnonzero(hit.view(np.uint64).ravel() != 0)
    at, flag = np.nonzero(hit.reshape(-1, 8)[some])
    return some[at] * 8 + flag


def maintain(old: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without the documents of gone (key) and with those of fresh (key, text): what is unchanged is neither read nor counted
    again."""
    return old.join(gone.select("key").distinct(), "key", "left_anti").unionByName(postings(fresh, T.words(F.col("text"))).select(*old.columns))


# ---- fusion and tiers --------------------------------------------------------------------------------------------------


def rrf(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, key, score); a missing side contributes nothing."""
    pool = max(4 * k, 10)
    part = lambda d: top_k(d, pool, "r").select("qid", "key", (F.lit(1.0) / (RRF_K + F.col("r"))).alias("score"))
    fused = part(dense).unionByName(part(sparse)).groupBy("qid", "key").agg(F.sum("score").alias("score"))
    return top_k(fused, k)


def tiered(phrases: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """phrases (qid, phrase), docs (key, text) -> (qid, key, tier, score).

    Tier 1: the phrase stands in the text between non-letters (1.0). Tier 2: all its words stand in it, by BM25 rank over all
    such documents (0.95 - 0.001 rank). A key keeps its first tier. Both tiers start from the postings of the phrase's
    words, so that no phrase meets a document without them.
    """
    q = phrases.select("qid", F.lower("phrase").alias("phrase"), T.words(F.col("phrase")).alias("tokens")).filter(F.size("tokens") > 0)
    terms = q.select("qid", "phrase", F.size(F.array_distinct("tokens")).alias("n"), F.explode("tokens").alias("term")).groupBy("qid", "phrase", "n", "term").agg(F.count("*").alias("qf"))
    tokens = T.words(F.col("text"))
    stats = collection(docs, tokens)
    index = postings(docs, tokens).join(terms.select("term").distinct(), "term", "left_semi")
    tf, avgdl = F.col("tf").cast("double"), stats.select("avgdl").scalar()
    part = F.col("qf") * F.col("idf") * tf * (K1 + 1.0) / (tf + K1 * (F.lit(1.0 - B) + B * F.col("dl") / avgdl))
    # Documents with all words, and their score, in one aggregation.
    every = terms.join(index, "term").join(idf(index, stats), "term").groupBy("qid", "phrase", "n", "key").agg(F.count("*").alias("m"), F.sum(part).alias("score")).filter("m = n")
    texts = every.join(docs.select("key", F.lower("text").alias("text")), "key")
    parts = F.split(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.concat(F.lit(r"\Q"), F.col("phrase"), F.lit(r"\E")))
    free = F.exists(
        F.sequence(F.lit(0), F.size(parts) - 2),
        lambda i: ~F.element_at(parts, i + 1).rlike(r"[\p{L}\p{N}_]\z") & ~F.element_at(parts, i + 2).rlike(r"^[\p{L}\p{N}_]"),
    )
    scored = texts.withColumn("hit", F.when(F.size(parts) > 1, free).otherwise(F.lit(False))).select("qid", "key", "score", "hit")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "key"))
    ranked = scored.withColumn("rank", rank).select(
        "qid",
        "key",
        F.when(F.col("hit"), 1).otherwise(2).alias("tier"),
        F.when(F.col("hit"), F.lit(1.0)).otherwise(F.lit(0.95) - F.least(F.col("rank"), F.lit(100)) * F.lit(0.001)).alias("score"),
    )
    w = Window.partitionBy("qid").orderBy("tier", F.desc("score"), "key")
    return ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def evidence(hits: DataFrame, k: int) -> DataFrame:
    """hits (req, qi, kind, rank, key) -> (req, key, score): exact 3/(qi+1), lexical 2/(qi+rank+1), semantic 1/(rank+1), summed."""
    qi, r = F.col("qi").cast("double"), F.col("rank").cast("double")
    part = F.when(F.col("kind") == "exact", F.lit(3.0) / (qi + 1)).when(F.col("kind") == "lexical", F.lit(2.0) / (qi + r + 1)).otherwise(F.lit(1.0) / (r + 1))
    s = hits.withColumn("part", part).groupBy(F.col("req").alias("qid"), "key").agg(F.sum("part").alias("score"))
    return top_k(s, k).withColumnRenamed("qid", "req")
