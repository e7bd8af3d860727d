"""Document catalog: scan against catalog, incremental sync, chunk views. State is a table; upserts are set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prefix

STATUSES = ("active", "disabled", "missing")


def diff(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """found (doc_id, file_hash), catalog (doc_id, file_hash, status) -> (doc_id, state, status): one full outer join."""
    f = found.select("doc_id", F.col("file_hash").alias("new_hash"))
    c = catalog.select("doc_id", F.col("file_hash").alias("old_hash"), "status", F.lit(True).alias("known"))
    j = f.withColumn("seen", F.lit(True)).join(c, "doc_id", "full")
    state = F.when(F.col("known").isNull(), "new").when(F.col("seen").isNull(), "missing").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return j.select("doc_id", state.alias("state"), "status")


def to_process(states: DataFrame) -> DataFrame:
    """Documents that must be read again: new, changed, and unchanged ones that are not active."""
    return states.filter(F.col("state").isin("new", "changed") | ((F.col("state") == "unchanged") & ~F.coalesce(F.col("status") == "active", F.lit(False)))).select("doc_id", "state")


def summary(states: DataFrame) -> DataFrame:
    """(operation, documents): added, updated, unchanged, missing."""
    again = F.coalesce(F.col("status") == "active", F.lit(False))
    op = F.when(F.col("state") == "new", "added").when(F.col("state") == "changed", "updated").when(F.col("state") == "missing", "missing").when(again, "unchanged").otherwise("updated")
    return states.groupBy(op.alias("operation")).agg(F.count("*").alias("documents"))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old with the rows of new in place of those with the same key; added_at of replaced rows is kept."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if "added_at" in old.columns and "added_at" in new.columns:
        first = old.groupBy(key).agg(F.min("added_at").alias("_first"))
        new = new.join(first, key, "left").withColumn("added_at", F.coalesce("_first", "added_at")).drop("_first")
    return kept.unionByName(new.select(*old.columns))


def set_status(catalog: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    hit = ids.select("doc_id", F.lit(status).alias("_s")).distinct()
    return catalog.join(hit, "doc_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def active_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct chunks of active documents with path and version."""
    d = documents.filter("status = 'active'").select("doc_id", "path", "version")
    return chunks.dropDuplicates(["doc_id", "chunk_id"]).join(d, "doc_id")


def without_active(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active documents that have no chunk (anti-join), the complement of the EXISTS probe."""
    return documents.filter("status = 'active'").join(chunks.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def declared_against_stored(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose declared number of chunks is not the stored one (null-safe)."""
    n = chunks.select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count("*").alias("stored"))
    j = documents.select("doc_id", F.col("chunks").alias("declared")).join(n, "doc_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return j.filter(~F.col("declared").eqNullSafe(F.col("stored").cast("int")))


def offsets(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, start, n): where each chunk begins in its document, put together with one line break between chunks."""
    c = chunks.select("doc_id", "chunk_id", F.length("text").alias("n")).dropDuplicates(["doc_id", "chunk_id"]).filter("n is not null")
    got = prefix.running(c, "doc_id", F.floor(F.col("chunk_id") / 256), ["chunk_id"], F.col("n") + 1, "start")
    return got.select("doc_id", "chunk_id", "start", F.col("n").cast("long").alias("n"))


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): a hash over the distinct chunks of a document in order. Texts are hashed in the scan; a document gathers
    the hashes of its own chunks only."""
    h = chunks.select("doc_id", "chunk_id", F.md5(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.concat_ws(":", F.col("chunk_id").cast("string"), "h").alias("p"))))
    return h.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["p"]), "\n"), 256).alias("fingerprint"))


def stale(now: DataFrame, built: DataFrame) -> DataFrame:
    """(doc_id, state): documents that an index does not know ('new'), knows with another fingerprint ('changed') or has too many ('gone')."""
    j = now.select("doc_id", F.col("fingerprint").alias("a")).join(built.select("doc_id", F.col("fingerprint").alias("b")), "doc_id", "full")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return j.select("doc_id", state.alias("state")).filter("state is not null")
