"""Core operators on small fixtures: semantics, ties, nulls, empty inputs."""

import itertools
import json
import os
import zipfile
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import audit, candidates, catalog, corpus, diff, evaluate, lexicon, retrieval, segments, spans
from tidemark.sources import connectors, readers, sinks
from tidemark.streaming import events, sync


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CAND = "doc_id long, stage_ord int, seq int, start int, before string, after string, confidence double, category string"


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_merge_votes_weights_and_penalty(spark):
    c = spark.createDataFrame(
        [(1, 1, 1, 0, "а", "б", 0.9, "russian-gec-x"), (1, 2, 1, 0, "а", "б", 0.5, "draft"), (1, 3, 1, 5, "в", "г", 0.9, "draft"), (1, 4, 1, None, "в", "г", 0.9, "rule-x"), (2, 1, 1, 0, "x", "y", 0.1, "other")],
        CAND,
    )
    got = {(r.doc_id, r.start, r.before): (r.confidence, r.category, list(r.sources)) for r in candidates.merge(c).collect()}
    assert got[1, 0, "а"] == (0.96, "russian-gec-x", ["draft", "russian-gec-x"])
    assert got[1, 5, "в"] == (0.66, "draft", ["draft"])
    assert got[1, None, "в"] == (1.0, "rule-x", ["rule-x"])
    assert got[2, 0, "x"] == (0.5, "other", ["other"])


def test_decide_order_overlap_cap_and_spans(spark):
    texts = spark.createDataFrame([(1, "один два три два"), (2, None), (3, ""), (4, "нет правок")], "doc_id long, text string")
    c = spark.createDataFrame(
        [
            (1, 1, 1, 0, "один два", "1 2", 1.0, "rule-a"),
            (1, 1, 2, 5, "два", "2", 1.0, "rule-a"),  # overlaps the longer one
            (1, 1, 3, None, "два", "II", 1.0, "rule-a"),  # ambiguous without an offset
            (1, 1, 4, 99, "три", "3", 1.0, "rule-a"),  # a wrong offset, but only one occurrence
            (1, 1, 5, 13, "два", "два", 1.0, "rule-a"),
        ],
        CAND,
    )
    m = candidates.merge(c)
    got = {r.doc_id: r for r in candidates.decide(m, texts).collect()}
    assert [(e.s, e.after) for e in got[1].edits] == [(0, "1 2"), (9, "3")]
    assert all(not got[k].edits for k in (2, 3, 4))
    out = candidates.decide(m, texts).select("doc_id", candidates.apply_edits(F.col("text"), F.col("edits")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "1 2 3 два", 2: None, 3: "", 4: "нет правок"}
    capped = candidates.decide(m, texts, cap=1).filter("doc_id = 1").first()
    assert len(capped.edits) == 1 and capped.dropped == 1 and not any(r.dropped for r in candidates.decide(m, texts).collect())
    guard = spark.createDataFrame([("Три",)], "word string")
    assert [e.after for e in candidates.decide(m, texts, protected=guard).filter("doc_id = 1").first().edits] == ["1 2"]


def test_greedy_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    items = [(g, rnd.randrange(40), rnd.randrange(1, 9), i) for g in range(20) for i in range(25)]
    df = spark.createDataFrame([(g, s, s + n, i) for g, s, n, i in items], "g int, s int, e int, id int")
    key = F.struct((F.col("s") - F.col("e")).alias("o"), "id", "s", "e")
    got = {r.g: [x.id for x in r.c] for r in df.groupBy("g").agg(F.array_sort(F.collect_list(key)).alias("x")).select("g", F.slice(candidates.choose(F.col("x")), 1, 6).alias("c")).collect()}
    for g in range(20):
        acc = []
        for s, e, i in sorted(((s, s + n, i) for gg, s, n, i in items if gg == g), key=lambda t: (t[0] - t[1], t[2])):
            if len(acc) < 6 and all(e <= a or s >= b for a, b, _ in acc):
                acc.append((s, e, i))
        assert got[g] == [i for *_, i in acc]


def test_correct_and_protocol(spark):
    t = spark.createDataFrame([(1, "Tbe dog sat sat.. Foir,witb"), (2, "при большом большом стечении")], "doc_id long, text string")
    got = {r.doc_id: (r.n_changes, r.corrected) for r in candidates.correct(t).collect()}
    assert got[1][1].startswith("The dog sat sat. Foir, witb")
    assert got[2] == (1, "при большом стечении")
    edits = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit("а").alias("before"), F.lit("б").alias("after"), F.lit(1.0).alias("confidence"), F.lit("rule-x").alias("category")))
    b = t.select(candidates.render(F.lit("а в"), edits).alias("b")).select(candidates.parse_corrected(F.col("b")).alias("t"), candidates.parse_changes(F.col("b")).alias("c")).first()
    assert b.t == "а в" and [(c.n, c.before, c.after) for c in b.c] == [(1, "а", "б")]
    none = t.select(candidates.render(F.lit("а"), F.filter(edits, lambda x: F.lit(False))).alias("b")).first().b
    assert candidates.NO_ERRORS in none


@pytest.mark.parametrize("text", [None, "", " ", "\n", "а" * 5000])
def test_text_functions_take_any_text(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    c = F.col("t")
    fs = [T.newlines_local, T.newlines_double, T.newlines_trimmed, T.visible_blanks, T.join_wraps, T.wrap_joins, T.without_service_lines, T.cleanup_stats, T.soft_breaks, T.one_blank, T.detokenise, T.model_output]
    fs += [T.fold_yo, T.delimiters, T.quotes, T.skeleton, T.numbers, T.acronyms, T.words, T.trigrams, T.hash_words, T.redact_key, T.valid_word, T.nested_quotes]
    df.select(*(f(c).alias(f.__name__) for f in fs)).collect()


def test_text_functions(spark):
    assert one(spark, T.newlines_local, "а\r\nб\rв\n\n\n\nг") == "а\nб\nв\n\nг"
    assert one(spark, T.newlines_double, "а\r\nб") == "а\n\nб"
    assert one(spark, T.join_wraps, "слово-\nформа и\nещё.\nНовое") == "словоформа и ещё.\nНовое"
    assert one(spark, T.without_service_lines, "Страница 3 из 9\nтекст  тут \n---\nконец") == "текст тут\nконец"
    assert one(spark, T.detokenise, "( а ) , б !") == "(а), б!"
    assert one(spark, T.model_output, "<think>x</think>```\nОтвет: «Готово»```") == "Готово"
    assert one(spark, T.nested_quotes, "«а «б» в»") is True and one(spark, T.nested_quotes, "«а» «б»") is False
    assert one(spark, T.trigrams, "кот") == ["$ко", "кот", "от$"]
    assert one(spark, T.case_like, "слово", "СЛОВ") == "СЛОВО" and one(spark, T.case_like, "слово", "Да") == "Слово"
    assert one(spark, lambda a, b: T.similar_enough(a, b), "длинное предложение тут", "совсем другое здесь же") is False


def test_bm25_equals_brute_force(spark):
    from math import log

    docs = {1: "кот кот пёс", 2: "пес мышь", 3: "", 4: "кот"}
    d = spark.createDataFrame(list(docs.items()), "key long, text string")
    q = spark.createDataFrame([("a", "кот кот пёс"), ("b", "слон"), ("c", "")], "qid string, text string")
    got = {(r.qid, r.key): r.score for r in retrieval.bm25(q, d, T.words(F.col("text"))).collect()}
    tok = {k: t.replace("ё", "е").split() for k, t in docs.items()}
    avg = sum(map(len, tok.values())) / 4
    want = {}
    for k, t in tok.items():
        s = 0.0
        for w in "кот кот пес".split():
            df = sum(w in x for x in tok.values())
            f = t.count(w)
            s += log((4 - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want["a", k] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for k in (1, 2, 9):
        best = sorted(want, key=lambda x: (-round(want[x], 6), x[1]))[:k]
        assert sorted((r.qid, r.key) for r in retrieval.bm25_top_k(q, d, T.words(F.col("text")), k).collect()) == sorted(best)
    assert retrieval.bm25_top_k(q.limit(0), d, T.words(F.col("text")), 3).count() == 0


def test_cosine_blocks_ties_and_nulls(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(200, 8))
    m[7] = m[3]
    data = [(i, m[i].tolist()) for i in range(200)] + [(900, None), (901, [1.0, 2.0]), (None, [1.0] * 8), (None, None)]
    v = spark.createDataFrame(data, "key long, vec array<double>").repartition(5)
    q = v.filter("key < 10").select(F.col("key").alias("qid"), "vec")
    got = {}
    for r in retrieval.cosine_top_k(q, v, 4).collect():
        got.setdefault(r.qid, []).append((-round(r.score, 9), r.key))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(10):
        s = np.round(u @ u[i], 9)
        want = sorted((-x, k) for k, x in enumerate(s) if k != i)[:4]
        assert [k for _, k in sorted(got[i])] == [k for _, k in want]
    assert retrieval.cosine_top_k(q.limit(0), v, 4).count() == 0


def test_cosine_memory_does_not_grow_with_queries_times_rows(spark):
    import tracemalloc

    import numpy as np

    class Rows:
        def filter(self, *a):
            return self

        select = filter

        def mapInArrow(self, run, schema):
            return run

    rnd = np.random.default_rng(2)
    m = rnd.integers(-1, 2, size=(10_000, 6)).astype(float)
    m[:, 0] += 2 * (m == 0).all(axis=1)
    keys = rnd.permutation(40_000)[:10_000]
    unit = retrieval._unit(m)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(m), pa.list_(pa.float64()))], names=["key", "vec"])
    run = retrieval._scan(Rows(), keys[:4_000].tolist(), unit[:4_000], 5, False)
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(run(iter([batch.slice(0, 9_001), batch.slice(9_001)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64e6  # the product of all queries and a batch takes 288 MB
    best = {}
    for q, key, s in zip(*(got[c].to_pylist() for c in ("qid", "key", "score"))):
        best.setdefault(q, []).append((-s, key))
    assert len(best) == 4_000
    for i in range(0, 4_000, 40):
        s = np.round(unit @ unit[i], 9)
        want = sorted((-x, key) for x, key in zip(s.tolist(), keys.tolist()) if key != keys[i])[:5]
        assert [(round(x, 7), key) for x, key in sorted(best[keys[i]])] == [(round(x, 7), key) for x, key in want]


def test_cosine_of_many_equal_vectors_scores_few_of_them(spark, monkeypatch):
    import numpy as np

    scored = []
    merge = retrieval._Nearest._merge
    monkeypatch.setattr(retrieval._Nearest, "_merge", lambda self, q, key, score: (scored.append(len(q)), merge(self, q, key, score)))
    keys = np.random.default_rng(4).permutation(5_000)
    best = retrieval._Nearest(np.arange(0, 5_000, 50), np.full((100, 4), 0.5), 5, False)
    for a in range(0, 5_000, 1_000):
        best.add(keys[a : a + 1_000], np.full((1_000, 4), 0.5))
    assert all(best.key[i].tolist() == [x for x in range(6) if x != 50 * i][:5] for i in range(100)) and (best.score == 1).all()
    assert sum(scored) < 100 * 5_000 / 10


def test_chunk_vectors_that_are_null_zero_or_repeated(spark, tmp_path):
    import duckdb

    from tidemark.plans import searching

    data = [(i, None) for i in (7, 50, 150)] + [(i, [i % 7, 1.0, i % 3]) for i in range(1, 60)] + [(9, [2.0, 1.0, 0.0]), (100, [0.0] * 3), (200, [1.0, 2.0])]
    spark.createDataFrame([(i, v and [float(x) for x in v]) for i, v in data], "id long, vec array<double>").coalesce(1).write.parquet(str(tmp_path / "rag_chunks.parquet"))
    query, sql = searching.QUERIES["chunk_vector_topk"]
    con = duckdb.connect()
    con.execute(f"create view rag_chunks as select * from read_parquet('{tmp_path}/rag_chunks.parquet/*.parquet')")
    got = query(spark, str(tmp_path)).collect()
    assert sorted((r.qid, r.key, r.score) for r in got) == sorted(con.execute(sql).fetchall())


def test_rrf_and_evidence(spark):
    a = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.8)], "qid string, key long, score double")
    b = spark.createDataFrame([("q", 2, 7.0), ("q", 3, 6.0)], "qid string, key long, score double")
    assert [r.key for r in retrieval.rrf(a, b, 3).orderBy(F.desc("score")).collect()] == [2, 1, 3]
    h = spark.createDataFrame([("r", 0, "exact", 0, 1), ("r", 1, "lexical", 0, 1), ("r", 0, "semantic", 1, 2)], "req string, qi int, kind string, rank int, key long")
    assert rows(retrieval.evidence(h, 5)) == [("r", 1, 4.0), ("r", 2, 0.5)]


def test_quality_and_percentile(spark):
    c = spark.createDataFrame(
        [("1", "clean", "а б", None, "а б"), ("2", "clean", "а б", None, "а в"), ("3", "error", "а б", "а в", "а в"), ("4", "error", "а б", "а в г", "а б")],
        "case_id string, kind string, text string, expected string, produced string",
    )
    r = evaluate.quality(c).first()
    assert (r.clean_total, r.clean_damaged, r.error_exact, r.tp, r.fp, r.fn) == (2, 1, 1, 1, 1, 1)
    assert evaluate.quality(c.filter("case_id = '1'")).first().precision == 1.0
    v = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, v int")
    for r in evaluate.exact_p95(v, "v", "g").collect():
        own = sorted(i for i in range(100) if i % 3 == r.g)
        assert r.p95 == own[max(0, int(0.95 * len(own)) - 1)]


def test_spans_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    a = [(d, s, s + rnd.randrange(1, 700), i) for i, (d, s) in enumerate((rnd.randrange(3), rnd.randrange(2000)) for _ in range(60))]
    b = [(d, s, s + rnd.randrange(1, 300), i) for i, (d, s) in enumerate((rnd.randrange(3), rnd.randrange(2000)) for _ in range(60))]
    A, B = (spark.createDataFrame(x, "doc_id int, s int, e int, id int") for x in (a, b))
    want = sorted((x[3], y[3]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert rows(spans.overlapping(A, B).select("id", "r_id")) == [tuple(x) for x in sorted(want, key=repr)]
    free = {x[3] for x in a} - {x for x, _ in want}
    assert {r.id for r in spans.without_overlap(A, B, ["doc_id", "id"]).collect()} == free
    p = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "doc_id int, p int")
    m = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 3, "z")], "doc_id int, p int, value string")
    assert rows(spans.nearest_left(p, m)) == [(1, 1, None, None), (1, 5, "x", 3), (2, 9, "z", 6)]


def test_catalog_and_sync(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "cat"), sync.SCHEMA)
    snap = lambda **k: spark.createDataFrame(list(k.items()), "doc_id string, file_hash string")
    assert rows(sync.apply_snapshot(snap(a="1", b="1"), t)) == [("added", 2)]
    assert rows(sync.apply_snapshot(snap(a="2", c="1"), t)) == [("added", 1), ("missing", 1), ("updated", 1)]
    assert rows(t.read()) == [("a", "2", "active", 2), ("b", "1", "missing", 1), ("c", "1", "active", 1)]
    assert rows(sync.apply_snapshot(snap(a="2", b="1", c="1"), t)) == [("unchanged", 2), ("updated", 1)]
    with pytest.raises(ValueError):
        catalog.set_status(t.read(), t.read(), "gone")
    (tmp_path / "snaps").mkdir()
    (tmp_path / "snaps" / "1.json").write_text(json.dumps({"doc_id": "z", "file_hash": "9", "snapshot": 1}) + "\n")
    sync.watch(spark, str(tmp_path / "snaps"), t, str(tmp_path / "ck")).awaitTermination()
    assert ("z", "9", "active", 1) in rows(t.read())


def test_corpus(spark):
    t = spark.createDataFrame([(1, "а"), (2, "а"), (3, None), (4, "")], "id long, text string")
    assert rows(corpus.exact_duplicates(t, "id", "text")) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2)]
    w = spark.createDataFrame([(1, "слово это слово это тут"), (2, "а б а б"), (3, "")], "doc_id long, text string")
    assert rows(corpus.repeated_ngrams(w, 2)) == [(1, 1), (2, 0), (3, 0)]


def test_segments_and_chunks(spark):
    t = spark.createDataFrame([(1, "Первое. Второе? 3. Третье\n\nг. Тверь стоит. да"), (2, None), (3, " ")], "key long, text string")
    got = segments.sentences(t).collect()
    text = t.filter("key = 1").first().text
    assert all(text[r.start : r.start + len(r.text)] == r.text for r in got) and {r.key for r in got} == {1}
    long = spark.createDataFrame([(1, "слово " * 900)], "key long, text string")
    pieces = [r.text for r in segments.hard_chunks(long, 300, 50).orderBy("chunk_id").collect()]
    assert max(map(len, pieces)) <= 300 and len(pieces) > 15
    para = spark.createDataFrame([(1, "\n\n".join(["а" * 50] * 10))], "key long, text string")
    assert segments.paragraph_chunks(para, 120, 10).count() > 3


def test_diff(spark):
    cases = {
        "yo": ("Он пошол домой.", "Он пошёл домой."),
        "break": ("а б", "а\nб"),
        "rewrite": ("раз два три", "совсем другой длинный текст"),
        "comma": ("Мы видели что он ушёл", "Мы видели, что он ушёл"),
        "same": ("а", "а"),
        "empty": ("", ""),
        "null": (None, "а"),
    }
    P = spark.createDataFrame([(k, *v) for k, v in cases.items()], "case_id string, source string, target string")
    got = {}
    for r in diff.token_edits(P).orderBy("case_id", F.desc("start")).collect():
        got.setdefault(r.case_id, []).append((r.start, r.before, r.after))
    assert got["yo"] == [(3, "пошол", "пошёл")] and set(got) == {"yo", "comma"}
    src, dst = cases["comma"]
    for s, b, a in got["comma"]:
        assert src[s : s + len(b)] == b
        src = src[:s] + a + src[s + len(b) :]
    assert src == dst
    guard = {r.case_id: r for r in diff.rewrite_guard(P).collect()}
    assert guard["rewrite"].rewrite and not guard["comma"].rewrite and guard["yo"].changed == 1 and "null" not in guard
    # Length is measured against the shorter text: a text a quarter longer is a rewrite though four fifths of it stay.
    D = spark.createDataFrame([("a", "1" * 80, "1" * 97), ("b", "1" * 97, "1" * 80)], "case_id string, source string, target string")
    assert all(r.rewrite for r in diff.rewrite_guard(D).collect())


def test_streams_in_several_triggers(spark, tmp_path):
    rows_ = [("2024-01-01 10:00:00", 1), ("2024-01-02 09:00:00", 2), ("2024-01-05 00:30:00", 3), ("2024-01-05 01:00:00", 5), ("2024-01-01 11:00:00", 4)]
    (tmp_path / "in").mkdir()
    for k, (ts, event) in enumerate(rows_):
        pq.write_table(pa.table({"ts": pa.array([datetime.fromisoformat(ts)], pa.timestamp("us", "UTC")), "event_id": [event]}), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    want = {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-05", 2)}
    got = events.daily_counts(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert {(str(r.day.date()), r.n) for r in got.collect()} == want
    # Under a watermark of a day the row that comes four days late is dropped, and only closed windows come out.
    stream = spark.readStream.schema("ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.watermarked(stream, "1 day", "1 day").writeStream.outputMode("append").format("memory").queryName("late_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.start.date()), r.n) for r in spark.table("late_rows").collect()} == {("2024-01-01", 1), ("2024-01-02", 1)}


def test_exact_duplicates_of_huge_classes(spark):
    df = spark.createDataFrame([(i, "" if i % 3 else None) for i in range(30)] + [(100, "а"), (101, "а"), (102, "б")], "id int, text string")
    want = rows(corpus.exact_duplicates(df, "id", "text"))
    assert rows(corpus.exact_duplicates(df, "id", "text", hot=2)) == want and (100, 100, 2) in want and want[0] == (0, 0, 30)


def test_solo_penalty_is_for_inflections_only(spark):
    lx = lexicon.fixture(spark)
    c = spark.createDataFrame(
        [(1, 1, 1, 0, "службы", "службе", 0.9, "russian-gec"), (1, 1, 2, 9, "служба", "группа", 0.9, "russian-gec"), (2, 1, 1, 0, "службы", "службе", 0.9, "draft"), (2, 2, 1, 0, "службы", "службе", 0.9, "sage"), (3, 1, 1, 0, "службы", "службе", 0.9, "rule-x")],
        CAND,
    )
    got = {(r.doc_id, r.after): r.confidence for r in candidates.merge(c, lx).collect()}
    assert got == {(1, "службе"): 0.61, (1, "группа"): 0.86, (2, "службе"): 0.9, (3, "службе"): 1.0}
    assert {r.confidence for r in candidates.merge(c).filter("doc_id = 1").collect()} == {0.86}
    m = candidates.merge(spark.createDataFrame([(1, 1, 1, 0, "службы", "службе", 0.9, "model-x"), (1, 1, 2, 7, "ревизор", "реви зор", 0.9, "model-x"), (1, 1, 3, 7, "ревизор", "реви зор", 0.9, "rule-rag-terminology")], CAND))
    text = spark.createDataFrame([(1, "службы ревизор")], "doc_id long, text string")
    assert [e.after for e in candidates.decide(m.withColumn("confidence", F.lit(0.9)), text, lexicon=lx).first().edits] == ["реви зор"]
    assert [e.after for e in candidates.decide(m.withColumn("confidence", F.lit(0.9)), text).first().edits] == ["службе", "реви зор"]


def test_undo_yo(spark):
    P = spark.createDataFrame([(1, "Все ели елку", "Всё ели, ёлку"), (2, "Ёж", "Ёж"), (3, None, "ё"), (4, "е", None), (5, "еще ЕЖ", "ещё ЁЖ")], "case_id int, source string, target string")
    assert {r.case_id: r.text for r in diff.undo_yo(P).collect()} == {1: "Все ели, елку", 2: "Ёж", 3: "ё", 4: None, 5: "еще ЕЖ"}


def test_lexicon(spark):
    lx = lexicon.fixture(spark)
    t = spark.createDataFrame([(1, "складская служба"), (2, "складской служба"), (3, "новый служба"), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.left, r.right) for r in lexicon.disagreements(t, lx).collect()] == [(2, "складской", "служба")]
    f = spark.createDataFrame([("складский",), ("нетслова",)], "form string")
    lex = spark.createDataFrame([("складный",), ("складской",), ("словарь",)], "form string")
    assert rows(lexicon.spell_unique(spark.createDataFrame([("слварь",), ("словраь",), ("слова",)], "form string"), lex)) == [("слварь", "словарь"), ("словраь", "словарь")]
    assert rows(lexicon.spell_unique(f, lex)) == [("складский", "складской")]
    form = spark.createDataFrame([("складскый",), ("нетслова",)], "form string")
    assert rows(lexicon.inflect(form, lx, {"case": "gent", "number": "sing", "gender": "femn"})) == [("складскый", "складской")]


def test_noun_phrase_unification(spark):
    lx = lexicon.fixture(spark)
    t = spark.createDataFrame(
        [(1, "новая складская дежурной служба ушла"), (2, "складской дежурный служба"), (3, "складская дежурная служба"), (4, "складской дежурной смотровая службой"), (5, None), (6, "складская, дежурной служба")],
        "doc_id long, text string",
    )
    assert [(r.doc_id, r.before, r.after) for r in lexicon.unify(t, lx).collect()] == [(1, "дежурной", "дежурная"), (4, "смотровая", "смотровой")]


def test_audit(spark, tmp_path):
    r = spark.createDataFrame([("2024-01-01 10:00:00", "т" * 300, "к", None, 5, 1), ("2024-03-01 10:00:00", "", None, "e" * 600, 7, 0)], "ts string, text string, context string, error string, duration_ms int, changes_count int")
    a = audit.record(r.withColumn("ts", F.col("ts").cast("timestamp")))
    got = sorted(a.collect(), key=lambda x: x.ts)
    assert len(got[0].text_snippet) == 200 and got[0].ok and got[1].text_sha1 == "" and len(got[1].error) == 500
    audit.append(a, str(tmp_path / "log"))
    assert audit.purge(spark, str(tmp_path / "log"), "2024-02-01") == ["2024-01-01"]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    s = audit.window_stats(a, F.lit("2024-02-01").cast("timestamp")).first()
    assert (s.total, s.failed, s.mean_ms) == (1, 1, 7.0)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "b.html").write_text("<nav>x</nav><p>Текст</p><script>1</script>")
    (tmp_path / "c.rtf").write_bytes(rb"{\rtf1 \'ef\'f0\'e8\par 2}")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Абзац</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.bin").write_bytes(b"1")
    got = {r.doc_id: (r.text, r.error is None) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("привет", True) and got["b.html"] == ("Текст", True) and got["c.rtf"] == ("при\n2", True) and got["d.docx"] == ("Абзац", True)
    assert got["e.bin"] == (None, False)
    assert readers.folder_listing(spark, str(tmp_path)).count() == 5
    bank = tmp_path / "bank.jsonl"
    bank.write_text('# c\n\n{"wrong": " а ", "right": "б"}\nnot json\n{"wrong": "а", "right": "а"}\n{"wrong": "«а»", "right": "б"}\n{"wrong": "", "right": "б"}\n')
    assert [(r.wrong, r.right) for r in readers.pair_bank(spark, str(bank)).collect()] == [("а", "б")]


def test_connectors(spark):
    t = spark.createDataFrame([(1, "а"), (2, " "), (3, None), (4, "bad")], "doc_id long, text string")

    def broken(texts):
        raise RuntimeError("down")

    got = {r.key: (r.answer, r.error) for r in connectors.ask(t, "doc_id", "text", connectors.first_of(broken, connectors.stub({"а": "б"})), pause=0).collect()}
    assert got == {1: ("б", None), 2: (" ", None), 3: (None, None), 4: ("bad", None)}
    bad = connectors.ask(t, "doc_id", "text", broken, pause=0).filter("key = 1").first()
    assert bad.answer is None and "down" in bad.error
    j = spark.createDataFrame([('```json\n{"edits":[{"start":0,"before":"а","after":"б","confidence":"7"},{"before":null,"after":"x"}]}```',), ("nothing",)], "a string")
    out = [r.e for r in j.select(connectors.parse_edits(F.col("a")).alias("e")).collect()]
    assert [len(x) for x in out] == [1, 0] and out[0][0].confidence == 1.0


def test_stream_equals_batch(spark, sf):
    s = {(r.day, r.n) for r in events.daily_counts(spark, f"{sf}/events.parquet").collect()}
    b = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()
    assert {(d.date(), n) for d, n in s} == {(r.d, r.n) for r in b}
