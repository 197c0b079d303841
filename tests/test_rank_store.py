import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import analytics as A
from tamarack.operators import experiments as E
from tamarack.operators import rank as G
from tamarack.operators import retrieve as R
from tamarack.operators import store as S


def docs(spark, n=4):
    return spark.createDataFrame([(1, i, f"d{i}", "") for i in range(n)], "query_id int, pos int, content string, topic string")


def order(df):
    return [r["content"] for r in df.orderBy("rank").collect()]


def test_grades(spark):
    def kept(response, n=3):
        r = spark.createDataFrame([(1, response)], "query_id int, response string")
        return sorted(x["content"] for x in G.graded(docs(spark, n), r).collect())

    assert kept('{"scores": [1, 0, 1]}') == ["d0", "d2"] and kept('{"scores": [0, 0, 0]}') == []
    for bad in ('{"scores": [1, 1]}', "not json", "{}", None):
        assert kept(bad) == ["d0", "d1", "d2"]


def test_rerank(spark):
    scores = lambda s: spark.createDataFrame([(1, s)], "query_id int, response string")
    assert order(G.reranked_by_scores(docs(spark, 3), scores('{"scores": [1, 0, 1]}'), 2)) == ["d0", "d2"]
    assert order(G.reranked_by_scores(docs(spark, 3), scores("bad"), 2)) == ["d0", "d1"]
    idx = lambda rows: spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "query_id int, ord int, index int")
    assert order(G.reranked_by_index(docs(spark), idx([2, 0, 3]), 3)) == ["d2", "d0", "d3"]
    assert order(G.reranked_by_index(docs(spark), idx([1, 1, -1, 9, None, 3]), 2)) == ["d1", "d3"]
    assert order(G.reranked_by_index(docs(spark), idx([]), 2)) == ["d0", "d1"]


def test_sources_and_context(spark):
    rows = [(1, 0, "a", "u1", "", "T", "P", ""), (1, 1, "b", "", "", None, None, "2026/27"), (1, 2, "c", "u1", "", "T", "P", ""), (1, 3, "d", None, None, "", "", "")]
    df = spark.createDataFrame(rows, "query_id int, pos int, content string, source_url string, source string, title string, section_path string, valid_for string")
    got = [(r["pos"], r["number"]) for r in G.numbered_sources(df).orderBy("pos").collect()]
    assert got == [(0, 1), (1, 3), (2, 1), (3, 3)]
    text = G.numbered_context(df).first()["context"]
    assert text.startswith("[1] (T — P)\na\n\n[3] (актуально для приёма 2026/27)\nb")
    lines = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "query_id int, number int, line string")
    answers = spark.createDataFrame([(1, "see [2]"), (2, "none")], "query_id int, answer string")
    assert sorted(r["line"] for r in G.cited_only(lines, answers).collect()) == ["y", "z"]


def test_guardrail(spark):
    df = spark.createDataFrame([(1, 0, "общежитие", "", "housing"), (1, 1, "mensa menu", "", "housing"), (2, 0, "mensa", "", "housing"), (3, 0, "mensa", "", "food")], "query_id int, pos int, content string, topic string, focus string")
    assert sorted((r["query_id"], r["pos"]) for r in G.guarded(df).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_batched_search_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, x[5].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.where("id < 6").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in R.top_k_batched(df, q, 4, dims=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    ids = [i for i in range(300) if i != 7] + [902]
    m = np.asarray([dict(rows)[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(6):
        d = np.round(1 - m @ (x[i] / np.linalg.norm(x[i])), 9)
        best = [ids[j] for j in np.lexsort((ids, d))[:4]]
        assert [b for _, b in sorted(got[i])] == best
    assert R.top_k_batched(df, q.limit(0), 4, dims=8).count() == 0


def test_cover_density(spark):
    assert R.cover_density("a b", ["a", "b"]) == 0.1 and R.cover_density("a x x b", ["a", "b"]) == pytest.approx(0.1 / 3)
    assert R.cover_density("a b a", ["a", "b"]) == pytest.approx(0.2) and R.cover_density("a y a", ["a"]) == pytest.approx(0.2)
    assert R.cover_density("a a x b c", ["c", "a", "b"]) == pytest.approx(0.1 / 2)
    texts = ["a b", "b x a y, A b", "a", "", None, "c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.cover_rank(F.col("t"), ["a", "b"]).alias("r"))
    assert {r["i"]: round(r["r"], 9) for r in df.collect()} == {i: round(R.cover_density(t, ["a", "b"]), 9) for i, t in enumerate(texts)}
    assert R.cover_density("a b c", ["a", "z"]) == 0.0
    assert R.cover_density("", ["a"]) == 0.0
    assert R.cover_density("a b", ["a", "b"]) > R.cover_density("a x x b", ["a", "b"]) > 0


def test_store(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "tg_id int, country string, n int")
    c = spark.createDataFrame([(2, None, 5), (3, "c", 7)], "tg_id int, country string, n int")
    assert sorted(tuple(r) for r in S.upsert(t, c, "tg_id").collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", 7)]
    m = spark.createDataFrame([(1, f"m{i}", datetime(2025, 1, 1, 0, i)) for i in range(9)] + [(5, "x", datetime(2025, 1, 1))], "tg_id int, id string, created_at timestamp")
    assert [(r["id"], r["position"]) for r in S.last_messages(m, t).orderBy("position").collect()] == [(f"m{i + 3}", i + 1) for i in range(6)]
    rows = spark.createDataFrame([(None, 1.0), (datetime(2025, 1, 1), 1.0), (datetime(2025, 2, 1), 1.0)], "updated_at timestamp, confidence double").withColumn("tg_id", F.lit(1)).withColumn("entity_type", F.lit("t")).withColumn("entity_value", F.lit("v"))
    assert [r["updated_at"] for r in S.listed_entities(rows).orderBy("rank").collect()] == [None, datetime(2025, 2, 1), datetime(2025, 1, 1)]
    pre = spark.createDataFrame([("visa", "letter")], "stage string, prerequisite string")
    j = spark.createDataFrame([(1, {"visa": "discussed"}), (2, {"visa": "discussed", "letter": "discussed"}), (3, None)], "tg_id int, journey_state map<string,string>")
    assert [r["tg_id"] for r in S.skipped_prerequisites(j, pre).collect()] == [1]


def test_buckets_equal_md5(spark):
    df = spark.range(200).select(F.col("id").alias("tg_id"))
    splits = spark.createDataFrame([("e", "a", 0, 0.5), ("e", "b", 1, 0.25), ("e", "c", 2, 0.25)], "experiment string, variant string, ord int, split double")
    for r in E.assigned(df, splits).collect():
        b = int(hashlib.md5(f"{r['tg_id']}:e".encode()).hexdigest(), 16) % 10000
        assert r["bucket"] == b and r["variant"] == ("a" if b < 5000 else "b" if b < 7500 else "c")


def test_empty_dashboard(spark):
    logs = spark.createDataFrame([], "created_at timestamp, cache_hit boolean, t_total double, docs_after_grading int")
    assert tuple(A.dashboard(logs, F.lit("2025-01-01").cast("timestamp")).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)
    votes = spark.createDataFrame([(None,), (5,)], "rating int")
    assert A.feedback_stats(votes).first()["satisfaction"] == "-"


def test_days_until(spark):
    now = datetime(2025, 1, 10, 10)
    df = spark.createDataFrame([(datetime(2025, 1, 10),), (datetime(2025, 1, 11),), (datetime(2025, 1, 18),), (datetime(2025, 3, 1),), (None,)], "t timestamp")
    got = [tuple(r["x"]) for r in df.select(A.days_until(F.col("t"), F.lit(now)).alias("x")).collect()]
    assert got == [(-1, "expired"), (0, "today"), (7, "urgent"), (49, "ok"), (None, "error")]


def test_exact_percentile(spark):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=5000), np.repeat([1.0, 2.0, 3.0], 700), np.arange(1000.0), np.asarray([4.0]), np.asarray([])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for p in (0.0, 0.5, 0.95, 1.0):
            got = next((r["percentile"] for r in A.exact_percentiles(df, F.col("v"), p, most=40).collect()), None)
            assert (got is None) if not len(x) else abs(got - np.percentile(x, p * 100)) < 1e-9
