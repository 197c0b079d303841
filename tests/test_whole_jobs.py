"""Queries and plans meet every row they are about, not a fixed number of them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tamarack.operators import retrieve as R
from tamarack.plans import pipeline as P
from tamarack.plans.providers import Offline, Patient, embedded, index_of
from tamarack.queries import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_tables
def test_pipeline_answers_every_question(spark):
    asked = spark.read.parquet(f"{SF}/feedback.parquet").dropDuplicates(["id"]).where("question is not null").select(F.xxhash64("id").alias("q"), "question").collect()
    for name in ("pipeline_default", "pipeline_research"):
        got = {r["query_id"]: r for r in catalogue.queries()[name](spark, SF).collect()}
        assert set(got) == {r["q"] for r in asked} and len(got) > 20
        assert all(r["answer"] for r in got.values())
        assert all((r["stop"] is None) == (r["context"] is not None) for r in got.values())
        assert {r["stop"] for r in got.values()} <= {None, "cache", "no_documents"}


def _chunks(spark, texts):
    names = ("title", "section_path", "source_url", "source", "topic", "entity_type", "valid_for")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string").select("*", *[F.lit("").alias(n) for n in names], F.array().cast("array<string>").alias("tags"), F.lit(False).alias("is_yaml_fact"), F.array(F.lit("ALL")).alias("country_scope"), F.array().cast("array<string>").alias("level"))
    return docs.join(index_of(docs, Offline()), "id")


TEXTS = ["anmeldung an der universität wien und was dazu mitzubringen ist, in dieser reihenfolge", "нострификация диплома", "mensa menu", "visum und aufenthalt", "frist für das wintersemester, ohne nachfrist und ohne verlängerung für bewerber"]


def test_pipeline_finds_the_chunk_that_says_it(spark):
    asked = spark.createDataFrame([(7, TEXTS[1]), (8, TEXTS[4]), (9, "xyzzy")], "query_id long, question string")
    state = P.run(P.State(asked, _chunks(spark, TEXTS), Offline()), P.preset("fast"))
    got = {r["query_id"]: r for r in P.results(state).collect()}
    assert got[7]["context"].startswith(f"[1]\n{TEXTS[1]}") and got[8]["answer"] == TEXTS[4] and got[9]["stop"] == "no_documents" and got[9]["context"] is None
    assert set(state.timings) == {n for n, _ in P.preset("fast")}


def test_pipeline_stops_asserts_and_stores(spark):
    class Judge(Offline):
        """Says of every answer that it is unfaithful, and so of the one made anew, unless that is the second chunk."""

        def generate(self, prompts, task="answer"):
            if task == "judge":
                return [json.dumps({"is_faithful": p.endswith("again"), "unsupported_claims": [], "reason": ""}) for p in prompts]
            if task == "again":
                return ["a longer answer that was made once more, well over fifty characters, again" if "frist" in p else "another answer, also well over fifty characters, that stays doubtful" for p in prompts]
            if task == "tool":
                return [json.dumps({"use_tool": True, "tool_name": "days", "arguments": {"n": "3"}}) if "tage" in p else None for p in prompts]
            return super().generate(prompts, task)

    asked = spark.createDataFrame([(1, "anmeldung an der universität wien"), (2, "frist für das wintersemester"), (3, "wie lange dauert das visum"), (4, "mensa menu in tage")], "query_id long, question string")
    keys = embedded(spark.createDataFrame([(0, "wie lange dauert das visum")], "entry_id int, key string"), Offline(), "key", "vector")
    cache = keys.select("entry_id", "vector", F.lit("from the cache").alias("answer"))
    tools = {"days": lambda arguments: F.concat(F.lit("in "), arguments["n"], F.lit(" days"))}
    state = P.run(P.State(asked, _chunks(spark, TEXTS), Judge(), cache=cache, tools=tools), P.preset("default"))
    got = {r["query_id"]: r for r in P.results(state).collect()}
    assert got[3]["stop"] == "cache" and got[3]["answer"] == "from the cache"
    assert got[2]["answer"].endswith("again")
    assert got[1]["answer"].startswith("another answer") and "⚠️" in got[1]["answer"]
    assert got[4]["context"].startswith("[days]\nin 3 days")
    types = {r["query_id"]: r["query_type"] for r in state.queries.collect()}
    assert state.stored.count() == sum(types[i] != "FACT" for i in (1, 2, 4))
    with pytest.raises(Exception) as e:
        P.run(state, [("broken", lambda s: 1 / 0)])
    assert e.value.__notes__ == ["in step broken"]


def test_blocks_of_queries_give_what_one_batch_gives(spark):
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * (F.col("id") + 1))).alias("embedding"))
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one = sorted(map(tuple, R.top_k_batched(rows, asked, 4, dims=8).collect()))
    assert sorted(map(tuple, R.top_k_batched(rows, asked, 4, dims=8, max_queries=5).collect())) == one and len(one) == 14 * 4
    assert R.top_k_batched(rows, asked.limit(0), 4, dims=8).count() == 0


@needs_tables
def test_lists_hold_every_chunk(spark):
    docs = spark.read.parquet(f"{SF}/simple_documents.parquet").dropDuplicates(["id"])
    n = docs.count()
    found, q = {}, catalogue.queries()
    for name in ("source_numbering", "tag_boost_rerank"):
        found[name] = q[name](spark, SF)
        assert found[name].count() == n
    assert found["tag_boost_rerank"].select("id").distinct().count() == n
    assert found["source_numbering"].groupBy("query_id").count().agg(F.max("count")).first()[0] <= 8
    # one block for each chunk: the blocks of all contexts hold all contents
    contexts = q["attributed_context"](spark, SF)
    assert contexts.agg(F.sum(F.size(F.split("context", r"\[Источник: ")) - 1)).first()[0] >= n


@needs_tables
def test_searches_ask_the_whole_query_set(spark):
    ids = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    every, q = {i for i in ids if i % 20 == 0}, catalogue.queries()
    for name, k in (("vector_topk_batched", 5), ("vector_topk_hundred", 10), ("hybrid_boosted_topk", 5)):
        rows = q[name](spark, SF).select("query_id").collect()
        assert {r[0] for r in rows} == every and len(rows) == k * len(every)
    assert {r[0] for r in q["decomposed_merge"](spark, SF).select("query_id").collect()} == {i // 60 for i in every}
    assert max(r[0] for r in q["semantic_cache_lookup"](spark, SF).select("query_id").collect()) >= 400


def test_vectors_that_are_not_finite_take_no_part(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [inf, 1.0]), (4, [0.0, 0.0]), (5, None), (2, [0.5, 0.5])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.2]), (2, [inf, 0.0])], "query_id long, query_vector array<double>")
    assert [(r["query_id"], r["id"], r["rank"]) for r in R.top_k_batched(rows, asked, 10, dims=2).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_patient_provider_asks_again():
    class Busy(Offline):
        asked = 0

        def generate(self, prompts, task="answer"):
            self.asked += 1
            if self.asked < 3:
                raise RuntimeError("503 Service Unavailable")
            return super().generate(prompts, task)

    busy = Busy()
    assert Patient(busy, first_wait=0.0).generate(["a"], "rewrite") == ["a"] and busy.asked == 3
    with pytest.raises(RuntimeError):
        Patient(Busy(), attempts=2, first_wait=0.0).generate(["a"])
