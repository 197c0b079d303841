"""Question pipelines as chains of DataFrame steps, and the three presets.

A state holds the questions (one row per query) and the chunks found for them. Steps are functions of the state, so every step
is one plan over all queries; what several later steps read is written to the checkpoint folder once. A query whose answer is settled early (cache, no documents) gets a word in its stop column and its
answer there; later steps pass over it. A step that fails ends the run with the name of the step in the error, as it would fail for
every query alike.

Models are reached through the providers' interface alone: texts for a rewriting, a tool call, sub-questions, a hypothetical
document, an answer, a verdict; numbers for grades. Every reply has a fallback, so that a model that says nothing usable leaves the
question, the list or the answer as it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import answers as A
from tamarack.functions import classify as K
from tamarack.functions import text as T
from tamarack.operators import rank as G
from tamarack.operators import retrieve as R
from tamarack.plans.providers import Provider, embedded, generated
from tamarack.session import cut

#: What a query without documents is told.
NOTHING_FOUND = "К сожалению, по этому запросу ничего не нашлось."
#: A chunk counts as relevant from this grade on.
RELEVANT = 0.5


@dataclass(frozen=True)
class State:
    queries: DataFrame  # query_id, question; country and level where they are known
    chunks: DataFrame  # id, embedding, content and metadata as columns
    model: Provider
    docs: DataFrame | None = None  # query_id, pos, ... of what was found
    context: DataFrame | None = None  # query_id, context
    answers: DataFrame | None = None  # query_id, answer, regenerated
    cache: DataFrame | None = None  # entry_id, vector, answer: in the order of age
    stored: DataFrame | None = None  # vector, answer: what the run adds to the cache
    tools: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)  # result of a tool from the map of its arguments
    dims: int = 64
    timings: dict = field(default_factory=dict)


Step = Callable[[State], State]


def going(queries: DataFrame) -> DataFrame:
    return queries.where("stop is null")


def rewrite(state: State) -> State:
    q = generated(state.queries, state.model, F.col("question"), "__reply", "rewrite")
    q = q.withColumn("asked", A.or_else(F.col("__reply"), F.coalesce("question", F.lit("")))).drop("__reply")
    return replace(state, queries=q.withColumn("stop", F.lit(None).cast("string")).withColumn("early", F.lit(None).cast("string")))


def route(state: State) -> State:
    """Type, weights, focus, terms and tags, settled once for all later steps."""
    q = state.queries.withColumn("query", K.classify_query(F.col("asked"))).withColumn("w", K.search_weights(F.col("query.query_type")))
    q = q.select(
        *state.queries.columns, F.col("query.query_type").alias("query_type"), "w.fact_weight", "w.narrative_weight", K.entity_focus(F.col("asked")).alias("focus"),
        R.query_terms(F.col("asked")).alias("terms"), K.tags(F.col("asked")).alias("query_tags"), F.lit(None).cast("string").alias("tool_result"),
    )
    return replace(state, queries=cut(q))


def tools(state: State) -> State:
    """The tool that the model calls, and its result."""
    if not state.tools:
        return state
    q = generated(state.queries, state.model, F.col("asked"), "__reply", "tool").withColumn("__call", A.tool_call(F.col("__reply"), list(state.tools)))
    result = F.lit(None).cast("string")
    for name, tool in state.tools.items():
        result = F.when(F.col("__call.tool_name") == name, F.concat(F.lit(f"[{name}]\n"), tool(F.col("__call.arguments")).cast("string"))).otherwise(result)
    return replace(state, queries=cut(q.withColumn("tool_result", result).drop("__reply", "__call")))


def cache_key(q: DataFrame) -> Column:
    """A question in its scope: answers for one country or level aren't given to another."""
    scope = [F.concat(F.lit(f"{c}="), F.col(c)) for c in ("country", "level") if c in q.columns]
    return F.concat_ws(" | ", *scope, "asked")


def cached(threshold: float = 0.97) -> Step:
    """Answers of near-equal questions; not for questions of fact, whose answers grow stale, nor for those that call a tool."""

    def step(state: State) -> State:
        if state.cache is None:
            return state
        asked = state.queries.where("stop is null and query_type <> 'FACT' and tool_result is null")
        keyed = embedded(asked.select("query_id", cache_key(asked).alias("__key")), state.model, "__key", "query_vector")
        hits = R.cache_lookup(keyed.select("query_id", "query_vector"), state.cache.select("entry_id", "vector"), threshold, state.dims)
        hits = hits.join(state.cache.select("entry_id", F.col("answer").alias("__cached")), "entry_id").select("query_id", "__cached")
        return replace(state, queries=cut(_stopped(state.queries, hits, "cache")))

    return step


def _stopped(queries: DataFrame, answers: DataFrame, why: str) -> DataFrame:
    """Queries with the answers (query_id, __cached) of those that stop here."""
    out = queries.join(answers, "query_id", "left")
    return out.withColumn("stop", F.coalesce("stop", F.when(F.col("__cached").isNotNull(), why))).withColumn("early", F.coalesce("early", "__cached")).drop("__cached")


_LIGHT = ("id", "tags", "topic", "is_yaml_fact")


def retrieve(k: int, hyde: bool = False, decompose: bool = False) -> Step:
    """The k best chunks in scope, by the smart score; of sub-questions, if decompose is set, merged in their order."""

    def step(state: State) -> State:
        asked = going(state.queries)
        carried = [c for c in R.OF_QUERY if c in asked.columns]
        parts = asked.select("query_id", F.col("asked").alias("text"), F.lit(0).alias("sub"), "query_type", *carried)
        if decompose:
            parts = generated(parts, state.model, F.col("text"), "__reply", "decompose")
            parts = parts.select("query_id", "query_type", *[c for c in carried if c != "terms"], F.posexplode(A.sub_questions(F.col("__reply"), F.col("text"))).alias("sub", "text")).withColumn("terms", R.query_terms(F.col("text")))
        searched = F.col("text")
        if hyde:  # an imagined document would bring invented facts to questions of fact
            parts = generated(parts, state.model, F.when(F.col("query_type") != "FACT", F.col("text")), "__reply", "hyde")
            searched = F.when(F.col("query_type") != "FACT", A.or_else(F.col("__reply"), F.col("text"))).otherwise(F.col("text"))
        parts = parts.withColumn("__search", searched).withColumn("__part", F.xxhash64("query_id", "sub") if decompose else F.col("query_id"))
        # equal questions with equal filters are asked once
        same = F.xxhash64("__search", *carried)
        parts = parts.withColumn("__same", same)
        unique = embedded(parts.dropDuplicates(["__same"]), state.model, "__search", "query_vector").withColumn("query_id", F.col("__same"))
        found = R.hybrid_top_k(state.chunks, unique.select("query_id", "query_vector", *carried), k, state.dims).withColumnRenamed("query_id", "__same")
        found = parts.select("query_id", "sub", "__same").join(found, "__same").drop("__same")
        if decompose:
            found = R.merged_subqueries(found, k, content="id").withColumnRenamed("position", "pos").drop("sub", "rank")
        else:
            found = found.withColumnRenamed("rank", "pos").drop("sub")
        light = state.chunks.select(*_LIGHT, G.food_only(F.col("content")).alias("food_only"))
        docs = found.join(light.dropDuplicates(["id"]), "id").join(asked.select("query_id", "focus", "query_tags"), "query_id")
        return replace(state, docs=cut(docs))

    return step


def _replies(state: State, grades: Column) -> DataFrame:
    """Grades of each list in its order, as the JSON in which a model gives them."""
    listed = F.array_sort(F.collect_list(F.struct("pos", grades.alias("g"))))
    return state.docs.groupBy("query_id").agg(F.to_json(F.struct(F.transform(listed, lambda x: x["g"]).alias("scores"))).alias("response"))


def grade(state: State) -> State:
    """Chunks that are relevant; queries without any stop here."""
    graded = state.model.grade(state.docs)
    docs = cut(G.graded(state.docs, _replies(state, (graded >= RELEVANT).cast("int"))))
    left = docs.select("query_id").distinct()
    none = going(state.queries).select("query_id").join(left, "query_id", "left_anti").withColumn("__cached", F.lit(NOTHING_FOUND))
    return replace(state, docs=docs, queries=cut(_stopped(state.queries, none, "no_documents")))


def tag_rerank(factor: float) -> Step:
    def step(state: State) -> State:
        neutral = state.docs.withColumn("__neutral", F.lit(0.5)).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        return replace(state, docs=G.tag_reranked(neutral, factor, "__neutral").withColumn("pos", F.col("rank")).drop("rank", "__neutral", "adjusted"))

    return step


def rerank(k: int) -> Step:
    """The k chunks of highest grade, ties in the order they have; lists that fit keep their order."""

    def step(state: State) -> State:
        ranked = G.reranked_by_scores(state.docs, _replies(state, F.round(state.model.grade(state.docs), 6)), k)
        return replace(state, docs=ranked.withColumn("pos", F.col("rank")).drop("rank"))

    return step


def guard(state: State) -> State:
    return replace(state, docs=cut(G.guarded(state.docs, food="food_only")))


def build(state: State) -> State:
    """Numbered contexts; contents join only the chunks that are left."""
    shown = state.chunks.select("id", "content", "title", "section_path", "source_url", "source", "valid_for")
    kept = state.docs.select("query_id", "id", "pos")
    own = shown.join(kept.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    context = G.numbered_context(kept.join(own, "id"))
    tool = state.queries.select("query_id", "tool_result")
    return replace(state, context=cut(context.join(tool, "query_id").select("query_id", F.concat_ws("\n\n", "tool_result", "context").alias("context"))))


def generate(state: State) -> State:
    prompts = going(state.queries).join(state.context, "query_id")
    said = generated(prompts, state.model, F.concat_ws("\n\n", "context", "asked"), "__reply", "answer")
    return replace(state, answers=cut(said.select("query_id", T.answer_and_suggestions(F.coalesce("__reply", F.lit("")), NOTHING_FOUND)["answer"].alias("answer"))))


def assertion(state: State) -> State:
    """Answers that a judge holds for unfaithful are made anew once, else they carry a caution."""
    n = state.docs.groupBy("query_id").agg(F.count("*").alias("n_docs"))
    rows = state.answers.join(n, "query_id").join(state.context, "query_id")
    rows = generated(rows, state.model, F.concat_ws("\n\n", "context", "answer"), "verdict", "judge")
    doubtful = ~T.faithfulness(F.col("verdict"))["is_faithful"]
    rows = generated(rows, state.model, F.when(doubtful, F.concat_ws("\n\n", "context", "answer")), "second_answer", "again")
    rows = generated(rows, state.model, F.when(doubtful & F.col("second_answer").isNotNull(), F.concat_ws("\n\n", "context", "second_answer")), "second_verdict", "judge")
    return replace(state, answers=cut(A.asserted(rows).select("query_id", F.col("final").alias("answer"), "regenerated")))


def store(state: State) -> State:
    """What the cache takes in: answers of this run to questions that aren't of fact, by the vector of the question in its scope."""
    fresh = going(state.queries).where("query_type <> 'FACT'").join(state.answers.select("query_id", "answer"), "query_id")
    keyed = embedded(fresh.select("answer", cache_key(fresh).alias("__key")), state.model, "__key", "vector")
    return replace(state, stored=keyed.select("vector", "answer"))


def results(state: State) -> DataFrame:
    """(query_id, stop, answer, context): every query with its answer, whether it stopped early or ran through."""
    out = state.queries.select("query_id", "stop", "early")
    said = state.answers.select("query_id", "answer") if state.answers is not None else out.select("query_id", F.lit(None).cast("string").alias("answer")).limit(0)
    out = out.join(said, "query_id", "left").join(state.context, "query_id", "left")
    return out.select("query_id", "stop", F.coalesce("early", "answer").alias("answer"), F.when(F.col("stop").isNull(), F.col("context")).alias("context"))


def run(state: State, steps: Sequence[tuple[str, Step]]) -> State:
    """Steps in order, each with the time its plan took to build; an error names its step."""
    for name, step in steps:
        t = time.perf_counter()
        try:
            state = step(state)
        except Exception as e:
            e.add_note(f"in step {name}")
            raise
        state.timings[name] = time.perf_counter() - t
    return state


def preset(name: str) -> list[tuple[str, Step]]:
    """default, fast or research."""
    k, factor, keep, thorough, fast = {"default": (10, 0.3, 6, False, False), "fast": (4, 0.2, None, False, True), "research": (10, 0.4, 8, True, False)}[name]
    steps: list[tuple[str, Step]] = [("rewrite", rewrite), ("route", route)]
    steps += [] if fast else [("tools", tools)]
    steps += [("cache", cached()), ("retrieve", retrieve(k, hyde=not fast, decompose=thorough)), ("grade", grade), ("tag", tag_rerank(factor))]
    steps += [("rerank", rerank(keep))] if keep else []
    return [*steps, ("guard", guard), ("build", build), ("generate", generate), ("assert", assertion), ("store", store)]
