"""Classifiers as column expressions: ordered patterns and word lists, without Python in the data path."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions import lexicons as X
from tamarack.functions import text as T


def lowered(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found, letters of all alphabets without case."""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the word parts occurs: plain searches for bytes, which cost a fraction of an alternation of patterns."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_label(text: Column, lexicon: Mapping[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """First label, in the lexicon's order, that has a word in the text."""
    out = F.lit(otherwise).cast("string")
    for label, words in reversed(list(lexicon.items())):
        out = F.when(contains_any(text, words), F.lit(label)).otherwise(out)
    return out


def labels(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Sorted array of all labels that have a word in the text."""
    return F.array_sort(F.array_compact(F.array(*[F.when(contains_any(text, w), F.lit(k)) for k, w in lexicon.items()])))


def route_intent(question: Column) -> Column:
    """struct(intent, tools, confidence): chat, personal, calculator, document and knowledge questions, in this order."""
    return bound(lowered(question), _intent)


def _intent(q: Column) -> Column:
    def result(intent: str, tools: Column | Iterable[str], confidence: float) -> Column:
        given = tools if isinstance(tools, Column) else F.array(*[F.lit(t) for t in tools]).cast("array<string>")
        return F.struct(F.lit(intent).alias("intent"), given.alias("tools"), F.lit(confidence).alias("confidence"))

    tools = F.array_compact(F.array(*[F.when(q.rlike("(?iU)" + p), F.lit(t)) for t, p in X.PERSONAL_TOOLS]))
    tools = F.when(F.size(tools) > 0, tools).otherwise(F.array(F.lit("get_my_progress"), F.lit("get_next_steps")))
    calculator = (
        F.when(matches(q, X.BUDGET), result("TOOL_THEN_RAG", ["calculate_budget"], 0.8))
        .when(matches(q, X.DATE_MATH), result("TOOL_ONLY", ["calculate_days_until"], 0.85))
        .when(matches(q, X.DEADLINE), result("RAG_ONLY", [], 0.85))
        .otherwise(result("RAG_ONLY", [], 0.6))
    )
    documents = F.when(q.rlike("(?iU)" + X.MINE), result("TOOL_THEN_RAG", ["get_my_progress"], 0.8)).otherwise(result("RAG_ONLY", [], 0.75))
    return (
        F.when(matches(q, X.CHITCHAT), result("CHITCHAT", [], 0.95))
        .when(matches(q, X.PERSONAL), result("TOOL_ONLY", tools, 0.9))
        .when(matches(q, X.CALCULATOR), calculator)
        .when(matches(q, X.DOCUMENT), documents)
        .when(matches(q, X.KNOWLEDGE), result("RAG_ONLY", [], 0.85))
        .otherwise(result("RAG_ONLY", [], 0.5))
    )


def route_predicates(intent: Column) -> Column:
    """struct(use_rag, use_tools, is_chitchat) of an intent."""
    return F.struct(intent.isin("RAG_ONLY", "TOOL_THEN_RAG").alias("use_rag"), intent.isin("TOOL_ONLY", "TOOL_THEN_RAG").alias("use_tools"), (intent == "CHITCHAT").alias("is_chitchat"))


def pattern_count(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Number of matches of all patterns together."""
    out = F.lit(0)
    for p, _ in patterns:
        out = out + F.regexp_count(text, F.lit("(?iU)" + p))
    return out


def categories(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike("(?iU)" + p), F.lit(c)) for p, c in patterns]))))


def universities(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(u)) for u, p in X.UNIVERSITIES.items()]))


def classify_query(question: Column) -> Column:
    """struct(query_type, confidence, universities, fact_topics, narrative_topics)."""
    q = lowered(question)
    found = F.struct(
        q.alias("q"), pattern_count(q, X.FACT).alias("plain"), pattern_count(q, X.NARRATIVE).alias("n"), universities(q).alias("unis"), categories(q, X.FACT).alias("what"), categories(q, X.NARRATIVE).alias("why"), q.rlike("(?iU)" + X.CONNECTOR).alias("joined")
    )
    return bound(found, _verdict)


def _verdict(x: Column) -> Column:
    """Decision from the counts."""
    n, plain = x["n"], x["plain"]
    f = F.when((F.size(x["unis"]) > 0) & (plain > 0) & (n == 0), plain + F.lit(1.5)).otherwise(plain.cast("double"))
    capped = lambda most, base, c: F.least(F.lit(most), F.lit(base) + F.lit(0.1) * c)
    weak = F.size(F.array_except(x["why"], F.array(F.lit("explanation")))) == 0
    pick = lambda t, c: F.struct(F.lit(t).alias("t"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("c"))
    verdict = (
        F.when(x["q"] == "", pick("NARRATIVE", 0.5))
        .when((f > 0) & (n > 0) & weak, pick("FACT", capped(0.9, 0.65, f)))
        .when((f > 0) & (n > 0) & (f > 2 * n), pick("FACT", capped(0.9, 0.6, f)))
        .when((f > 0) & (n > 0) & (n > 2 * f), pick("NARRATIVE", capped(0.9, 0.6, n)))
        .when((f > 0) & (n > 0), pick("HYBRID", 0.7))
        .when((f > 0) & x["joined"], pick("HYBRID", 0.65))
        .when(f > 0, pick("FACT", capped(0.95, 0.7, f)))
        .when(n > 0, pick("NARRATIVE", capped(0.95, 0.7, n)))
        .otherwise(pick("HYBRID", 0.5))
    )
    return F.struct(verdict["t"].alias("query_type"), verdict["c"].alias("confidence"), x["unis"].alias("universities"), x["what"].alias("fact_topics"), x["why"].alias("narrative_topics"))


def search_weights(query_type: Column) -> Column:
    """struct(fact_weight, narrative_weight) of a query type."""
    pair = lambda a, b: F.struct(F.lit(a).alias("fact_weight"), F.lit(b).alias("narrative_weight"))
    return F.when(query_type == "FACT", pair(0.8, 0.2)).when(query_type == "NARRATIVE", pair(0.2, 0.8)).otherwise(pair(0.5, 0.5))


def entity_focus(question: Column) -> Column:
    return bound(F.lower(F.coalesce(question, F.lit(""))), lambda t: first_label(t, X.FOCUS))


def tags(text: Column, entity_type: Column | None = None) -> Column:
    """Sorted tags of a text, with entity:<type> if a type is given."""
    found = bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: labels(t, X.TAGS))
    if entity_type is None:
        return found
    own = F.when(F.length(entity_type) > 0, F.array(F.concat(F.lit("entity:"), entity_type))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(found, own))


def tag_boost(chunk_tags: Column, query_tags: Column) -> Column:
    """1, or 1 plus the share of the query's tags that the chunk has, a half at most."""
    common = F.size(F.array_intersect(chunk_tags, query_tags))
    asked = F.size(F.array_distinct(query_tags))
    return F.when((common > 0) & (asked > 0), F.lit(1.0) + F.least(common / asked, F.lit(0.5))).otherwise(F.lit(1.0))


def stages(text: Column) -> Column:
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: labels(t, X.STAGES))


def mood(text: Column) -> Column:
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: first_label(t, X.MOODS, "calm"))


def topic(text: Column) -> Column:
    """Topic with most of its words in the text, ties to the one named first; null if none has any."""
    return bound(F.lower(F.coalesce(text, F.lit(""))), _topic)


def _topic(low: Column) -> Column:
    scored = []
    for i, (name, words) in enumerate(X.TOPICS.items()):
        count = F.lit(0)
        for w in words:
            count = count + F.contains(low, F.lit(w)).cast("int")
        scored.append(F.struct(count.alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("t")))
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["t"])


def entity_type(topic_col: Column, source: Column) -> Column:
    """Type of a text chunk from its topic, else from its file."""
    t, s = lowered(topic_col), lowered(source)
    out = F.when(s.contains("/housing") | s.endswith("housing.md"), "housing").when(s.contains("student-budget"), "food").otherwise("general")
    for name, topics in X.TOPIC_TYPES.items():
        out = F.when(t.isin(topics), F.lit(name)).otherwise(out)
    return out


def fact_entity_type(fact_type: Column, topic_col: Column, source: Column) -> Column:
    """Type of a fact chunk."""
    k, t, s = lowered(fact_type), lowered(topic_col), lowered(source)
    return (
        F.when(k.isin(X.FACT_TYPES["admission"]), "admission")
        .when(k.isin(X.FACT_TYPES["finance"]), "finance")
        .when(k.isin(X.FACT_TYPES["language"]) | t.contains("language"), "language")
        .when(k.isin(X.FACT_TYPES["university"]) & s.contains("universities/"), "university")
        .otherwise("general")
    )


def _joined_groups(groups: list[Column]) -> Column:
    """The groups of each match that aren't empty, joined by a blank."""
    out = groups[0]
    for g in groups[1:]:
        out = F.zip_with(out, g, lambda a, b: F.concat_ws(" ", T.missing(a), T.missing(b)))
    return out


def entity_name(kind: str, value: Column) -> Column:
    """One spelling for what goes by several: names of the fixed tables, programmes in lower case, levels in capitals."""
    if kind == "language_level":
        return F.upper(value)
    names = X.ENTITY_NAMES.get(kind)
    if names is None:
        return value
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(value)), F.lower(value) if kind == "program" else value)


def _typed(values: Column, kind: str, named: bool) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), (entity_name(kind, v) if named else v).alias("entity_value")))


def entities(text: Column, named: bool = True) -> Column:
    """Array of (entity_type, entity_value): what the patterns' groups hold, joined by a blank, under one name; first of equal ones.

    named off leaves the values as they are written.
    """
    found = []
    for kind, patterns in X.ENTITIES.items():
        for p in patterns:
            groups = re.compile(p).groups
            each = [F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
            values = each[0] if len(each) == 1 else _joined_groups(each)
            values = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 1)
            found.append(_typed(values, kind, named))
    every = F.concat(*found)
    keys = F.transform(every, lambda e: F.concat_ws("\x1f", e["entity_type"], F.lower(e["entity_value"])))
    return F.filter(every, lambda e, i: F.array_position(keys, F.concat_ws("\x1f", e["entity_type"], F.lower(e["entity_value"]))) == i + 1)


def reported_facts(question: Column) -> Column:
    """Map of what a user says about a document of theirs: done, not_done, or nothing."""
    state = lambda t: F.when(contains_any(t, [X.REPORTED]), F.when(contains_any(t, X.LACKING), "not_done").when(contains_any(t, X.HAVING), "done"))
    said = bound(F.lower(F.coalesce(question, F.lit(""))), state)
    return F.when(said.isNotNull(), F.create_map(F.lit(X.REPORTED), said)).otherwise(F.create_map().cast("map<string,string>"))
