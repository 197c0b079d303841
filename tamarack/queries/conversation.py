"""Queries over users, messages, feedback, logs and events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import lexicons as X
from tamarack.functions import text as T
from tamarack.operators import analytics as A
from tamarack.operators import experiments as E
from tamarack.operators import store as S
from tamarack.queries.registry import query
from tamarack.session import spread, table

NOW = "TIMESTAMP '2026-01-01 00:00:00'"
_M = "(SELECT DISTINCT ON (id) * FROM messages ORDER BY id, loaded_at DESC NULLS LAST)"
_L = "(SELECT DISTINCT ON (id) * FROM pipeline_logs ORDER BY id, loaded_at DESC NULLS LAST)"
_F = "(SELECT DISTINCT ON (id) * FROM feedback)"
_U = "(SELECT DISTINCT ON (tg_id) * FROM users)"


def now():
    return F.expr(NOW)


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return S.latest_rows(table(spark, d, "messages"), columns=columns)


def logs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return S.latest_rows(table(spark, d, "pipeline_logs"), columns=columns)


def feedback(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return S.latest_rows(table(spark, d, "feedback"), columns=columns)


def of_questions(spark: SparkSession, d: str, **labels) -> DataFrame:
    """(id, labels) of each question of feedback: labelled where it is read, so that questions aren't exchanged to find repeats."""
    rows = spread(table(spark, d, "feedback").select("id", "question"))
    return S.latest_rows(rows.select("id", *[c.alias(n) for n, c in labels.items()]))


def users(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return S.latest_rows(table(spark, d, "users"), "tg_id", columns=columns)


_LAST = f"""(SELECT tg_id, id, role, content, r, CAST(row_number() OVER (PARTITION BY tg_id ORDER BY r DESC) AS INTEGER) AS position FROM (SELECT m.*, row_number() OVER (PARTITION BY tg_id ORDER BY created_at DESC, id DESC) r
 FROM {_M} m WHERE created_at IS NOT NULL AND tg_id IN (SELECT tg_id FROM users)) WHERE r <= 6)"""


@query(f"SELECT tg_id, id, position FROM {_LAST}")
def last_n_messages(spark: SparkSession, d: str) -> DataFrame:
    """D3: the last six messages of each user, oldest first."""
    return S.last_messages(messages(spark, d, "tg_id", "created_at"), table(spark, d, "users")).select("tg_id", "id", "position")


@query(f"SELECT tg_id, string_agg(lower(trim(coalesce(role, ''), ' ')) || ': ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY position) history FROM {_LAST} GROUP BY tg_id")
def chat_history_text(spark: SparkSession, d: str) -> DataFrame:
    """The last messages as one text."""
    return S.history_text(S.last_messages(messages(spark, d, "tg_id", "created_at", "role", "content"), table(spark, d, "users")))


@query(f"SELECT tg_id FROM {_U} WHERE last_active < {NOW} - INTERVAL 48 HOUR AND reengagement_sent_at IS NULL AND journey_state IS NOT NULL ORDER BY last_active, tg_id LIMIT 50")
def idle_users(spark: SparkSession, d: str) -> DataFrame:
    """Users to write to."""
    return S.idle_users(users(spark, d, "last_active", "reengagement_sent_at", "journey_state"), now()).select("tg_id")


@query(f"SELECT count(*) n FROM {_M} WHERE created_at >= {NOW} - INTERVAL 90 DAY")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    """Messages kept by the retention rule."""
    return S.retained(messages(spark, d, "created_at"), now()).agg(F.count("*").alias("n"))


@query(f"SELECT u.tg_id, coalesce(CASE WHEN u.tg_id % 3 = 0 THEN 'AT' END, u.country) country, coalesce(CASE WHEN u.tg_id % 3 = 0 THEN CAST(NULL AS VARCHAR) END, u.target_level) target_level FROM {_U} u UNION ALL SELECT 1, 'AT', NULL")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Given columns set, others kept, new users added."""
    own = users(spark, d, "country", "target_level")
    none = F.lit(None).cast("string").alias("target_level")
    changes = own.where("tg_id % 3 = 0").select("tg_id", F.lit("AT").alias("country"), none)
    fresh = spark.range(1, 2).select(F.col("id").alias("tg_id"), F.lit("AT").alias("country"), none)
    return S.upsert(own, changes.unionByName(fresh), "tg_id").select("tg_id", "country", "target_level")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def ban_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of keys that aren't listed."""
    listed = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return S.without(table(spark, d, "customer").select("c_custkey"), listed, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def permission_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of keys with a permission."""
    admins = table(spark, d, "nation").select(F.col("n_nationkey").alias("tg_id"), (F.col("n_regionkey") == 3).alias("may"))
    return S.permitted(table(spark, d, "customer").select("c_custkey", "c_nationkey"), admins, "may", "c_nationkey").select("c_custkey")


@query(f"WITH g AS (SELECT tg_id FROM users WHERE country IS NULL) SELECT 'messages' AS name, count(*) n FROM {_M} WHERE tg_id IS NULL OR tg_id NOT IN (SELECT tg_id FROM g) UNION ALL SELECT 'feedback', count(*) FROM {_F} WHERE tg_id IS NULL OR tg_id NOT IN (SELECT tg_id FROM g)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left once users are deleted."""
    gone = table(spark, d, "users").where("country is null")
    left = S.cascade_delete({"messages": messages(spark, d, "tg_id"), "feedback": feedback(spark, d, "tg_id")}, gone)
    count = lambda n: left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("messages").unionByName(count("feedback"))


def found_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tg_id", "created_at", "content").where("tg_id is not null and content is not null")
    return rows.select("tg_id", "created_at", F.inline(K.entities(F.col("content")))).withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("messages"))


def _entities_sql() -> str:
    """SQL of classify.entities. RE2 knows word edges of Latin letters only: all signs are doubled, so that an edge may take one of its own."""
    word, edge = "[\\p{L}\\p{N}_]", "(?:^|$|[^\\p{L}\\p{N}_])"
    parts = []
    for kind, patterns in X.ENTITIES.items():
        for p in patterns:
            doubled = "\\b" in p
            groups = re.compile(p).groups
            own = p.replace("\\b", edge).replace("\\w", word) if groups else edge + "(" + p.replace("\\b", "").replace("\\w", word) + ")" + edge
            text = "t2" if doubled else "t"
            found = [f"regexp_extract_all({text}, '(?i){own}', {g})" for g in range(1, max(groups, 1) + 1)]
            value = found[0] if len(found) == 1 else "list_transform(list_zip(" + ", ".join(found) + "), lambda z: concat_ws(' ', " + ", ".join(f"nullif(z[{g}], '')" for g in range(1, len(found) + 1)) + "))"
            parts.append(f"SELECT id, '{kind}' k, trim(regexp_replace(unnest({value}), '([^\\p{{L}}\\p{{N}}_])([^\\p{{L}}\\p{{N}}_])', '\\1', 'g')) v FROM m" if doubled else f"SELECT id, '{kind}' k, trim(unnest({value})) v FROM m")
    names = " ".join(f"WHEN k = '{kind}' AND lower(v) = '{a}' THEN '{b}'" for kind, table_ in X.ENTITY_NAMES.items() for a, b in table_.items())
    return f"""WITH m AS (SELECT id, content t, regexp_replace(content, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') t2 FROM {_M} WHERE tg_id IS NOT NULL AND content IS NOT NULL), e AS ({" UNION ALL ".join(parts)})
SELECT entity_type, entity_value, count(*) n FROM (SELECT DISTINCT id, k entity_type, lower(CASE {names} ELSE v END) entity_value FROM e WHERE length(v) > 1) GROUP BY 1, 2"""


@query(_entities_sql())
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    """Things that users name."""
    return found_entities(spark, d).groupBy("entity_type", F.lower("entity_value").alias("entity_value")).agg(F.count("*").alias("n"))


@query("SELECT user_id tg_id, 'event' entity_type, event_type entity_value, max(value) confidence, arg_min(props, struct_pack(ts := ts, event_id := event_id)) source FROM events GROUP BY 1, 2, 3")
def user_entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Highest confidence and first source per user, type and value."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("tg_id"), F.lit("event").alias("entity_type"), F.col("event_type").alias("entity_value"), F.col("value").alias("confidence"), F.col("props").alias("source"), F.struct("ts", "event_id").alias("created_at"))
    known = F.pmod(F.xxhash64("created_at"), F.lit(2)) == 0  # half of the rows are what is stored, the others what is found
    return S.entity_upsert(rows.where(known), rows.where(~known)).drop("created_at")


@query(
    """WITH e AS (SELECT user_id tg_id, event_type entity_value, max(value) confidence, CASE WHEN event_type = 'click' THEN NULL ELSE max(ts) END updated_at FROM events GROUP BY 1, 2)
SELECT tg_id, entity_value, CAST(row_number() OVER (PARTITION BY tg_id ORDER BY confidence DESC NULLS FIRST, updated_at DESC NULLS FIRST, entity_value) AS INTEGER) rank FROM e"""
)
def user_entities_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Entities by confidence and change, rows without a change first."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("tg_id"), F.col("event_type").alias("entity_value")).agg(F.max("value").alias("confidence"), F.max("ts").alias("__t"))
    rows = rows.withColumn("updated_at", F.when(F.col("entity_value") != "click", F.col("__t"))).withColumn("entity_type", F.lit("event"))
    return S.listed_entities(rows).select("tg_id", "entity_value", "rank")


@query(
    f"""SELECT tg_id, CAST(floor(100 * n / 9) AS INTEGER) progress, CASE WHEN n <= 2 THEN 'novice' WHEN n <= 6 THEN 'in_progress' ELSE 'advanced' END stage
FROM (SELECT tg_id, coalesce(len(list_filter(map_entries(journey_state), lambda e: e.value = 'discussed' AND NOT starts_with(e.key, '_'))), 0) n FROM {_U})"""
)
def journey_progress(spark: SparkSession, d: str) -> DataFrame:
    """Share of stages discussed, and the stage a user is in."""
    return users(spark, d, "journey_state").select("tg_id", S.progress_percent(F.col("journey_state")).alias("progress"), S.user_stage(F.col("journey_state")).alias("stage"))


_STAGES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{k}' END" for k, w in X.STAGES.items()) + "], lambda x: x IS NOT NULL)"


@query(
    f"""WITH f AS (SELECT DISTINCT tg_id, unnest({_STAGES}) stage FROM (SELECT tg_id, lower(coalesce(content, '')) t FROM {_M} WHERE tg_id IS NOT NULL)),
o AS (SELECT tg_id, e.key stage, e.value state FROM (SELECT tg_id, unnest(map_entries(journey_state)) e FROM {_U}))
SELECT tg_id, stage, state FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.tg_id = o.tg_id AND f.stage = o.stage) UNION ALL SELECT tg_id, stage, 'discussed' FROM f WHERE tg_id IN (SELECT tg_id FROM users)"""
)
def journey_update(spark: SparkSession, d: str) -> DataFrame:
    """Stages that a user's messages speak of, merged into the journey."""
    said = messages(spark, d, "tg_id", "content").where("tg_id is not null").select("tg_id", F.explode(K.stages(F.col("content"))).alias("stage")).groupBy("tg_id").agg(F.array_sort(F.collect_set("stage")).alias("found"))
    rows = users(spark, d, "journey_state").join(said, "tg_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return rows.select("tg_id", F.explode(S.merged_stages(F.col("journey_state"), F.col("found"))).alias("stage", "state"))


@query(
    f"""WITH l AS (SELECT * FROM {_L} WHERE created_at >= {NOW} - INTERVAL 700 DAY)
SELECT count(*) queries, count(*) FILTER (WHERE cache_hit) hits, coalesce(round_even(CAST(count(*) FILTER (WHERE cache_hit) AS DOUBLE) / nullif(count(*), 0), 3), 0) cache_hit_rate,
 coalesce(round_even(avg(t_total) FILTER (WHERE t_total >= 0), 2), 0) avg_time, coalesce(round_even(percentile_cont(0.95) WITHIN GROUP (ORDER BY CASE WHEN t_total >= 0 THEN t_total END), 2), 0) p95_time,
 coalesce(round_even(avg(docs_after_grading) FILTER (WHERE NOT coalesce(cache_hit, false)), 1), 0) avg_docs FROM l"""
)
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    """Queries, hits, times."""
    return A.dashboard(logs(spark, d, "created_at", "cache_hit", "t_total", "docs_after_grading"), now() - F.expr("INTERVAL 700 DAYS"))


@query(f"SELECT count(*) total_users, count(*) FILTER (WHERE last_active >= {NOW} - INTERVAL 30 DAY) active_users FROM {_U}")
def user_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2: users, and active ones."""
    return A.user_counts(users(spark, d, "last_active"), now() - F.expr("INTERVAL 30 DAYS"))


@query(f"SELECT p positive, n negative, p + n total, CASE WHEN p + n > 0 THEN CAST(CAST(round_even(100.0 * p / (p + n), 0) AS INTEGER) AS VARCHAR) || '%' ELSE '-' END satisfaction FROM (SELECT count(*) FILTER (WHERE rating = 1) p, count(*) FILTER (WHERE rating = -1) n FROM {_F})")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    """Votes and satisfaction."""
    return A.feedback_stats(feedback(spark, d, "rating"))


@query(f"SELECT coalesce(cache_hit, false) cached, count(*) n, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY t_total), 6) p95 FROM {_L} WHERE t_total >= 0 GROUP BY 1")
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile by cache use."""
    rows = logs(spark, d, "cache_hit", "t_total").withColumn("cached", F.coalesce("cache_hit", F.lit(False)))
    return A.latency_by(rows, "cached").withColumn("p95", F.round("p95", 6))


@query("SELECT event_type, count(*) n, round(avg(value), 6) mean, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) p95 FROM events GROUP BY 1")
def event_latency(spark: SparkSession, d: str) -> DataFrame:
    """A4, A6 over events: counts, means and 95th percentiles by type."""
    rows = table(spark, d, "events")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    p95 = A.exact_percentiles(rows, F.col("value"), 0.95, ["event_type"]).select(F.col("event_type").alias("__e"), F.round("percentile", 6).alias("p95"))
    return means.join(F.broadcast(p95), F.col("event_type").eqNullSafe(F.col("__e")), "left").drop("__e")


@query(
    f"""SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') created, coalesce(question, '') question, CASE WHEN coalesce(cache_hit, false) THEN 'yes' ELSE 'no' END cached,
 coalesce(array_to_string(sources, ', '), '') sources, coalesce(error, '') error FROM {_L} WHERE created_at >= {NOW} - INTERVAL 200 DAY"""
)
def full_report(spark: SparkSession, d: str) -> DataFrame:
    """A10: formatted log rows of a window."""
    return A.report(logs(spark, d, "created_at", "question", "cache_hit", "sources", "error"), now() - F.expr("INTERVAL 200 DAYS"))


def _re2(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


_Q = "lower(trim(coalesce(question, '')))"
_INTENT = f"""CASE WHEN regexp_matches(q, '{_re2(X.CHITCHAT)}') THEN 'CHITCHAT' WHEN regexp_matches(q, '{_re2(X.PERSONAL)}') THEN 'TOOL_ONLY'
 WHEN regexp_matches(q, '{_re2(X.CALCULATOR)}') THEN CASE WHEN regexp_matches(q, '{_re2(X.BUDGET)}') THEN 'TOOL_THEN_RAG' WHEN regexp_matches(q, '{_re2(X.DATE_MATH)}') THEN 'TOOL_ONLY' ELSE 'RAG_ONLY' END
 WHEN regexp_matches(q, '{_re2(X.DOCUMENT)}') THEN CASE WHEN regexp_matches(q, '{X.MINE}') THEN 'TOOL_THEN_RAG' ELSE 'RAG_ONLY' END ELSE 'RAG_ONLY' END"""


@query(f"SELECT id, {_INTENT} intent FROM (SELECT id, {_Q} q FROM {_F})")
def intent_route(spark: SparkSession, d: str) -> DataFrame:
    """The intent of each question."""
    return of_questions(spark, d, intent=K.route_intent(F.col("question"))["intent"])


@query(f"SELECT intent, n, round_even(100.0 * n / sum(n) OVER (), 1) percent FROM (SELECT {_INTENT} intent, count(*) n FROM (SELECT {_Q} q FROM {_F}) GROUP BY 1)")
def routing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares of intents."""
    routed = feedback(spark, d, "question").select(K.route_intent(F.col("question"))["intent"].alias("intent"))
    return A.routing_stats(routed, ["CHITCHAT", "TOOL_ONLY", "TOOL_THEN_RAG", "RAG_ONLY"])


@query()
def query_type_route(spark: SparkSession, d: str) -> DataFrame:
    """Fact, narrative or hybrid question, with weights."""
    rows = of_questions(spark, d, c=K.classify_query(F.col("question")))
    return rows.select("id", "c.query_type", F.round("c.confidence", 6).alias("confidence"), F.array_join("c.universities", ",").alias("universities"), K.search_weights(F.col("c.query_type"))["fact_weight"].alias("fact_weight"))


def _case(lexicon: dict[str, list[str]], column: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{'|'.join(w)}') THEN '{k}'" for k, w in lexicon.items()) + f" ELSE {otherwise} END"


@query(f"SELECT id, {_case(X.FOCUS, 't', 'NULL')} focus, {_case(X.MOODS, 't', chr(39) + 'calm' + chr(39))} mood FROM (SELECT id, lower(coalesce(content, '')) t FROM {_M})")
def focus_and_mood(spark: SparkSession, d: str) -> DataFrame:
    """Focus and mood of each message."""
    return messages(spark, d, "content").select("id", K.entity_focus(F.col("content")).alias("focus"), K.mood(F.col("content")).alias("mood"))


@query(f"SELECT id, array_to_string(list_sort({_STAGES}), ',') stages FROM (SELECT id, lower(coalesce(content, '')) t FROM {_M})")
def stage_detection(spark: SparkSession, d: str) -> DataFrame:
    """Stages that each message speaks of."""
    return messages(spark, d, "content").select("id", F.array_join(K.stages(F.col("content")), ",").alias("stages"))


_TOPIC = "list_max([" + ", ".join("struct_pack(n := " + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + f", o := {-i}, t := '{k}')" for i, (k, words) in enumerate(X.TOPICS.items())) + "])"


@query(f"SELECT id, CASE WHEN b.n > 0 THEN b.t END topic FROM (SELECT id, {_TOPIC} b FROM (SELECT id, lower(coalesce(answer, '')) t FROM {_F}))")
def answer_topic(spark: SparkSession, d: str) -> DataFrame:
    """Topic of each answer."""
    return feedback(spark, d, "answer").select("id", K.topic(F.col("answer")).alias("topic"))


@query(f"SELECT id, array_to_string(list_transform(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: list_transform(regexp_split_to_array(x, '\\s*,\\s*'), lambda y: CAST(y AS INTEGER)))))), lambda z: CAST(z AS VARCHAR)), ',') cited FROM {_F}")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that answers cite."""
    return feedback(spark, d, "answer").select("id", F.array_join(F.transform(T.cited_numbers(F.coalesce("answer", F.lit(""))), lambda x: x.cast("string")), ",").alias("cited"))


_JSON = "(?s)(\\{.*\\})"


@query(
    f"""WITH b AS (SELECT id, coalesce(answer, '') a, regexp_extract(coalesce(answer, ''), '{_JSON}', 1) b FROM {_F}),
j AS (SELECT *, CASE WHEN json_valid(b) THEN b END j FROM b),
p AS (SELECT *, json_extract_string(j, '$.answer') parsed, replace(replace(replace(regexp_extract(a, '(?s)"answer"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)', 1), '\\n', chr(10)), '\\"', '"'), '\\\\', '\\') loose,
  CASE WHEN json_type(j, '$.suggested_questions') = 'ARRAY' THEN json_array_length(j, '$.suggested_questions')
   ELSE len(regexp_extract_all(regexp_extract(a, '(?s)"suggested_questions"\\s*:\\s*\\[(.*?)(?:\\]|$)', 1), '"((?:[^"\\\\]|\\\\.)*)"')) END n,
  NOT (coalesce(json_extract_string(j, '$.is_faithful') = 'false', false) OR coalesce(json_array_length(j, '$.unsupported_claims') > 0, false)) f FROM j),
r AS (SELECT *, coalesce(parsed, nullif(loose, ''), a) t FROM p)
SELECT id, CASE WHEN length(regexp_replace(t, '[[:punct:]\\s\\x0b]', '', 'g')) >= 3 THEN t ELSE 'Извините, ответ не получился.' END answer, CAST(n AS INTEGER) n_suggested, f is_faithful FROM r"""
)
def answer_json_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers out of JSON, with suggestions, and verdicts."""
    rows = feedback(spark, d, "answer").select("id", T.answer_and_suggestions(F.coalesce("answer", F.lit("")), "Извините, ответ не получился.").alias("a"), T.faithfulness(F.col("answer")).alias("f"))
    return rows.select("id", "a.answer", F.size("a.suggested").alias("n_suggested"), "f.is_faithful")


def _html_sql(x: str) -> tuple[str, str]:
    """SQL of text.sanitized_html and plain_text; allowed tags are hidden while the others go."""
    end = lambda y: f"regexp_replace(regexp_replace({y}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    block, allowed = "|".join(T.BLOCK_TAGS), "|".join(T.ALLOWED_TAGS)
    y = f"regexp_replace(regexp_replace({x}, '(?i)</?(?:{block})(?:\\s+[^>]*)?>', chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g')"
    y = f"regexp_replace({y}, '(?i)<(/?(?:{allowed})(?:\\s+[^>]*)?/?)>', chr(1) || '\\1' || chr(2), 'g')"
    y = f"replace(replace(regexp_replace({y}, '</?[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]*(?:\\s+[^>]*)?/?>', '', 'g'), chr(1), '<'), chr(2), '>')"
    plain = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?(?:{block})[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    return end(y), end(plain)


@query("SELECT id, {} html, {} plain FROM (SELECT id, coalesce(answer, '') a FROM {})".format(*_html_sql("a"), _F))
def sanitize_html(spark: SparkSession, d: str) -> DataFrame:
    """Answers with allowed tags only, and without any."""
    a = F.coalesce("answer", F.lit(""))
    return feedback(spark, d, "answer").select("id", T.sanitized_html(a).alias("html"), T.plain_text(a).alias("plain"))


_HEX = "CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':layout'), {a}, 16)) AS UBIGINT)"


@query(
    f"""WITH b AS (SELECT c_custkey tg_id, CAST((({_HEX.format(a=1)} % 10000) * 1616 + {_HEX.format(a=17)} % 10000) % 10000 AS INTEGER) bucket FROM customer)
SELECT tg_id, bucket, CASE WHEN bucket < 3400 THEN 'a' WHEN bucket < 6700 THEN 'b' ELSE 'c' END variant FROM b"""
)
def ab_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Variant of each user."""
    splits = spark.createDataFrame([("layout", "a", 0, 0.34), ("layout", "b", 1, 0.33), ("layout", "c", 2, 0.33)], "experiment string, variant string, ord int, split double")
    return E.assigned(table(spark, d, "customer").select(F.col("c_custkey").alias("tg_id")), splits).select("tg_id", "bucket", "variant")


@query("SELECT 'speed' experiment, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END variant, event_type metric, count(*) n, round(avg(value), 6) mean, min(value) least, max(value) most FROM events GROUP BY 2, 3")
def ab_metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    """E5: metrics by variant."""
    rows = table(spark, d, "events").select(F.lit("speed").alias("experiment"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), F.col("event_type").alias("metric"), "value")
    return E.rolled_up(rows).withColumn("mean", F.round("mean", 6))


@query("SELECT 'one' experiment, CAST(1.0 AS DOUBLE) total, true is_valid UNION ALL SELECT 'two', CAST(0.9 AS DOUBLE), false")
def split_validation(spark: SparkSession, d: str) -> DataFrame:
    """Whether splits sum to one."""
    return E.valid_splits(spark.createDataFrame([("one", 0.34), ("one", 0.33), ("one", 0.33), ("two", 0.9)], "experiment string, split double"))


@query(
    """SELECT difficulty, topic, CAST(grouping(difficulty, topic) AS BIGINT) level, count(*) FILTER (WHERE NOT failed) n, count(*) FILTER (WHERE failed) n_failed, round_even(avg(recall) FILTER (WHERE NOT failed), 3) recall, round_even(avg(coverage) FILTER (WHERE NOT failed), 3) coverage,
 round_even(avg(latency) FILTER (WHERE NOT failed), 2) latency, round_even(avg(CASE WHEN urls THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT failed), 3) hallucination_rate
FROM (SELECT lang difficulty, topic, n_chars / 997.0 latency, CASE WHEN contains(lower(coalesce(text, '')), 'ects') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), 'pdf') THEN 0.5 ELSE 0 END recall,
 CASE WHEN contains(lower(coalesce(text, '')), 'visa') THEN 1.0 ELSE 0 END coverage, contains(coalesce(text, ''), 'http') urls, doc_id % 7 = 0 failed FROM documents)
GROUP BY GROUPING SETS ((difficulty), (topic), ())"""
)
def eval_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Means in all, by group and by topic, without the rows that failed."""
    kw = lambda *words: F.array(*[F.lit(w) for w in words])
    rows = table(spark, d, "documents").select(
        F.col("lang").alias("difficulty"), "topic", (F.col("n_chars") / 997.0).alias("latency"), A.keyword_recall(F.col("text"), kw("ECTS", "PDF")).alias("recall"), A.keyword_recall(F.col("text"), kw("Visa")).alias("coverage"),
        (F.size(A.unsupported_urls(F.when(F.contains("text", F.lit("http")), F.col("text")), F.lit(""))) > 0).alias("has_unsupported_urls"), F.when(F.col("doc_id") % 7 == 0, "failed").alias("error"),
    )
    return A.evaluation(rows, "recall", "coverage")


@query(
    """SELECT *, CASE WHEN days IS NULL THEN 'error' WHEN days < 0 THEN 'expired' WHEN days = 0 THEN 'today' WHEN days <= 7 THEN 'urgent' WHEN days <= 30 THEN 'soon' ELSE 'ok' END bucket
FROM (SELECT o_orderkey, CAST(floor((epoch_us(CAST(o_orderdate AS TIMESTAMP)) - epoch_us(TIMESTAMP '1998-01-01 10:00:00')) / 86400000000) AS INTEGER) AS days FROM orders)"""
)
def days_until_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Whole days from a moment to a date, rounded down."""
    rows = table(spark, d, "orders").select("o_orderkey", A.days_until(F.col("o_orderdate").cast("timestamp"), F.expr("TIMESTAMP '1998-01-01 10:00:00'")).alias("u"))
    return rows.select("o_orderkey", "u.days", "u.bucket")


@query(
    f"""SELECT id, '{X.REPORTED}' AS document, CASE WHEN regexp_matches(t, '{"|".join(X.LACKING)}') THEN 'not_done' ELSE 'done' END state FROM (SELECT id, lower(coalesce(content, '')) t FROM {_M})
WHERE contains(t, '{X.REPORTED}') AND regexp_matches(t, '{"|".join(X.LACKING + X.HAVING)}')"""
)
def reported_facts(spark: SparkSession, d: str) -> DataFrame:
    """What users say about a document of theirs."""
    return messages(spark, d, "content").select("id", F.explode(K.reported_facts(F.col("content"))).alias("document", "state"))


_MINUTE = "coalesce(strftime({c}, '%Y-%m-%d %H:%M'), '')"


@query(f"SELECT tg_id, country, target_level, german_level, english_level, {_MINUTE.format(c='created_at')} created, {_MINUTE.format(c='last_active')} active FROM {_U}")
def user_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A10: the sheet of users."""
    return A.user_sheet(users(spark, d, "country", "target_level", "german_level", "english_level", "created_at", "last_active"))


@query(f"SELECT id, tg_id, CASE WHEN rating = 1 THEN '👍' ELSE '👎' END vote, question, answer, {_MINUTE.format(c='created_at')} created FROM {_F} WHERE created_at >= {NOW} - INTERVAL 200 DAY")
def feedback_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A10: the sheet of votes in a window."""
    return A.feedback_sheet(feedback(spark, d, "tg_id", "rating", "question", "answer", "created_at"), now() - F.expr("INTERVAL 200 DAYS"))


@query(
    f"""WITH p AS (SELECT tg_id, max(created_at) ts FROM {_F} WHERE tg_id IS NOT NULL GROUP BY 1)
SELECT coalesce(u.tg_id, p.tg_id) tg_id, epoch_us(coalesce(p.ts, u.last_active)) last_active, epoch_us(CASE WHEN p.tg_id IS NULL THEN u.reengagement_sent_at END) reengagement_sent_at FROM {_U} u FULL JOIN p ON p.tg_id = u.tg_id"""
)
def active_after_messages(spark: SparkSession, d: str) -> DataFrame:
    """Users after question and answer pairs are added: unknown ones are created, their last activity is set, their reminder is cleared."""
    after = S.active_after(users(spark, d, "last_active", "reengagement_sent_at"), feedback(spark, d, "tg_id", "created_at"))
    return after.select("tg_id", F.unix_micros("last_active").alias("last_active"), F.unix_micros("reengagement_sent_at").alias("reengagement_sent_at"))
