"""Queries over what becomes of questions and answers, over pairs of messages, registers and joined texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import answers as R
from tamarack.functions import classify as K
from tamarack.functions import text as T
from tamarack.operators import analytics as A
from tamarack.operators import chunk as C
from tamarack.operators import ingest as I
from tamarack.operators import rank as G
from tamarack.operators import store as S
from tamarack.queries.conversation import _F, _INTENT, _Q, _TOPIC, _U, NOW, feedback, now, of_questions, users
from tamarack.queries.knowledge import _D, _packing_sql, _strip
from tamarack.queries.registry import query
from tamarack.queries.retrieval import chunks
from tamarack.session import spread, table


@query(
    f"""SELECT id, 'В: ' || substr(question, 1, 150) || ' | О: ' || substr(answer, 1, 200) line, CASE WHEN length(question) > 60 THEN substr(question, 1, 57) || '...' ELSE question END label,
 {_strip("regexp_replace(question, '^/?Как', '')")} bare, CASE WHEN contains(coalesce(answer, ''), '%') THEN '⚠️ ' || 'a' || '; ' || 'b' || chr(10) || chr(10) || answer ELSE answer END cautious,
 CASE WHEN rating = 1 THEN '[days]' || chr(10) || 'three' || coalesce(chr(10) || chr(10) || nullif(answer, ''), '') ELSE answer END with_tool, 'Q ' || coalesce(question, '') || ' / ' || coalesce(CAST(rating AS VARCHAR), '') filled, sha256(question) || '_t64' AS key FROM {_F}"""
)
def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines, labels, cautions, tool results, templates and keys made of questions and answers."""
    warnings = F.when(F.contains(F.coalesce("answer", F.lit("")), F.lit("%")), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = feedback(spark, d, "question", "answer", "rating")
    return rows.select(
        "id", T.summary_line(F.col("question"), F.col("answer")).alias("line"), T.button_label(F.col("question")).alias("label"), T.without_command(F.col("question"), "Как").alias("bare"), R.with_disclaimer(F.col("answer"), warnings).alias("cautious"),
        R.context_with_tool(F.lit("days"), F.when(F.col("rating") == 1, "three"), F.col("answer")).alias("with_tool"), T.rendered(F.lit("Q {q} / {{ r }}"), {"q": F.col("question"), "r": F.col("rating")}).alias("filled"), R.embedding_key(F.col("question"), 64).alias("key"),
    )


_SMALL = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{k}'" for k, p in R.SMALL_TALK.items())


@query(f"SELECT id, CASE {_SMALL} ELSE 'ok' END kind FROM (SELECT id, lower(trim(coalesce(question, ''), ' ')) q FROM {_F})")
def small_talk(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of small talk."""
    return of_questions(spark, d, kind=R.small_talk(F.col("question")))


@query(f"SELECT id, intent IN ('RAG_ONLY', 'TOOL_THEN_RAG') use_rag, intent IN ('TOOL_ONLY', 'TOOL_THEN_RAG') use_tools, intent = 'CHITCHAT' is_chitchat FROM (SELECT id, {_INTENT} intent FROM (SELECT id, {_Q} q FROM {_F}))")
def route_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What an intent calls for."""
    routed = of_questions(spark, d, p=K.route_predicates(K.route_intent(F.col("question"))["intent"]))
    return routed.select("id", "p.*")


_PAIRS = f"(SELECT tg_id, epoch_us(created_at) at_us, unnest([{{'role': 'user', 'content': question, 'turn': 0}}, {{'role': 'assistant', 'content': answer, 'turn': 1}}], recursive := true) FROM {_F})"


@query(f"SELECT tg_id, at_us, role, CAST(turn AS INTEGER) turn, substr(content, 1, 100) AS content FROM {_PAIRS} UNION ALL SELECT tg_id, epoch_us(created_at), 'user', 0, conversation_summary FROM {_U} WHERE conversation_summary IS NOT NULL")
def appended_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer pairs as two rows each, shortened and appended to what there is."""
    there = users(spark, d, "created_at", "conversation_summary").where("conversation_summary is not null").select("tg_id", "created_at", F.lit("user").alias("role"), F.lit(0).alias("turn"), F.col("conversation_summary").alias("content"))
    pairs = S.message_pairs(feedback(spark, d, "tg_id", "question", "answer", "created_at"))
    return S.appended(there, pairs, ["content"], 100).select("tg_id", F.unix_micros("created_at").alias("at_us"), "role", "turn", "content")


@query(f"SELECT tg_id, CASE WHEN tg_id IN (SELECT tg_id FROM feedback WHERE rating = -1) THEN 'AT' ELSE country END country, epoch_us(CASE WHEN tg_id IN (SELECT tg_id FROM feedback WHERE rating = -1) THEN {NOW} ELSE CAST(reengagement_sent_at AS TIMESTAMP) END) sent FROM {_U}")
def columns_set(spark: SparkSession, d: str) -> DataFrame:
    """Columns set for the users that are listed, whatever the repeats in the list."""
    listed = table(spark, d, "feedback").where("rating = -1 and tg_id is not null")
    out = S.set_columns(users(spark, d, "country", "reengagement_sent_at"), listed, "tg_id", country=F.lit("AT"), reengagement_sent_at=now())
    return out.select("tg_id", "country", F.unix_micros("reengagement_sent_at").alias("sent"))


@query("SELECT user_id tg_id, event_type entity_type, array_to_string(list_sort(list(DISTINCT props)), '|') AS listed FROM events GROUP BY 1, 2")
def entities_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Different values by user and type."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("tg_id"), F.col("event_type").alias("entity_type"), F.col("props").alias("entity_value"))
    return A.grouped_entities(rows).select("tg_id", "entity_type", F.array_join("values", "|").alias("listed"))


@query(
    f"""WITH d AS (SELECT x.metadata.source query_id, x.metadata.entity_type et, id, content FROM {_D} x WHERE x.metadata.source IS NOT NULL),
t AS (SELECT query_id, list(DISTINCT et) FILTER (WHERE et IS NOT NULL) types, arg_min(content, id) answer FROM d GROUP BY 1)
SELECT query_id, topic, types IS NULL OR topic IS NULL OR list_contains(types, topic) OR list_contains(types, 'general') is_valid FROM (SELECT query_id, types, CASE WHEN b.n > 0 THEN b.t END topic FROM (SELECT query_id, types, {_TOPIC} b FROM (SELECT *, lower(coalesce(answer, '')) t FROM t)))"""
)
def category_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text's topic is among the types of the chunks of its file."""
    docs = chunks(spark, d).where("source is not null").select(F.col("source").alias("query_id"), "entity_type", "id", "content")
    answers = docs.groupBy("query_id").agg(F.min_by("content", "id").alias("answer"))
    # lists without any type have no chunks that say something
    return G.category_check(answers, docs.where("entity_type is not null")).select("query_id", "topic", "is_valid")


@query(
    f"""WITH r AS (SELECT trim(split_part(split_part(x.metadata.source_url, '|', 1), '#', 1), ' ') url, id, content, FROM {_D} x WHERE content IS NOT NULL),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY url ORDER BY id) - 1) // 5 AS INTEGER) part FROM r WHERE url <> '')
SELECT url, part, md5(string_agg(content, chr(10) || chr(10) ORDER BY id)) text_md5 FROM n GROUP BY 1, 2"""
)
def joined_contents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of an address joined in their order, in parts of at most five."""
    joined = I.joined_contents(chunks(spark, d), pos="id", most=5)
    return joined.select("url", "part", F.md5("text").alias("text_md5"))


@query("SELECT file, concat_ws(' | ', '', file, url, 'ok', substr(md5(coalesce(url, '')), 1, 8), '') AS row FROM (SELECT DISTINCT file, url FROM sources)")
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    """K5: the register of sources as lines of a table."""
    pages = table(spark, d, "sources").select("file", "url").distinct().withColumn("status", F.lit("ok")).withColumn("content_hash", T.short_hash(F.coalesce("url", F.lit(""))))
    return I.source_registry(pages).select("file", "row")


@query(f"WITH a AS ({_packing_sql()}) SELECT c.key, c.pos, md5(p.content) parent_md5 FROM a c JOIN (SELECT parent_id, min(content) AS content FROM a WHERE is_parent GROUP BY 1 HAVING count(DISTINCT content) = 1) p ON p.parent_id = c.parent_id WHERE c.is_child")
def children_with_parents(spark: SparkSession, d: str) -> DataFrame:
    """Children with the text of their parent, where one id names one text."""
    all_ = C.parent_child(spread(table(spark, d, "documents").select("doc_id", "text", "source")), key="doc_id", content="text", source="source")
    one = all_.where("is_parent").groupBy("parent_id").agg(F.count_distinct("content").alias("n")).where("n = 1").select("parent_id")
    found = C.expand_to_parent(all_.where("is_child").join(one, "parent_id", "left_semi"), all_)
    return found.select("key", "pos", F.md5("parent_content").alias("parent_md5"))


@query("SELECT coalesce(topic, '') topic, CASE WHEN count(*) FILTER (WHERE url IS NULL) > 0 THEN 'old' ELSE 'new' END state FROM (SELECT DISTINCT file, url, topic FROM sources) GROUP BY 1")
def index_states(spark: SparkSession, d: str) -> DataFrame:
    """Stored states after a run that indexed the topics whose files all have an address."""
    files = table(spark, d, "sources").select("file", "url", F.coalesce("topic", F.lit("")).alias("topic")).distinct()
    by = files.groupBy("topic").agg(F.count_if(F.col("url").isNull()).alias("n"))
    return C.index_state(by.select("topic", F.lit("old").alias("state")), by.where("n = 0").select("topic", F.lit("new").alias("state")), "topic")


@query(f"SELECT id, array_to_string(list_concat(CASE WHEN nullif({_strip("coalesce(x.metadata.title, '')")}, '') IS NULL THEN [] ELSE [{_strip("x.metadata.title")}] END, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')), chr(10)) AS lines FROM {_D} x")
def plain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages wrapped as HTML as lines without marks."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(safe("content"), "\\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><nav>Menu</nav><h2>"), safe("title"), F.lit("</h2>"), body, F.lit("<script>x()</script><footer>Imprint</footer></html>"))
    return chunks(spark, d).select("id", I.html_to_plain_lines(page).alias("lines"))
