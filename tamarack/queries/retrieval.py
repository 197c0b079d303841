"""Retrieval and ranking queries over embeddings and simple_documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import vectors as V
from tamarack.operators import rank as G
from tamarack.operators import retrieve as R
from tamarack.operators.chunk import vector_dims
from tamarack.operators.store import latest_rows
from tamarack.queries.registry import query
from tamarack.session import cut, spread, table

#: The query set of the searches: every row with an id divisible by this, against all rows.
EVERY = 20
_COS = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_DOCS = "(SELECT DISTINCT ON (id) * FROM simple_documents)"
_USABLE = "len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"


def rows_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    """simple_documents with its copied rows, metadata as columns: for what counts copies once by itself."""
    names = ("source", "title", "section_path", "source_url", "topic", "country_scope", "level", "entity_type", "tags", "is_yaml_fact", "fact_type", "valid_for", "university")
    return table(spark, d, "simple_documents").select("id", "content", "embedding", *[F.col(f"metadata.{n}").alias(n) for n in names])


def searched(spark: SparkSession, d: str) -> DataFrame:
    """What a search looks at, dealt out over all cores."""
    return spread(rows_of_chunks(spark, d).select("id", "content", "embedding", "title", *[c for c in R.OF_CHUNK if c not in ("content", "boost")]))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per id. Columns that a query doesn't use are pruned before the exchange."""
    return latest_rows(rows_of_chunks(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def every_query(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _batch_sql(k: int, boost: str = "0") -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id query_id, e.vec_id id, round({_COS.format(a='e.embedding', b='q.embedding')} + {boost}, 6) score,
      CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')} + {boost}, 9), e.vec_id) AS INTEGER) rank
      FROM embeddings e, embeddings q WHERE {_ASKED}) WHERE rank <= {k}"""


_ASKED = f"q.vec_id % {EVERY} = 0"


@query(f"SELECT e.vec_id id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9), e.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to one query."""
    rows = vectors(spark, d)
    q = rows.where("id = 0").first()["embedding"]
    return R.top_k(rows, q, 10, score=F.round("distance", 9)).select("id", F.round("distance", 6).alias("distance"))


@query(_batch_sql(5))
def vector_topk_batched(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors for each query of the query set."""
    rows = vectors(spark, d)
    return R.top_k_batched(rows, every_query(rows), 5).withColumn("score", F.round("score", 6))


@query(_batch_sql(10))
def vector_topk_hundred(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors for each query of the query set, a hundred queries at sf0.1."""
    rows = vectors(spark, d)
    return R.top_k_batched(rows, every_query(rows), 10).withColumn("score", F.round("score", 6))


@query(_batch_sql(5, "CASE WHEN e.label % 2 = 0 THEN -0.24 ELSE -0.06 END + CASE WHEN e.label = 3 THEN -0.18 ELSE 0 END"))
def hybrid_boosted_topk(spark: SparkSession, d: str) -> DataFrame:
    """Distance with boosts for facts (even labels) and for a focus (label 3)."""
    rows = vectors(spark, d)
    boost = R.fact_boost(F.col("label") % 2 == 0, F.lit(0.8), F.lit(0.2)) + F.when(F.col("label") == 3, R.HOUSING_BOOST).otherwise(0.0)
    return R.top_k_batched(rows.withColumn("boost", boost), every_query(rows), 5, boost="boost").withColumn("score", F.round("score", 6))


_TERMS = "['нострификация','диплома','занимает','wien']"


def usable(docs: DataFrame) -> DataFrame:
    return docs.where(V.usable(F.col("embedding"), 64))


def _question(docs: DataFrame) -> tuple[list[float], list[str]]:
    q = usable(docs).orderBy("id").select("embedding").first()
    return list(q["embedding"]), ["нострификация", "диплома", "занимает", "wien"]


_HYBRID = f"""WITH d AS (SELECT * FROM {_DOCS} WHERE {_USABLE}),
q AS (SELECT embedding e FROM d ORDER BY id LIMIT 1),
s AS (SELECT id, d.metadata.level lv, {_COS.format(a='d.embedding', b='q.e')} v,
  1 - len(list_intersect({_TERMS}, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+'))) / 4.0 t,
  CASE WHEN coalesce(d.metadata.is_yaml_fact, false) THEN -0.24 ELSE -0.06 END fb,
  CASE WHEN coalesce(d.metadata.entity_type = 'housing' OR d.metadata.topic = 'housing', false) THEN -0.18 ELSE 0 END eb
  FROM d, q WHERE list_contains(d.metadata.country_scope, 'ALL') OR list_contains(d.metadata.country_scope, 'RU'))
SELECT id, round(sc, 6) score FROM (SELECT *, round(0.7 * v + 0.3 * t + fb + eb, 9) sc, CASE WHEN list_contains(lv, 'bachelor') THEN 0 ELSE 1 END k FROM s)
ORDER BY k, sc, id LIMIT 10"""


@query(_HYBRID)
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Scope filter, level before score, vector and lexical distance, boosts; the ten best chunks."""
    vector, terms = _question(rows_of_chunks(spark, d))
    found = usable(rows_of_chunks(spark, d)).where(R.in_scope(F.col("country_scope"), "RU"))
    text = R.lexical_distance_to(F.col("content"), terms)
    boosts = (R.fact_boost(F.col("is_yaml_fact"), F.lit(0.8), F.lit(0.2)), R.focus_boost(F.lit("housing"), F.col("entity_type"), F.col("topic")))
    score = F.round(R.hybrid_score(F.col("distance"), text, *boosts), 9)
    return R.top_k(found, vector, 10, score=score, first=R.level_key(F.col("level"), "bachelor")).select("id", F.round("score", 6).alias("score"))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+'))"


@query(
    f"""WITH d AS (SELECT *, coalesce(d.metadata.is_yaml_fact, false) fact, d.metadata.level lv, d.metadata.country_scope sc, {_WORDS.format(x="content")} words,
  coalesce(d.metadata.entity_type = 'housing' OR d.metadata.topic = 'housing', false) housing, coalesce(d.metadata.entity_type = 'food' OR d.metadata.topic IN ('student-budget', 'food'), false) food FROM {_DOCS} d WHERE {_USABLE}),
q AS (SELECT id query_id, embedding qe, {_WORDS.format(x="d.metadata.title")} terms, [NULL, 'RU', 'UA', 'ALL'][id // {EVERY} % 4 + 1] country, [NULL, 'bachelor', 'master'][id // {EVERY} % 3 + 1] want,
  [0.5, 0.8, 0.2][id // {EVERY} % 3 + 1] fw, [0.5, 0.2, 0.8][id // {EVERY} % 3 + 1] nw, ['housing', 'food', ''][id // {EVERY} % 3 + 1] focus FROM d WHERE id % {EVERY} = 0),
s AS (SELECT query_id, id, CASE WHEN want IS NULL OR coalesce(list_contains(lv, want), false) THEN 0 ELSE 1 END later,
  round(0.7 * ({_COS.format(a='embedding', b='qe')}) + 0.3 * CASE WHEN len(terms) > 0 THEN 1 - len(list_intersect(terms, words)) / len(terms) ELSE 1 END - 0.3 * CASE WHEN fact THEN fw ELSE nw END
   + CASE WHEN focus = 'housing' AND housing THEN -0.18 WHEN focus = 'food' AND food THEN -0.15 ELSE 0 END, 9) score
  FROM d, q WHERE country IS NULL OR country = 'ALL' OR list_contains(sc, 'ALL') OR list_contains(sc, country))
SELECT query_id, id, round(score, 6) score, CAST(r AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, score, id) r FROM s) WHERE r <= 10"""
)
def hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    """R1 to R10 for a set of queries: every chunk with an id divisible by 20 asks by its vector and its title, with a country, level, weights and focus of its own."""
    docs = searched(spark, d)
    n = F.floor(F.col("id") / EVERY)
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    asked = latest_rows(docs.where(F.col("id") % EVERY == 0).select("id", "embedding", "title")).select(
        F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), R.query_terms(F.col("title")).alias("terms"), pick(None, "RU", "UA", "ALL").alias("country"), pick(None, "bachelor", "master").alias("level"),
        pick(0.5, 0.8, 0.2).alias("fact_weight"), pick(0.5, 0.2, 0.8).alias("narrative_weight"), pick("housing", "food", "").alias("focus"),
    )
    return R.hybrid_top_k(docs, asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT count(*) n, count(*) FILTER (WHERE list_contains(x.metadata.level, 'bachelor')) n_level FROM {_DOCS} x WHERE list_contains(x.metadata.country_scope, 'ALL') OR list_contains(x.metadata.country_scope, 'UA')")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the scope of a country, and those of a level."""
    docs = chunks(spark, d).where(R.in_scope(F.col("country_scope"), "UA"))
    return docs.agg(F.count("*").alias("n"), F.count_if(F.array_contains("level", "bachelor")).alias("n_level"))


@query(
    """WITH t AS (SELECT doc_id, len(list_intersect(['admission','certificate','german','letter'], regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}]+'))) m FROM documents)
SELECT doc_id, round(1 - m / 4.0, 6) distance FROM t ORDER BY round(1 - m / 4.0, 6), doc_id LIMIT 20"""
)
def lexical_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents by share of the question's terms."""
    terms = spark.range(1).select(R.query_terms(F.lit("Admission letter, German certificate"))).first()[0]
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.round(R.lexical_distance_to(F.col("text"), terms), 6).alias("distance"))
    return rows.orderBy("distance", "doc_id").limit(20)


@query(
    """WITH w AS (SELECT doc_id, unnest(l) x, generate_subscripts(l, 1) i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') l FROM documents)),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) b, lag(i) OVER (PARTITION BY doc_id ORDER BY i) j FROM w WHERE x IN ('программы', 'семестр'))
SELECT doc_id, round(sum(0.1 / (i - j)), 6) rank FROM p WHERE b <> x GROUP BY 1"""
)
def cover_density(spark: SparkSession, d: str) -> DataFrame:
    """Documents with both terms of a question, ranked by how close together they stand."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.round(R.cover_rank(F.col("text"), ["программы", "семестр"]), 6).alias("rank")).where("rank > 0")


@query(
    f"""WITH r AS (SELECT q.vec_id // {3 * EVERY} query_id, q.vec_id sub, e.vec_id id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9), e.vec_id) rank FROM embeddings e, embeddings q WHERE {_ASKED}),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY sub, rank) n FROM r WHERE rank <= 3)
SELECT query_id, id, CAST(position AS INTEGER) position FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank) position FROM f WHERE n = 1) WHERE position <= 6"""
)
def decomposed_merge(spark: SparkSession, d: str) -> DataFrame:
    """The query set as sub-queries, three a question; first of equal results, cut to six."""
    rows = vectors(spark, d)
    found = R.top_k_batched(rows, every_query(rows), R.per_subquery_k(6, 3))
    found = found.select(F.floor(F.col("query_id") / (3 * EVERY)).alias("query_id"), F.col("query_id").alias("sub"), "rank", "id", F.col("id").cast("string").alias("content"))
    return R.merged_subqueries(found, 6).select("query_id", "id", "position")


@query(
    f"""SELECT query_id, entry_id, similarity FROM (SELECT q.vec_id query_id, e.vec_id entry_id, round(1 - round({_COS.format(a='e.embedding', b='q.embedding')}, 9), 6) similarity,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9), e.vec_id) n FROM embeddings q, embeddings e WHERE q.vec_id >= 128 AND e.vec_id < 128) WHERE n = 1 AND similarity >= 0.3"""
)
def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of the 128 cache entries (the size of the cache) for all other rows, above a threshold (0.3, as these vectors lie far apart)."""
    rows = vectors(spark, d)
    entries = rows.where("id < 128").select(F.col("id").alias("entry_id"), F.col("embedding").alias("vector"))
    return R.cache_lookup(rows.where("id >= 128").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), entries, 0.3)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 128")
def cache_fifo_window(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of 128 entries holds."""
    return R.newest(table(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))).select("event_id")


@query("SELECT len(embedding) dims, count(*) n FROM simple_documents WHERE embedding IS NOT NULL GROUP BY 1")
def embedding_dims(spark: SparkSession, d: str) -> DataFrame:
    """Vector lengths in use."""
    return vector_dims(table(spark, d, "simple_documents")).withColumn("dims", F.col("dims").cast("long"))


@query("SELECT vec_id id, round(sqrt(list_sum(list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 16), lambda x: x * x))), 6) size FROM embeddings")
def embedding_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors cut to fewer dimensions."""
    return vectors(spark, d).select("id", F.round(V.norm(V.truncated(F.col("embedding"), 16)), 6).alias("size"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """All chunks as result lists of up to eight: those of a file by id, chunks without a file as one more file."""
    docs = chunks(spark, d).drop("embedding")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1
    name = F.concat(F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source")), F.lit("#"), F.floor(pos / 8).cast("string"))
    return docs.withColumn("query_id", name).withColumn("pos", pos % 8 + 1)


_LISTED = f"""(SELECT * REPLACE (pos % 8 + 1 AS pos), CASE WHEN query_source IS NULL THEN '-' ELSE '=' || query_source END || '#' || (pos // 8) query_id
 FROM (SELECT x.*, x.metadata.source query_source, row_number() OVER (PARTITION BY x.metadata.source ORDER BY id) - 1 pos FROM {_DOCS} x))"""


_KEY = "coalesce(nullif(l.metadata.source_url, ''), nullif(l.metadata.source, ''), '')"


@query(
    f"""WITH l AS (SELECT query_id, pos, {_KEY} k FROM {_LISTED} l), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY pos) n FROM l),
s AS (SELECT *, sum(CASE WHEN n = 1 OR k = '' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) no FROM f)
SELECT query_id, CAST(pos AS INTEGER) pos, CAST(CASE WHEN k = '' THEN max(no) OVER (PARTITION BY query_id, k) ELSE min(no) FILTER (WHERE n = 1) OVER (PARTITION BY query_id, k) END AS BIGINT) number FROM s"""
)
def source_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sources by first sight."""
    return G.numbered_sources(_listed(spark, d)).select("query_id", "pos", "number")


_NUMBERED = f"""WITH l AS (SELECT l.*, {_KEY} k, nullif(l.metadata.title, '') ti, nullif(l.metadata.section_path, '') se, nullif(l.metadata.source_url, '') su, nullif(l.metadata.valid_for, '') va FROM {_LISTED} l), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY pos) n FROM l),
s AS (SELECT *, sum(CASE WHEN n = 1 OR k = '' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) no FROM f),
m AS (SELECT *, CASE WHEN k = '' THEN max(no) OVER (PARTITION BY query_id, k) ELSE min(no) FILTER (WHERE n = 1) OVER (PARTITION BY query_id, k) END number FROM s)
"""


@query(
    _NUMBERED
    + """SELECT query_id, string_agg('[' || number || ']' || CASE WHEN h <> '' THEN ' (' || h || ')' ELSE '' END || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY pos) context
FROM (SELECT *, concat_ws(' — ', ti, se, 'актуально для приёма ' || va) h FROM m) GROUP BY query_id"""
)
def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with numbered blocks."""
    return G.numbered_context(_listed(spark, d))


@query(_NUMBERED + """SELECT query_id, string_agg('[Источник: ' || concat_ws(' — ', ti, se, su) || ']' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY pos) context FROM m GROUP BY query_id""")
def attributed_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with named sources."""
    return G.attributed_context(_listed(spark, d))


@query(_NUMBERED + """SELECT query_id, string_agg('[' || number || '] ' || l_url, chr(10) ORDER BY pos) sources FROM (SELECT *, m.metadata.source_url l_url FROM m) WHERE (n = 1 OR k = '') AND starts_with(l_url, 'http') GROUP BY query_id""")
def sources_list(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the sources of each list."""
    return G.sources_list(_listed(spark, d))


@query(
    _NUMBERED
    + """SELECT query_id, string_agg('[' || number || '] ' || CASE WHEN coalesce(starts_with(ad, 'http'), false) THEN '<a href=' || chr(39) || ad || chr(39) || '>' || h || '</a>' ELSE h END, chr(10) ORDER BY pos) sources
FROM (SELECT *, concat_ws(' — ', coalesce(ti, nullif(m.metadata.source, ''), 'Документ'), se) h, coalesce(su, m.metadata.source) ad FROM m) WHERE n = 1 OR k = '' GROUP BY query_id"""
)
def linked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the sources of each list, linked to their addresses."""
    return G.linked_sources(_listed(spark, d))


def _responses(lists: DataFrame) -> DataFrame:
    """Grades of each list as a grader would give them: JSON, for some lists of the wrong length or no JSON."""
    n = lists.groupBy("query_id").agg(F.count("*").alias("n"))
    h = F.length("query_id")
    grades = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.pmod(i * 7 + h, F.lit(3)) % 2)
    text = F.when(h % 7 == 0, "no json").when(h % 7 == 1, '{"scores": [1]}').otherwise(F.to_json(F.struct(grades.alias("scores"))))
    return n.select("query_id", text.alias("response"))


@query(
    f"""WITH l AS (SELECT query_id, id, pos, count(*) OVER (PARTITION BY query_id) n, length(query_id) h FROM {_LISTED} l)
SELECT query_id, id FROM l WHERE h % 7 = 0 OR (h % 7 = 1 AND n <> 1) OR (h % 7 = 1 AND n = 1) OR ((pos * 7 + h) % 3) % 2 = 1"""
)
def grade_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks graded 1; unusable grades keep all."""
    lists = _listed(spark, d)
    return G.graded(lists, _responses(lists)).select("query_id", "id")


@query(
    f"""WITH l AS (SELECT query_id, id, pos, count(*) OVER (PARTITION BY query_id) n, length(query_id) h FROM {_LISTED} l),
s AS (SELECT *, CASE WHEN h % 7 > 1 AND n > 4 THEN ((pos * 7 + h) % 3) % 2 ELSE 0 END g FROM l)
SELECT query_id, id, CAST(r AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, pos) r FROM s) WHERE r <= 4"""
)
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The four chunks of highest score, ties in order."""
    lists = _listed(spark, d)
    return G.reranked_by_scores(lists, _responses(lists), 4).select("query_id", "id", "rank")


@query(
    f"""WITH l AS (SELECT query_id, id, pos, count(*) OVER (PARTITION BY query_id) n FROM {_LISTED} l), r AS (SELECT query_id, id, n - pos + 1 r FROM l WHERE pos % 2 = 0),
k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r) rank FROM r), a AS (SELECT query_id, id, rank FROM k UNION ALL SELECT query_id, id, pos FROM l WHERE query_id NOT IN (SELECT query_id FROM k))
SELECT query_id, id, CAST(rank AS INTEGER) rank FROM a WHERE rank <= 3"""
)
def rerank_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the order of an index list with repeats and indexes out of range."""
    lists = _listed(spark, d)
    own = lists.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    results = own.where("pos % 2 = 0").select("query_id", (F.col("n") - F.col("pos") + 1).alias("ord"), (F.col("pos") - 1).alias("index"))
    odd = own.where("pos = 1").select("query_id", F.lit(0).cast("long").alias("ord"), F.lit(99).alias("index"))
    again = results.withColumn("ord", F.col("ord") + 100)
    return G.reranked_by_index(lists, results.unionByName(odd).unionByName(again), 3).select("query_id", "id", F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH l AS (SELECT query_id, id, pos, coalesce(l.metadata.tags, []) t FROM {_LISTED} l), b AS (SELECT *, len(list_intersect(t, ['admission:documents', 'visa:residence'])) c FROM l),
s AS (SELECT *, 0.5 * (1 + CASE WHEN c > 0 THEN least(c / 2.0, 0.5) ELSE 0 END * 0.3) a FROM b)
SELECT query_id, id, round(a, 6) adjusted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY a DESC, pos) AS INTEGER) rank FROM s"""
)
def tag_boost_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Order by overlap of tags."""
    lists = _listed(spark, d).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("score", F.lit(0.5))
    lists = lists.withColumn("query_tags", F.array(F.lit("admission:documents"), F.lit("visa:residence")))
    return G.tag_reranked(lists).select("query_id", "id", F.round("adjusted", 6).alias("adjusted"), "rank")


_FOOD = "|".join(K.X.FOCUS["food"])
_HOUSE = "|".join(K.X.FOCUS["housing"])


@query(
    f"""WITH l AS (SELECT query_id, id, coalesce(regexp_matches(lower(content), '{_FOOD}'), false) AND NOT (coalesce(regexp_matches(lower(content), '{_HOUSE}'), false) OR coalesce(l.metadata.topic, '') = 'housing') x FROM {_LISTED} l)
SELECT query_id, id FROM (SELECT *, count(*) FILTER (WHERE NOT x) OVER (PARTITION BY query_id) k FROM l) WHERE NOT x OR k = 0"""
)
def guardrail_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions about housing without chunks on food only."""
    return G.guarded(_listed(spark, d).withColumn("focus", F.lit("housing"))).select("query_id", "id")


def _pipeline(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A preset over all questions of feedback; questions and chunks are embedded by the same offline model."""
    from tamarack.plans import pipeline as P
    from tamarack.plans.providers import Offline, embedded, index_of

    model, docs = Offline(), chunks(spark, d).drop("embedding")
    asked = latest_rows(table(spark, d, "feedback"), columns=["question", "tg_id"]).where("question is not null")
    users = latest_rows(table(spark, d, "users"), "tg_id", columns=["country", "target_level"])
    country = F.upper(F.trim("country"))
    users = users.select("tg_id", F.when(F.length(country) == 2, country).alias("country"), F.when(F.lower(F.trim("target_level")).isin("bachelor", "master", "phd"), F.lower(F.trim("target_level"))).alias("level"))
    asked = asked.join(users, "tg_id", "left").select(F.xxhash64("id").alias("query_id"), "question", "country", "level")
    # one entry of the cache for every twentieth question there is
    old = asked.where(F.pmod("query_id", F.lit(EVERY)) == 0).select(F.col("query_id").alias("entry_id"), "question", F.concat_ws(" | ", F.concat(F.lit("country="), "country"), F.concat(F.lit("level="), "level"), "question").alias("key"))
    old = R.newest(old.orderBy("entry_id"), seq="entry_id")
    cache = embedded(old, model, "key", "vector").select("entry_id", "vector", F.col("question").alias("answer"))
    docs = cut(docs.join(index_of(docs, model), "id"))
    state = P.run(P.State(asked, docs, model, cache=cache), P.preset(name))
    return P.results(state)


@query()
def pipeline_default(spark: SparkSession, d: str) -> DataFrame:
    """The default preset."""
    return _pipeline(spark, d, "default")


@query()
def pipeline_fast(spark: SparkSession, d: str) -> DataFrame:
    """The fast preset: four chunks, no tools, no rerank."""
    return _pipeline(spark, d, "fast")


@query()
def pipeline_research(spark: SparkSession, d: str) -> DataFrame:
    """The research preset: sub-questions, imagined documents, eight chunks."""
    return _pipeline(spark, d, "research")
