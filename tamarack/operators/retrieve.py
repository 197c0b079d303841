"""Retrieval: filters, vector and lexical distance, boosts, top-k for one query or a stated set of queries.

A set of queries goes to the scan in blocks of at most MAX_QUERIES, and the chunk table is read once a block. Scores are
computed per Arrow batch by matrix products, each batch passes on its k best per query, and a window over what is left
(k rows per query and batch) finds the result. Nothing is joined pairwise, and copies of a chunk count once without being gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import vectors as V

# Weights of the hybrid score and boosts.
VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
FACT_BOOST = 0.3
HOUSING_BOOST, FOOD_BOOST = -0.18, -0.15
FOOD_TOPICS = ("student-budget", "food")
#: So many queries go to one scan of the chunks; more are answered in several.
MAX_QUERIES = 20_000
#: Words, as terms of a question are cut.
WORDS = r"[\p{L}\p{N}]+"


def in_scope(scope: Column, country: str | None) -> Column:
    """Chunks for everyone or for the country; without a country all."""
    if not country or country.upper() == "ALL":
        return F.lit(True)
    return F.array_contains(scope, "ALL") | F.array_contains(scope, country)


def level_key(levels: Column, level: str | None) -> Column:
    """0 for chunks of the level, 1 for others: sorts before the score."""
    return F.lit(0) if not level else F.when(F.array_contains(levels, level), 0).otherwise(1)


def fact_boost(is_fact: Column, fact_weight: Column, narrative_weight: Column) -> Column:
    return F.when(F.coalesce(is_fact, F.lit(False)), -fact_weight * FACT_BOOST).otherwise(-narrative_weight * FACT_BOOST)


def focus_boost(focus: Column, entity_type: Column, topic: Column) -> Column:
    housing = (entity_type == "housing") | (topic == "housing")
    food = (entity_type == "food") | topic.isin(*FOOD_TOPICS)
    return F.when((focus == "housing") & F.coalesce(housing, F.lit(False)), HOUSING_BOOST).when((focus == "food") & F.coalesce(food, F.lit(False)), FOOD_BOOST).otherwise(0.0)


def lexical_distance(text: Column, terms: Column) -> Column:
    """1 - share of the query's terms among the words of text; exactly 1 without a match."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    return F.when(F.size(terms) > 0, F.lit(1.0) - F.size(F.array_intersect(terms, words)) / F.size(F.array_distinct(terms))).otherwise(1.0)


def lexical_distance_to(text: Column, terms: Sequence[str]) -> Column:
    """lexical_distance for terms that are known: plain searches, and a look at the edges of what they find, instead of all words."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(1.0)
    word = lambda low, t: F.contains(low, F.lit(t)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E(?![\p{{L}}\p{{N}}])")
    hits = lambda low: reduce(lambda a, b: a + b, [word(low, t).cast("int") for t in terms])
    return F.lit(1.0) - K.bound(F.lower(F.coalesce(text, F.lit(""))), hits) / F.lit(len(terms))


def query_terms(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(WORDS), F.lit(0)))


def hybrid_score(vector_distance: Column, text_distance: Column, *boosts: Column) -> Column:
    out = F.lit(VECTOR_WEIGHT) * vector_distance + F.lit(TEXT_WEIGHT) * F.coalesce(text_distance, F.lit(1.0))
    for b in boosts:
        out = out + b
    return out


def covers(places: Sequence[int], terms: Sequence[int], n: int) -> float:
    """Cover density of n terms: each shortest stretch with all of them adds a tenth, divided by one more than its other words.

    places: positions of the terms in a text, in order, and which term stands there.
    """
    rank, left, count, missing = 0.0, 0, [0] * n, n
    for right, t in enumerate(terms):
        missing -= not count[t]
        count[t] += 1
        if missing:
            continue
        while count[terms[left]] > 1:
            count[terms[left]] -= 1
            left += 1
        rank += 0.1 / (1 + (places[right] - places[left]) - (right - left))
        count[terms[left]] -= 1
        left += 1
        missing = 1
    return rank


def cover_density(text: str | None, terms: Sequence[str]) -> float:
    """covers of one text."""
    at = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    found = [(i, at[w]) for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())) if w in at]
    return covers([i for i, _ in found], [t for _, t in found], len(at)) if at else 0.0


def cover_rank(text: Column, terms: Sequence[str]) -> Column:
    """cover_density as a column: only texts with all terms have their words counted out, and only the terms' places meet Python."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(0.0)

    def ranks(places: pd.Series) -> pd.Series:
        return places.map(lambda x: None if x is None else covers([p["i"] for p in x], [p["t"] for p in x], len(terms)))

    low = F.lower(F.coalesce(text, F.lit("")))
    number = lambda w: F.array_position(F.array(*[F.lit(t) for t in terms]), w).cast("int") - 1
    words = F.transform(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), lambda w, i: F.struct(i.alias("i"), number(w).alias("t")))
    every = reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in terms])
    found = F.pandas_udf(ranks, "double")(F.when(every, F.filter(words, lambda p: p["t"] >= 0)))
    return F.coalesce(found, F.lit(0.0))


def top_k(chunks: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", score: Column | None = None, first: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k best chunks of one query; score defaults to the cosine distance; nulls last, ties by id.

    Rows that repeat a chunk count once: they are collapsed as ids and scores, before contents are looked at.
    """
    q = F.lit(None).cast("array<double>") if query is None else F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("distance", V.cosine_distance(F.col(vector), q))
    scored = scored.withColumn("score", score if score is not None else F.col("distance"))
    scored = scored.select(id_col, "distance", "score", (first if first is not None else F.lit(0)).alias("__first"), *keep).distinct()
    return scored.orderBy(F.col("__first").asc_nulls_last(), F.col("score").asc_nulls_last(), F.col(id_col).asc()).limit(k).select(id_col, "distance", "score", *keep)


def ranked(rows: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank."""
    w = Window.partitionBy(query_id).orderBy(F.col(score).asc_nulls_last(), F.col(id_col).asc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_blocks(queries: DataFrame, query_id: str, most: int) -> list[DataFrame]:
    """Queries in blocks of at most so many by their ids, which are unique; eight bytes a query reach the driver."""
    ids = np.sort(np.asarray([r[0] for r in queries.select(F.col(query_id).cast("long")).collect()], dtype=np.int64))
    bounds = [(int(ids[a]), int(ids[min(a + most, len(ids)) - 1])) for a in range(0, len(ids), most)]
    return [queries] if len(bounds) < 2 else [queries.where(F.col(query_id).between(a, b)) for a, b in bounds]


def top_k_batched(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", dims: int = 64, boost: str | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k chunks of smallest cosine distance (plus the chunk's boost) of each query.

    Vectors of another length, null, all zero or with a number that isn't finite have no distance and don't come out.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("query_vector"))
    more = (F.col(boost).cast("double") if boost else F.lit(0.0)).alias("boost")
    base = chunks.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("embedding"), more)
    return hybrid_top_k(base, asked, k, dims=dims, max_queries=max_queries, weights=(1.0, 0.0)).drop("text_distance")


#: What hybrid_top_k may be told of a query beside its vector, and of a chunk.
OF_QUERY = {"terms": "array<string>", "country": "string", "level": "string", "fact_weight": "double", "narrative_weight": "double", "focus": "string"}
OF_CHUNK = {"content": "string", "country_scope": "array<string>", "level": "array<string>", "is_yaml_fact": "boolean", "entity_type": "string", "topic": "string", "boost": "double"}


class _Asked:
    """A block of queries as arrays."""

    def __init__(self, rows: list, dims: int):
        vectors = np.asarray([r["query_vector"] for r in rows], dtype=np.float64).reshape(len(rows), dims)
        self.ids = np.asarray([r["query_id"] for r in rows], dtype=np.int64)
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(rows) else vectors
        self.terms = [list(dict.fromkeys(r["terms"] or ())) for r in rows]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.terms for w in t))}
        self.countries, self.country = self._numbered([r["country"] if r["country"] and r["country"].upper() != "ALL" else None for r in rows])
        self.levels, self.level = self._numbered([r["level"] or None for r in rows])
        self.fact, self.narrative = (np.asarray([r[c] or 0.0 for r in rows], dtype=np.float64) for c in ("fact_weight", "narrative_weight"))
        self.focus = np.asarray([{"housing": 1, "food": 2}.get(r["focus"], 0) for r in rows], dtype=np.int64)

    def asks(self, a: int, z: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries from a to z: how many terms they have, each term's place among these, terms by queries, and terms a query.

        Only a stretch's own terms become a matrix, so its size doesn't grow with the block's vocabulary.
        """
        used = list(dict.fromkeys(w for t in self.terms[a:z] for w in t))
        at = {w: i for i, w in enumerate(used)}
        place = np.full(len(self.vocabulary), -1)
        place[[self.vocabulary[w] for w in used]] = np.arange(len(used))
        asks = np.zeros((len(used), z - a), np.float32)
        for j, t in enumerate(self.terms[a:z]):
            asks[[at[w] for w in t], j] = 1.0
        return len(used), place, asks, np.maximum(1.0, asks.sum(axis=0, dtype=np.float64))

    @staticmethod
    def _numbered(values: list) -> tuple[list, np.ndarray]:
        """Different values and the number of each query's; -1 for none."""
        known = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
        return list(known), np.asarray([known.get(v, -1) for v in values], dtype=np.int64)

    def holds(self, known: list, column: list) -> np.ndarray:
        """Rows by known values: whether a row's list has the value; a last column of True for queries without one."""
        at = {v: i for i, v in enumerate(known)}
        out = np.zeros((len(column), len(known) + 1), bool)
        out[:, -1] = True
        for r, values in enumerate(column):
            for v in values or ():
                if v in at:
                    out[r, at[v]] = True
        return out


def hybrid_top_k(chunks: DataFrame, queries: DataFrame, k: int, dims: int = 64, max_queries: int = MAX_QUERIES, weights: tuple[float, float] = (VECTOR_WEIGHT, TEXT_WEIGHT)) -> DataFrame:
    """(query_id, id, score, text_distance, rank): for each query the k best chunks in its scope.

    Chunks of the query's level come first, then the smaller score: weighted vector and lexical distance (one minus the share of the
    query's terms that the content has), minus the weight of facts or narratives, plus the boosts of the query's focus and of the
    chunk; ties to the smaller id. Queries are (query_id, query_vector) and any of OF_QUERY, chunks (id, embedding) and any of
    OF_CHUNK; what is missing or null plays no part. Vectors that aren't usable take no part on either side. Rows with the same id
    count once.
    """
    column = lambda rows, name, kind: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
    queries = queries.where(V.usable(F.col("query_vector"), dims)).select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>"), *[column(queries, c, t) for c, t in OF_QUERY.items()])
    base = chunks.where(V.usable(F.col("embedding"), dims)).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"), *[column(chunks, c, t) for c, t in OF_CHUNK.items()])
    lexical = weights[1] != 0 and "terms" in queries.columns
    found = [base.mapInArrow(_best_of(base, block.collect(), k, dims, weights, lexical), _FOUND) for block in in_blocks(queries, "query_id", max_queries)]
    every = reduce(DataFrame.unionAll, found).groupBy("query_id", "id").agg(F.min("later").alias("later"), F.min("score").alias("score"), F.min("text_distance").alias("text_distance"))
    w = Window.partitionBy("query_id").orderBy("later", "score", "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("later")


_FOUND = "query_id long, id long, later byte, score double, text_distance double"


def _best_of(base: DataFrame, rows: list, k: int, dims: int, weights: tuple[float, float], lexical: bool):
    sent = base.sparkSession.sparkContext.broadcast(_Asked(rows, dims))
    fields = base.columns
    food_topics = set(FOOD_TOPICS)

    def words_of(texts: list, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and terms of the terms that texts have."""
        import regex

        find = regex.compile(WORDS).findall
        at = [sorted({i for w in set(find(t.lower())) if (i := known.get(w)) is not None}) if t else [] for t in texts]
        return np.repeat(np.arange(len(at)), [len(x) for x in at]), np.fromiter((i for x in at for i in x), np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows if len(q.ids) else 0, 2048):
                b = whole.slice(s, 2048)
                _, once = np.unique(b.column(0).to_numpy(), return_index=True)
                b = b.take(pa.array(once))
                c = {f: b.column(i) for i, f in enumerate(fields)}
                ids = c["id"].to_numpy()
                x = np.asarray(c["embedding"].flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), dims)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                flags = lambda name, test: np.fromiter((test(v) for v in c[name].to_pylist()), bool, len(ids))
                fact = flags("is_yaml_fact", bool)
                kind, topic = c["entity_type"].to_pylist(), c["topic"].to_pylist()
                housing = np.fromiter((e == "housing" or t == "housing" for e, t in zip(kind, topic)), bool, len(ids))
                food = np.fromiter((e == "food" or t in food_topics for e, t in zip(kind, topic)), bool, len(ids))
                boost = np.nan_to_num(c["boost"].to_numpy(zero_copy_only=False).astype(np.float64))
                scope = q.holds(q.countries, c["country_scope"].to_pylist())
                scope |= flags("country_scope", lambda v: bool(v) and "ALL" in v)[:, None]
                level = q.holds(q.levels, c["level"].to_pylist())
                row_of, term_of = words_of(c["content"].to_pylist(), q.vocabulary) if lexical else (None, None)
                for a in range(0, len(q.ids), 256):
                    z = min(a + 256, len(q.ids))
                    far = 1.0 - x @ q.vectors[a:z].T
                    text = np.ones(far.shape)
                    if lexical:
                        used, place, asks, number = q.asks(a, z)
                        local = place[term_of]
                        has = np.zeros((len(ids), used), np.float32)
                        has[row_of[local >= 0], local[local >= 0]] = 1.0
                        text = 1.0 - (has @ asks) / number[None]
                    score = weights[0] * far + weights[1] * text
                    score = score - FACT_BOOST * np.where(fact[:, None], q.fact[None, a:z], q.narrative[None, a:z])
                    score = score + np.where(housing[:, None] & (q.focus[None, a:z] == 1), HOUSING_BOOST, 0.0) + np.where(food[:, None] & (q.focus[None, a:z] == 2), FOOD_BOOST, 0.0)
                    score = np.round(score + boost[:, None], 9)
                    later = ~level[:, q.level[a:z]]
                    order = np.where(scope[:, q.country[a:z]], score + 1e6 * later, np.inf).T
                    m = min(k, len(ids))
                    kth = np.partition(order, m - 1, axis=1)[:, m - 1]
                    j, r = np.nonzero((order <= kth[:, None]) & np.isfinite(order))
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[a + j]), pa.array(ids[r]), pa.array(later[r, j].astype(np.int8)), pa.array(score[r, j]), pa.array(text[r, j])], names=["query_id", "id", "later", "score", "text_distance"])

    return best


def merged_subqueries(found: DataFrame, k: int, query_id: str = "query_id", sub: str = "sub", rank: str = "rank", content: str = "content") -> DataFrame:
    """Results of sub-queries in their order, first of those alike in their first 200 characters, cut to k."""
    key = F.substring(F.col(content), 1, 200)
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy(query_id, key).orderBy(sub, rank))).where("__n = 1").drop("__n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy(sub, rank))).where(F.col("position") <= k)


def per_subquery_k(k: int, n: int) -> int:
    return max(3, k // max(1, n) + 1)


def cache_lookup(queries: DataFrame, entries: DataFrame, threshold: float = 0.97, dims: int = 64) -> DataFrame:
    """(query_id, entry_id, similarity): the entry nearest to each query if it reaches the threshold; ties to the older entry.

    entries: the cache (entry_id in order of age, vector), bounded by its own size limit, is the batch side of the search.
    """
    found = top_k_batched(entries, queries, 1, id_col="entry_id", vector="vector", dims=dims)
    return found.select("query_id", F.col("id").alias("entry_id"), F.round(F.lit(1.0) - F.col("score"), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def newest(entries: DataFrame, size: int = 128, seq: str = "seq") -> DataFrame:
    """What a first-in first-out cache of this size holds."""
    return entries.orderBy(F.col(seq).desc()).limit(size)
