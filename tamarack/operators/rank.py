"""Ranking and context building over retrieved chunks: rows (query_id, pos, content, metadata...), pos being list order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import text as T

def by_query():
    return Window.partitionBy("query_id")


def graded(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunks graded 1. responses (query_id, response) hold {"scores": [...]}; without a usable list of the right length all stay."""
    scores = F.from_json("response", "scores array<double>")["scores"]
    r = responses.select("query_id", scores.alias("__scores"))
    out = docs.join(r, "query_id", "left").withColumn("__n", F.count("*").over(by_query())).withColumn("__i", F.row_number().over(by_query().orderBy("pos")))
    usable = F.coalesce(F.size("__scores") == F.col("__n"), F.lit(False))
    return out.where(~usable | (F.get("__scores", F.col("__i") - 1).cast("int") == 1)).drop("__scores", "__n", "__i")


def reranked_by_scores(docs: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """The k chunks of highest score, ties in list order; lists of k or fewer, and those without usable scores, keep their order."""
    scores = F.from_json("response", "scores array<double>")["scores"]
    r = responses.select("query_id", scores.alias("__scores"))
    out = docs.join(r, "query_id", "left").withColumn("__n", F.count("*").over(by_query())).withColumn("__i", F.row_number().over(by_query().orderBy("pos")))
    usable = F.coalesce((F.size("__scores") == F.col("__n")) & (F.col("__n") > k), F.lit(False))
    key = F.when(usable, F.get("__scores", F.col("__i") - 1)).otherwise(0.0)
    out = out.withColumn("rank", F.row_number().over(by_query().orderBy(key.desc(), "pos")))
    return out.where(F.col("rank") <= k).drop("__scores", "__n", "__i")


def reranked_by_index(docs: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Chunks in the order of (query_id, ord, index) results; indexes null, out of range or met before are passed over; else the first k."""
    own = docs.withColumn("__i", F.row_number().over(by_query().orderBy("pos")) - 1)
    picks = results.where(F.col("index").isNotNull()).join(own.select("query_id", F.col("__i").alias("index")), ["query_id", "index"], "left_semi")
    picks = picks.groupBy("query_id", "index").agg(F.min("ord").alias("__ord"))
    picks = picks.withColumn("__r", F.row_number().over(by_query().orderBy("__ord"))).where(F.col("__r") <= k).select("query_id", F.col("index").alias("__i"), "__r")
    out = own.join(picks, ["query_id", "__i"], "left").withColumn("__any", F.count("__r").over(by_query()))
    rank = F.when(F.col("__any") > 0, F.col("__r")).otherwise(F.when(F.col("__i") < k, F.col("__i") + 1))
    return out.withColumn("rank", rank).where("rank is not null").drop("__i", "__r", "__any")


def tag_reranked(docs: DataFrame, factor: float = 0.3, score: str = "score", tags: str = "tags", query_tags: str = "query_tags") -> DataFrame:
    """Scores raised by the overlap of tags, highest first, ties in list order."""
    boost = K.tag_boost(F.col(tags), F.col(query_tags))
    adjusted = F.col(score) * (F.lit(1.0) + (boost - F.lit(1.0)) * F.lit(factor))
    return docs.withColumn("adjusted", adjusted).withColumn("rank", F.row_number().over(by_query().orderBy(F.col("adjusted").desc(), "pos")))


def food_only(content: Column) -> Column:
    """Whether a text speaks of food and not of housing."""
    return K.bound(F.lower(F.coalesce(content, F.lit(""))), lambda low: K.contains_any(low, K.X.FOCUS["food"]) & ~K.contains_any(low, K.X.FOCUS["housing"]))


def guarded(docs: DataFrame, focus: str = "focus", content: str = "content", topic: str = "topic", food: str | None = None) -> DataFrame:
    """For questions about housing without chunks that speak of food only (known from column food, if given); if none were left all stay."""
    drop = (F.col(focus) == "housing") & (F.col(food) if food else food_only(F.col(content))) & (F.coalesce(F.col(topic), F.lit("")) != "housing")
    out = docs.withColumn("__drop", F.coalesce(drop, F.lit(False)))
    left = F.count_if(~F.col("__drop")).over(by_query())
    return out.withColumn("__left", left).where(~F.col("__drop") | (F.col("__left") == 0)).drop("__drop", "__left")


def source_key(source_url: Column, source: Column) -> Column:
    return F.coalesce(T.missing(source_url), T.missing(source), F.lit(""))


def numbered_sources(docs: DataFrame, source_url: str = "source_url", source: str = "source") -> DataFrame:
    """Chunks with the number of their source: 1, 2, ... by first sight; chunks without a source share the last number given to one."""
    out = docs.withColumn("__key", source_key(F.col(source_url), F.col(source)))
    by_key = Window.partitionBy("query_id", "__key")
    new = F.when((F.col("__key") == "") | (F.row_number().over(by_key.orderBy("pos")) == 1), 1).otherwise(0)
    out = out.withColumn("__new", new).withColumn("__no", F.sum("__new").over(by_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.when(F.col("__key") == "", F.max("__no").over(by_key)).otherwise(F.min(F.when(F.col("__new") == 1, F.col("__no"))).over(by_key))
    return out.withColumn("number", number).withColumn("is_first", F.col("__new") == 1).drop("__key", "__new", "__no")


def numbered_context(docs: DataFrame) -> DataFrame:
    """(query_id, context): '[n] (title — section — valid)' and content of each chunk, in list order."""
    valid = F.when(F.length("valid_for") > 0, F.concat(F.lit("актуально для приёма "), F.col("valid_for")))
    head = F.concat_ws(" — ", T.missing(F.col("title")), T.missing(F.col("section_path")), valid)
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"), F.when(head != "", F.concat(F.lit(" ("), head, F.lit(")"))).otherwise(""), F.lit("\n"), F.coalesce(F.col("content"), F.lit("")))
    return joined(numbered_sources(docs).withColumn("__block", block), "__block", "context", "\n\n")


def attributed_context(docs: DataFrame) -> DataFrame:
    """(query_id, context): each chunk under '[Источник: title — section — url]'."""
    head = F.concat_ws(" — ", T.missing(F.col("title")), T.missing(F.col("section_path")), T.missing(F.col("source_url")))
    return joined(docs.withColumn("__block", F.concat(F.lit("[Источник: "), head, F.lit("]\n"), F.coalesce(F.col("content"), F.lit("")))), "__block", "context", "\n\n")


def joined(rows: DataFrame, column: str, out: str, separator: str, key: str = "query_id", pos: str = "pos") -> DataFrame:
    """Texts of a key in list order as one; lists are the k chunks of a query, so they are short."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(column).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias(out))


def sources_list(docs: DataFrame) -> DataFrame:
    """(query_id, sources): one line '[i] address' per source that is a web address."""
    own = numbered_sources(docs).where(F.col("is_first") & F.col("source_url").startswith("http"))
    return joined(own.withColumn("__line", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("source_url"))), "__line", "sources", "\n")


def linked_sources(docs: DataFrame) -> DataFrame:
    """(query_id, sources): one line '[i] title — section' per source, as a link where its address is one of the web."""
    own = numbered_sources(docs).where("is_first")
    title = F.concat_ws(" — ", F.coalesce(T.missing(F.col("title")), T.missing(F.col("source")), F.lit("Документ")), T.missing(F.col("section_path")))
    address = F.coalesce(T.missing(F.col("source_url")), F.col("source"))
    shown = F.when(address.startswith("http"), F.concat(F.lit("<a href='"), address, F.lit("'>"), title, F.lit("</a>"))).otherwise(title)
    return joined(own.withColumn("__line", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), shown)), "__line", "sources", "\n")


def cited_only(lines: DataFrame, answers: DataFrame, number: str = "number", answer: str = "answer") -> DataFrame:
    """Source lines whose number the answer cites; answers that cite none keep all."""
    cited = answers.select("query_id", T.cited_numbers(F.col(answer)).alias("__cited"))
    out = lines.join(cited, "query_id", "left")
    hit = F.coalesce(F.array_contains("__cited", F.col(number).cast("int")), F.lit(False))
    return out.withColumn("__hit", hit).withColumn("__any", F.max("__hit").over(by_query())).where(F.col("__hit") | ~F.col("__any")).drop("__cited", "__hit", "__any")


def category_check(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, topic, is_valid): the answer's topic must be a type of its chunks, or one of them general; no chunks is valid."""
    types = docs.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))
    out = answers.join(types, "query_id", "left").withColumn("topic", K.topic(F.col("answer")))
    ok = F.col("types").isNull() | F.col("topic").isNull() | F.array_contains("types", F.col("topic")) | F.array_contains("types", "general")
    return out.withColumn("is_valid", ok)
