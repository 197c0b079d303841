"""Dashboards, reports and evaluations, aggregated before the exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text as T


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(0.0)


def exact_percentiles(rows: DataFrame, value: Column, p: float, keys: Sequence[str] = (), most: int = 20_000) -> DataFrame:
    """(keys, n, percentile): interpolated percentile of all values of each group, for groups of any size; groups must be few.

    Counts and a bracket per group come from one aggregate with an approximate percentile, which combines before the exchange. What lies
    below and within the brackets is counted, and only the values within (one in 250 or so; all of a group of at most most values)
    reach the driver. A bracket that missed or that is wide (more than most values, as with ties) is narrowed by further aggregates. The built-in exact percentile would keep every
    distinct value of a group in one task.
    """
    keys, spark = list(keys), rows.sparkSession
    v = rows.select(*keys, value.cast("double").alias("v")).where("v is not null").persist()
    try:
        spread = F.percentile_approx("v", [max(0.0, p - 0.002), min(1.0, p + 0.002)], 10_000)
        groups = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("top"), spread.alias("b")).where("n > 0").collect()
        group = F.lit(0) if not keys else F.coalesce(*[F.when(F.forall(F.array(*[F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]), lambda x: x), F.lit(i)) for i, r in enumerate(groups)]) if groups else F.lit(None)
        brackets = [(r["least"], r["top"]) if r["n"] <= most else tuple(r["b"]) for r in groups]  # of a small group all values are taken
        low, high = (F.get(F.array(*[F.lit(float(b[j])) for b in brackets]), F.col("g")) for j in (0, 1)) if groups else (F.lit(0.0), F.lit(0.0))
        placed = v.select(group.cast("int").alias("g"), "v").select("g", "v", (F.col("v") < low).alias("under"), F.col("v").between(low, high).alias("within"))
        counts = {i: (0, r["n"]) for i, r in enumerate(groups)}
        if any(r["n"] > most for r in groups):
            counts = {r["g"]: (r["under"], r["within"]) for r in placed.groupBy("g").agg(F.count_if("under").alias("under"), F.count_if("within").alias("within")).collect()}
        at = [(p * (r["n"] - 1), int(p * (r["n"] - 1))) for r in groups]
        small = [i for i, r in enumerate(groups) if counts[i][1] <= most and counts[i][0] <= at[i][1] and min(at[i][1] + 1, r["n"] - 1) < sum(counts[i])]
        values: dict[int, list[float]] = {i: [] for i in small}
        if small:
            for r in placed.where(F.col("within") & F.col("g").isin(small)).select("g", "v").collect():
                values[r["g"]].append(r["v"])
        found = []
        for i, r in enumerate(groups):
            (exact, k), inside = at[i], sorted(values.get(i, ()))
            if i in values:
                a, b = inside[k - counts[i][0]], inside[min(k + 1, r["n"] - 1) - counts[i][0]]
                result = a + (b - a) * (exact - k)
            else:
                result = _percentile(v.select(group.alias("g"), "v").where(F.col("g") == i).select("v"), r["n"], p, r["least"], r["top"], brackets[i], most)
            found.append((*(r[key] for key in keys), r["n"], result))
    finally:
        v.unpersist()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "n long", "percentile double"])
    return spark.createDataFrame(found, schema)


def _percentile(v: DataFrame, n: int, p: float, least: float, top: float, bracket: Sequence[float], most: int) -> float:
    at = p * (n - 1)
    k = int(at)
    last = min(k + 1, n - 1)
    low, high = bracket
    outer = (least, top)
    while True:
        under, within = v.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not (under <= k and last < under + within):  # the approximate bracket missed: widen it on the side it missed
            low, high = (outer[0] if under > k else low), (outer[1] if last >= under + within else high)
            continue
        if low == high:
            return low
        part = v.where(F.col("v").between(low, high))
        if within <= most:
            found = sorted(r[0] for r in part.collect())
            return found[k - under] + (found[last - under] - found[k - under]) * (at - k)
        outer = (low, high)
        # values that many rows share count once; of the different ones the middle parts the bracket
        middle = part.select("v").agg(F.percentile_approx("v", (k - under) / within, 10_000)).first()[0]
        below, equal = v.agg(F.count_if(F.col("v") < middle), F.count_if(F.col("v") == middle)).first()
        if below <= k and last < below + equal:
            return middle
        if below <= k < below + equal:  # k is the middle value itself, the next one lies above it
            above = v.where(F.col("v") > middle).agg(F.min("v")).first()[0]
            return middle + (above - middle) * (at - k)
        before, after = part.agg(F.max(F.when(F.col("v") < middle, F.col("v"))), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
        if last < below:
            high = before
        elif k >= below + equal:
            low = after
        else:  # k lies just below the middle value
            return before + (middle - before) * (at - k)


def dashboard(logs: DataFrame, since: Column) -> DataFrame:
    """Queries, hit rate, mean and 95th percentile of the total time, mean chunks kept, of the window; zeros for an empty one."""
    ok = F.col("t_total").isNotNull() & (F.col("t_total") >= 0)
    hit = F.coalesce("cache_hit", F.lit(False))
    recent = logs.where(F.col("created_at") >= since).select(hit.alias("hit"), F.when(ok, F.col("t_total")).alias("t"), F.when(~hit, F.col("docs_after_grading")).alias("docs")).persist()
    try:
        found = exact_percentiles(recent, F.col("t"), 0.95).collect()
        a = recent.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.avg("t").alias("t"), F.avg("docs").alias("docs")).collect()
    finally:
        recent.unpersist()
    a = logs.sparkSession.createDataFrame([(*a[0], found[0]["percentile"] if found else None)], "queries long, hits long, t double, docs double, p95 double")
    zero = lambda c, d: F.coalesce(F.bround(F.col(c), d), F.lit(0.0))
    return a.select("queries", "hits", share(F.col("hits"), F.col("queries")).alias("cache_hit_rate"), zero("t", 2).alias("avg_time"), zero("p95", 2).alias("p95_time"), zero("docs", 1).alias("avg_docs"))


def user_counts(users: DataFrame, since: Column) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"), F.count_if(F.col("last_active") >= since).alias("active_users"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Positive, negative, total and the share of positive in whole per cent, '-' without votes."""
    a = feedback.agg(F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))
    total = F.col("positive") + F.col("negative")
    return a.select("positive", "negative", total.alias("total"), F.when(total > 0, F.concat(F.bround(F.lit(100.0) * F.col("positive") / total, 0).cast("int").cast("string"), F.lit("%"))).otherwise("-").alias("satisfaction"))


def latency_by(logs: DataFrame, *keys: str) -> DataFrame:
    """Exact 95th percentiles of the total time per group."""
    return exact_percentiles(logs.where("t_total >= 0"), F.col("t_total"), 0.95, keys).withColumnRenamed("percentile", "p95")


def _minute(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))


def report(logs: DataFrame, since: Column) -> DataFrame:
    """Log rows of the window, formatted for a sheet."""
    return logs.where(F.col("created_at") >= since).select(
        "id",
        _minute("created_at").alias("created"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.when(F.coalesce("cache_hit", F.lit(False)), "yes").otherwise("no").alias("cached"),
        F.coalesce(F.array_join("sources", ", "), F.lit("")).alias("sources"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def user_sheet(users: DataFrame) -> DataFrame:
    """All users, with times as text."""
    return users.select("tg_id", "country", "target_level", "german_level", "english_level", _minute("created_at").alias("created"), _minute("last_active").alias("active"))


def feedback_sheet(feedback: DataFrame, since: Column) -> DataFrame:
    """Votes of the window; what isn't a vote for is one against."""
    return feedback.where(F.col("created_at") >= since).select("id", "tg_id", F.when(F.col("rating") == 1, "👍").otherwise("👎").alias("vote"), "question", "answer", _minute("created_at").alias("created"))


def routing_stats(routed: DataFrame, known: list[str], intent: str = "intent") -> DataFrame:
    """Count and percentage per known intent; other intents count in the total only."""
    by = routed.groupBy(intent).count()
    total = F.sum("count").over(Window.partitionBy())
    return by.withColumn("percent", F.bround(F.lit(100.0) * F.col("count") / total, 1)).where(F.col(intent).isin(known)).select(F.col(intent).alias("intent"), F.col("count").alias("n"), "percent")


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of keywords in the text without case; 1 without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords)).otherwise(1.0)


def unsupported_urls(answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(T.urls(answer), T.urls(context)))


def evaluation(results: DataFrame, *measures: str) -> DataFrame:
    """Means over rows without error: all, by difficulty, by topic, in one pass, with the rows that failed.

    measures are averaged to three digits, beside the latency to two and, where there is a column has_unsupported_urls, the share of
    answers that name addresses their sources don't.
    """
    measures = measures or ("recall",)
    ok = F.col("error").isNull()
    cited = F.when(F.coalesce("has_unsupported_urls", F.lit(False)), 1.0).otherwise(0.0) if "has_unsupported_urls" in results.columns else None
    found = [F.bround(F.avg(F.when(ok, F.col(m))), 3).alias(m) for m in measures]
    found += [F.bround(F.avg(F.when(ok, F.col("latency"))), 2).alias("latency")]
    found += [] if cited is None else [F.bround(F.avg(F.when(ok, cited)), 3).alias("hallucination_rate")]
    return results.groupingSets([["difficulty"], ["topic"], []], "difficulty", "topic").agg(F.grouping_id().alias("level"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("n_failed"), *found)


def fact_share(found: DataFrame, key: str = "query_id", is_fact: str = "is_yaml_fact") -> DataFrame:
    return found.groupBy(key).agg(F.count_if(F.coalesce(is_fact, F.lit(False))).alias("facts"), F.count_if(~F.coalesce(is_fact, F.lit(False))).alias("narratives"))


def grouped_entities(entities: DataFrame, key: str = "tg_id") -> DataFrame:
    """(key, entity_type, values): sorted distinct values."""
    return entities.groupBy(key, "entity_type").agg(F.array_sort(F.collect_set("entity_value")).alias("values"))


def days_until(target: Column, now: Column) -> Column:
    """struct(days, bucket): whole days from now, rounded down, and what that means."""
    days = F.floor((F.unix_micros(target) - F.unix_micros(now)) / F.lit(86_400_000_000)).cast("int")
    bucket = F.when(days < 0, "expired").when(days == 0, "today").when(days <= 7, "urgent").when(days <= 30, "soon").otherwise("ok")
    return F.struct(days.alias("days"), F.when(days.isNotNull(), bucket).otherwise("error").alias("bucket"))
