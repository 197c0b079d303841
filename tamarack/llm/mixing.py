"""Mixing sources to target weights by Poisson replication.

Every document is used a number of times drawn from a Poisson distribution whose mean is its source's repetition rate. The
draw inverts the distribution at a uniform number hashed from seed and document id, so it needs no state, is the same in
every run and on every cluster, and is a scan-side expression: a table of cumulative probabilities per source (one row per
target, as many entries as max_repeats) is broadcast, its size being that of the targets table.

Rates. With S tokens in a source, weight w (relative), cap c and a budget of T tokens the rate is T*w/S. The default budget is
the largest T at which no source needs more than its cap, T = min(S*c/w), so that all shares are met; a larger budget
(total_tokens) makes sources at their cap fall short, and the rest is spread over the others by weight. As counts are cut
off at the cap, the Poisson mean is adjusted until the tokens actually drawn are the wanted ones (bisection on the driver over
BUCKETS token sums per target source, a size that doesn't grow with the documents).

Defined results: targets with null, zero or negative weight and sources without tokens take no part and are reported with
share 0; a null cap counts as 1; duplicate targets of a source are summed by weight and take the largest cap; documents of
sources without a target, or with a null source, are not used; null and empty texts have no tokens, so they are never
repeated (rate applies, size 0): they are left out. With no usable target the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.tokenize import count_tokens

#: Tokens of a source are summed in so many classes of the documents' uniform numbers.
BUCKETS = 2048

PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("max_repeats", T.IntegerType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("cdf", T.ArrayType(T.DoubleType())),
    ]
)


def uniform(key: str, seed: int):
    """Number in (0, 1) hashed from seed and key."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def cut_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    return float(np.sum(1.0 - poisson_cdf(lam, cap)))


def poisson_cdf(lam: float, cap: int) -> np.ndarray:
    """P(count <= k) for k < cap, summed from logarithms, so that no mean is too large."""
    if lam <= 0:
        return np.ones(cap)
    k = np.arange(cap)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(cap, 1))))))[:cap]
    return np.minimum(1.0, np.cumsum(np.exp(k * math.log(lam) - lam - log_factorial)))


def cut_cdf(rate: float, cap: int, tokens: np.ndarray | None = None) -> list[float]:
    """P(count <= k) for k < cap of the Poisson distribution, cut at cap, that has this mean.

    tokens: the source's tokens by bucket of the documents' uniform numbers. With it the mean is the one over these documents,
    so that small sources meet their share as well as large ones.
    """
    if rate >= cap * (1 - 1e-9):
        return [0.0] * cap
    if tokens is None or not tokens.sum():
        mean = lambda lam: cut_mean(lam, cap)
    else:
        middle = (np.arange(len(tokens)) + 0.5) / len(tokens)
        mean = lambda lam: float(np.searchsorted(poisson_cdf(lam, cap), middle, side="left") @ tokens / tokens.sum())
    low, high = 0.0, max(1.0, 2.0 * cap)
    while mean(high) < rate:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return poisson_cdf((low + high) / 2, cap).tolist()


def rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Repetition rate of each usable source; see the module."""
    live = {s: (w, c) for s, (w, c) in targets.items() if w > 0 and c > 0 and sizes.get(s, 0) > 0}
    if not live:
        return {}
    if total_tokens is None:
        total = sum(w for w, _ in live.values())
        total_tokens = min(sizes[s] * c / (w / total) for s, (w, c) in live.items())
    out: dict[str, float] = {}
    budget, free = float(total_tokens), dict(live)
    while free:
        weight = sum(w for w, _ in free.values())
        over = [s for s, (w, c) in free.items() if budget * w / weight > sizes[s] * c * (1 + 1e-12)]
        if not over:
            out |= {s: min(float(c), budget * w / weight / sizes[s]) for s, (w, c) in free.items()}
            break
        for s in over:
            out[s] = float(free[s][1])
            budget -= sizes[s] * free.pop(s)[1]
    return out


def of_targets(docs: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Documents whose source is listed: no others are ever used or reported, so their tokens needn't be counted."""
    wanted = targets.where("source is not null").select(F.col("source").alias(source)).distinct()
    return docs.join(F.broadcast(wanted), source, "left_semi")


def token_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", path: str | None = None) -> DataFrame:
    """Narrow table (id, source, n_tokens), the one pass over the texts that counts tokens."""
    return count_tokens(docs, text, keep=(doc_id, source), out="n_tokens", path=path)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """One row per target source with its rate and cut-off distribution. targets must fit the driver: one row per source."""
    spark = targets.sparkSession
    rows = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1))).alias("max_repeats"))
    )
    # only sources that have a target leave the executors, as at most BUCKETS numbers each
    bucket = F.floor(uniform(doc_id, seed) * BUCKETS).cast("int")
    found = (
        sizes.join(F.broadcast(rows.select(F.col("source").alias("__s"))), F.col(f"`{source}`") == F.col("__s"))
        .groupBy("__s", bucket.alias("__b"))
        .agg(F.sum("n_tokens").alias("tokens"))
    )
    spread: dict[str, np.ndarray] = {}
    for r in found.collect():
        spread.setdefault(r["__s"], np.zeros(BUCKETS))[r["__b"]] += r["tokens"] or 0
    tokens = {s: int(x.sum()) for s, x in spread.items()}
    given = {r["source"]: (r["weight"], int(r["max_repeats"])) for r in rows.collect()}
    rate = rates(tokens, given, total_tokens)
    weight = sum(given[s][0] for s in rate) or 1.0
    out = [
        (s, w, c, tokens.get(s, 0), w / weight if s in rate else 0.0, float(rate.get(s, 0.0)), cut_cdf(rate[s], c, spread.get(s)) if s in rate else [])
        for s, (w, c) in sorted(given.items())
    ]
    return spark.createDataFrame(out, PLAN)


def repeats(key: str, cdf: str = "cdf", seed: int = 7):
    """Count of a document: its hashed uniform number, looked up in the cumulative distribution."""
    u = uniform(key, seed)
    return F.size(F.filter(F.col(cdf), lambda p: p < u))


def mix(docs: DataFrame, planned: DataFrame, keep: Sequence[str] = ("doc_id", "source", "text"), doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """The mixed corpus in global random order: the kept columns of each use of a document, with copy_no from 0.

    The order is a sort by a hash of seed, id and copy (a range exchange over uniform keys, so no partition is large).
    """
    own = planned.select(F.col("source").alias("__s"), F.col("cdf").alias("__cdf")).where(F.size("__cdf") > 0)
    used = (
        docs.where(F.length(F.col(f"`{text}`")) > 0)
        .join(F.broadcast(own), F.col(f"`{source}`") == F.col("__s"))
        .withColumn("__n", repeats(doc_id, "__cdf", seed))
        .where("__n > 0")
        .select(*[F.col(f"`{c}`") for c in keep], F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy_no"))
    )
    order = F.xxhash64(F.lit(seed + 1), F.col(f"`{doc_id}`"), F.col("copy_no"))
    return used.withColumn("__order", order).orderBy("__order", doc_id, "copy_no").drop("__order")


def report(sizes: DataFrame, planned: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """Target and actual share of each target source, with tokens and documents used."""
    own = planned.select(F.col("source").alias("__s"), F.col("cdf").alias("__cdf")).where(F.size("__cdf") > 0)
    used = (
        sizes.where("n_tokens > 0")
        .join(F.broadcast(own), F.col(f"`{source}`") == F.col("__s"))
        .withColumn("__n", repeats(doc_id, "__cdf", seed))
        .groupBy("__s")
        .agg(F.sum(F.col("n_tokens") * F.col("__n")).alias("used_tokens"), F.sum("__n").alias("uses"), F.max("__n").alias("most_repeats"))
    )
    out = planned.drop("cdf").join(F.broadcast(used), F.col("source") == F.col("__s"), "left").drop("__s").fillna(0, ["used_tokens", "uses", "most_repeats"])
    total = used.agg(F.sum("used_tokens").alias("__total"))
    return out.join(F.broadcast(total)).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(F.col("__total"), F.lit(0)), F.lit(0.0))).drop("__total")
