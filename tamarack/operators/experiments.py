"""Experiments: variants by hash of user and experiment, and roll-ups of their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000


def bucket(user: Column, experiment: Column) -> Column:
    """md5("user:experiment") as a number, modulo BUCKETS. The halves are reduced apart: 2**64 modulo 10000 is 1616."""
    h = F.md5(F.concat_ws(":", user.cast("string"), experiment))

    def part(start: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(4):  # four hexadecimal digits at a time stay within a long
            out = F.pmod(out * 65536 + F.conv(F.substring(h, start + 4 * i, 4), 16, 10).cast("long"), F.lit(BUCKETS))
        return out

    return F.pmod(part(1) * 1616 + part(17), F.lit(BUCKETS)).cast("int")


def cumulative(splits: DataFrame) -> DataFrame:
    """(experiment, variant, ord, split) as intervals [low, high); the first variant also has what the splits leave over."""
    from pyspark.sql import Window

    by = Window.partitionBy("experiment").orderBy("ord")
    high = F.round(F.sum("split").over(by), 9)
    return splits.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(by), F.lit(0.0)))


#: Experiments of a configuration, as many as one expression holds.
MOST_EXPERIMENTS = 1000


def assigned(users: DataFrame, splits: DataFrame, user: str = "tg_id") -> DataFrame:
    """(user, experiment, bucket, variant) for every experiment in splits, a configuration table: it becomes part of the expression,
    so users aren't joined to anything. More than MOST_EXPERIMENTS are no configuration and raise an error."""
    c = cumulative(splits).groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("ord", "variant", "high"))).alias("v")).limit(MOST_EXPERIMENTS + 1).collect()
    if len(c) > MOST_EXPERIMENTS:
        raise ValueError(f"more than {MOST_EXPERIMENTS} experiments")

    def placed(experiment: str, variants: list) -> Column:
        own = bucket(F.col(user), F.lit(experiment))
        pick = F.lit(variants[0]["variant"])
        for v in reversed(variants):
            pick = F.when(own / F.lit(float(BUCKETS)) < F.lit(v["high"]), F.lit(v["variant"])).otherwise(pick)
        return F.struct(F.lit(experiment).alias("experiment"), own.alias("bucket"), pick.alias("variant"))

    every = F.array(*[placed(r["experiment"], r["v"]) for r in c]) if c else F.array().cast("array<struct<experiment:string,bucket:int,variant:string>>")
    return users.select(user).distinct().select(user, F.inline(every))


def valid_splits(splits: DataFrame) -> DataFrame:
    """(experiment, total, is_valid): the splits must sum to 1 within a hundredth."""
    total = splits.groupBy("experiment").agg(F.round(F.sum("split"), 6).alias("total"))
    return total.withColumn("is_valid", (F.col("total") >= 0.99) & (F.col("total") <= 1.01))


def rolled_up(metrics: DataFrame) -> DataFrame:
    """(experiment, variant, metric): count, mean and extremes."""
    return metrics.groupBy("experiment", "variant", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
