"""Streams of log and message files: late and repeated rows, windowed metrics, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(rows: DataFrame, id_col: str = "id", at: str = "created_at", late: str = "2 days") -> DataFrame:
    """Rows without repeats; state is kept for as long as rows may be late."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def metrics(logs: DataFrame, window: str = "1 hour", late: str = "2 days", at: str = "created_at") -> DataFrame:
    """Queries, hits, failures and mean time per window of event time."""
    timed = F.when(F.col("t_total") >= 0, F.col("t_total"))
    return (
        logs.withWatermark(at, late)
        .groupBy(F.window(at, window))
        .agg(F.count("*").alias("queries"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("hits"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.avg(timed).alias("avg_time"))
        .select(F.col("window.start").alias("start"), "queries", "hits", "failures", "avg_time")
    )


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "2 days", key: str = "tg_id", at: str = "created_at") -> DataFrame:
    """Spells of activity per user."""
    return (
        messages.where(F.col(key).isNotNull())
        .withWatermark(at, late)
        .groupBy(key, F.session_window(at, gap))
        .agg(F.count("*").alias("messages"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages")
    )


def write_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what there is and stops: a scheduled batch with the state of a stream."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
