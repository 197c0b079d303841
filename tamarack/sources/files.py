"""Files in and out: Markdown and YAML trees, page tables, evaluation sets, CSV and JSON reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.ingest import with_front_matter


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of .md files below path, without README.md and names beginning with _."""
    return _whole(spark, path, "*.md").where(~F.col("name").startswith("_") & (F.col("name") != "README.md"))


def yaml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of .yaml files below path, without schema.yaml and names beginning with _."""
    return _whole(spark, path, "*.yaml").where(~F.col("name").startswith("_") & (F.col("name") != "schema.yaml"))


def pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Fetched pages (url, html, status, error) from Parquet or JSON lines; a page that failed or isn't status 200 has its error as text."""
    rows = spark.read.format(format).load(path)
    column = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    status, failed = F.coalesce(column("status", "int"), F.lit(200)), column("error", "string")
    error = F.when(failed.isNotNull(), F.concat(F.lit("FETCH ERROR: "), failed)).when(status != 200, F.concat(F.lit("HTTP ERROR: "), status.cast("string")))
    return rows.select("url", F.when(error.isNull(), F.col("html")).alias("html"), error.alias("fetch_error"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, question string, expected_keywords array<string>, topic string, difficulty string").json(path, multiLine=True)


def write_chunks(chunks: DataFrame, path: str, partition: str | None = None) -> None:
    w = chunks.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append_with_ids(spark: SparkSession, path: str, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Appends rows with ids above the ones there are; returns what was added, read back, as ids are given anew at each run of a plan.

    Rows without an embedding are left out.
    """
    top = spark.read.parquet(path).agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("m")).first()["m"]
    new = rows.where(F.size("embedding") > 0).withColumn(id_col, F.lit(top + 1) + F.monotonically_increasing_id())
    new = new.select(*spark.read.parquet(path).columns)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col(id_col) > top)


def write_markdown(pages_: DataFrame, path: str, file: str = "file", text: str = "text", fields: Mapping[str, str] = {}) -> None:
    """Texts under their front matter, one directory per file name."""
    body = with_front_matter(F.col(text), {k: F.col(c).cast("string") for k, c in fields.items()})
    pages_.select(F.col(file).alias("file"), body.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_report(sheets: Mapping[str, DataFrame], path: str) -> list[str]:
    """One CSV directory per sheet that has rows."""
    written = []
    for name, rows in sheets.items():
        if not rows.isEmpty():
            rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
            written.append(name)
    return written


def evaluation_json(results: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text with summary and results; an evaluation has some dozens of questions."""
    listed = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
    return summary.agg(F.first(F.struct(*summary.columns)).alias("summary")).join(listed).select(F.to_json(F.struct("summary", "results")).alias("value"))
