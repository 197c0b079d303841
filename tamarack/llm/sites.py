"""Which site a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host of an address: before any "|", trimmed, lower case, without scheme, user, port and leading "www."; null if none."""
    first = F.lower(F.trim(F.substring_index(url, "|", 1)))
    bare = F.regexp_extract(first, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    bare = F.regexp_replace(bare, r"^www\.", "")
    return F.when(F.length(bare) > 0, bare)


def with_site(docs: DataFrame, sources: DataFrame, url: Column, file: Column, out: str = "site") -> DataFrame:
    """Adds the site: host of url, for rows without one the host of the registered source with that file.

    sources is the register of crawled sections, a fixed table of some hundred rows; it is broadcast.
    """
    register = (
        sources.where(F.col("file").isNotNull())
        .groupBy(F.col("file").alias("__file"))
        .agg(F.min(host(F.col("url"))).alias("__host"))
    )
    given = host(url)
    return docs.withColumn("__f", file).join(F.broadcast(register), F.col("__f") == F.col("__file"), "left").withColumn(out, F.coalesce(given, F.col("__host"))).drop("__f", "__file", "__host")
