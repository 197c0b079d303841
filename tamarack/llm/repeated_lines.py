"""Lines repeated across the documents of one site.

Lines are compared by their letters, lower-cased. Documents whose lines have the same letters in the same order are copies of one
another, whatever their numbers, dates and blanks, and form a cluster: a republished article is one. A line's occurrences are
collapsed to clusters first, each with the number of rows it stands for and the publication dates its rows state, and the line is
then counted over these: rows (the sum of the weights), clusters and dates in one go.

Two rules decide. by="rows": a line is repeated if it stands in at least min_share of a site's rows and in at least min_rows
of them; clusters and dates are reported beside. by="clusters": if it stands in so large a share of the site's clusters, in min_rows
of them, and under at least min_dates dates (or as many as the site states at all), so that one article in a hundred copies makes no
boilerplate.

Plan. (1) Count lines per site including copies; that needs no distinct step, so nearly all of it is combined before the
shuffle, and hot sites (a third of all rows, say) shrink to their distinct lines on every mapper. What stays above
the threshold is a superset of the answer, and small: at most 1/min_share times the lines of an average page per site.
(2) Only the occurrences of these candidates are collapsed and counted exactly. The candidates are joined by
their hash: as a broadcast while there are at most broadcast_rows of them (they are counted first), by a shuffle beyond that.
The content itself is never shuffled in finding lines.

For by="clusters" step (1) takes the lower bound that clusters set: a line in so many clusters stands in at least as many rows.

Defined results: null or empty contents have no lines; lines without letters never count; a site of one row has no repeated
lines; rows without site or with is_yaml_fact true take no part; rows with the same id count once, and their lines come out
once; extra columns are carried through removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import cut

#: Up to so many candidate lines (of about 50 bytes) are broadcast.
BROADCAST_ROWS = 200_000


def letters(line: Column) -> Column:
    """What two lines must share to be equal."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def line_keys(content: Column) -> Column:
    """Array, one entry per line: hash of the line's letters, null for lines without letters."""
    # a lambda's value is computed once, an expression that it names twice isn't
    hashes = F.transform(F.split(content, "\n", -1), lambda line: F.xxhash64(letters(line)))
    return F.transform(hashes, lambda h: F.when(h != F.xxhash64(F.lit("")), h))


def published(content: Column) -> Column:
    """Day of a publication or change stated at the end of a line, as text; null if there is none."""
    found = F.regexp_extract(content, DATED, 1)
    return F.when(F.length(found) > 0, found)


#: A line of words that ends with a date.
DATED = r"(?:^|\n)[^\d\n]{3,60}(\d{1,2}\.\d{1,2}\.(?:19|20)\d{2}|(?:19|20)\d{2}-\d{2}-\d{2})[ \t\r]*(?:\n|\z)"


def cluster_of(keys: Column) -> Column:
    """What documents with the same letters in the same lines share."""
    return F.xxhash64(F.array_compact(keys))


def repeated_lines(
    docs: DataFrame,
    id_col: str = "id",
    content: str = "content",
    site: str = "site",
    min_share: float = 0.2,
    min_rows: int = 5,
    by: str = "rows",
    min_dates: int = 2,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(site, line_key, n_rows, n_clusters, n_dates) of repeated lines and, joined to it, their occurrences (id, line_no)."""
    if by not in ("rows", "clusters"):
        raise ValueError("by is rows or clusters")
    own = docs.where(F.col(f"`{site}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{site}`").alias("site"), F.col(f"`{content}`").alias("__c"))
    if by == "rows":
        totals = own.groupBy("site").agg(F.count_distinct("id").alias("total"), F.lit(0).cast("long").alias("dates"))
    else:
        each = own.select("site", cluster_of(line_keys(F.coalesce("__c", F.lit("")))).alias("cluster"), published(F.col("__c")).alias("day"))
        totals = each.groupBy("site").agg(F.count_distinct("cluster").alias("total"), F.count_distinct("day").alias("dates"))
    base = own.where(F.col("__c").isNotNull())
    enough = lambda n: F.col(n) >= F.greatest(F.lit(float(min_rows)), F.col("total") * F.lit(min_share)) - F.lit(1e-9)
    keys = base.select("site", F.explode(F.array_distinct(line_keys(F.col("__c")))).alias("line_key")).where("line_key is not null")
    # sites are few beside rows, but the join stays open to the optimizer: its size is known at run time
    frequent = keys.groupBy("site", "line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    candidates = cut(frequent.join(totals, "site").where(enough("n")).select("site", "line_key", "total", "dates"))
    hint = F.broadcast(candidates) if candidates.count() <= broadcast_rows else candidates
    lines = base.select("id", "site", published(F.col("__c")).alias("day"), line_keys(F.col("__c")).alias("__k"))
    lines = lines.select("id", "site", "day", cluster_of(F.col("__k")).alias("cluster"), F.posexplode("__k").alias("line_no", "line_key"))
    found = cut(lines.where("line_key is not null").join(hint.select("site", "line_key"), ["site", "line_key"]))
    # copies are collapsed before anything is counted: first rows of an id, then ids of a cluster
    rows = found.groupBy("site", "line_key", "id").agg(F.min("cluster").alias("cluster"), F.min("day").alias("day"))
    clusters = rows.groupBy("site", "line_key", "cluster", "day").agg(F.count("*").alias("weight"))
    per_line = clusters.groupBy("site", "line_key").agg(F.sum("weight").alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.count_distinct("day").alias("n_dates"))
    per_line = per_line.join(hint, ["site", "line_key"])
    repeated = enough("n_rows") if by == "rows" else enough("n_clusters") & (F.col("n_dates") >= F.least(F.lit(min_dates), "dates"))
    occurrences = found.select("site", "line_key", "id", "line_no").distinct()
    return occurrences.join(per_line.where(repeated).drop("total", "dates"), ["site", "line_key"])


def without_repeated_lines(docs: DataFrame, occurrences: DataFrame, id_col: str = "id", content: str = "content", out: str = "cleaned") -> DataFrame:
    """docs with the repeated lines taken out of content; all rows and columns stay."""
    drop = occurrences.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__drop"))
    lines = F.split(F.col(content), "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    return docs.join(drop, F.col(id_col) == F.col("__id"), "left").withColumn(out, F.when(F.col("__drop").isNull(), F.col(content)).otherwise(left)).drop("__id", "__drop")
