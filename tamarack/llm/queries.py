"""Queries on training data, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.session import spread, table


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "feedback").select("id", "question", "answer"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.pairs import broken

    return broken(_feedback(spark, d))


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.pairs import judge

    return judge(_feedback(spark, d)).where(F.size("defects") > 0).select("id", F.explode("defects").alias("defect"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm import conversations as C

    return C.to_drop(table(spark, d, "messages")).withColumnRenamed("account", "tg_id")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm import conversations as C

    return C.conversations(table(spark, d, "messages")).withColumnRenamed("account", "tg_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.neighbours import similar_pairs

    return similar_pairs(spread(table(spark, d, "simple_documents").select("id", "embedding")))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.neighbours import nearest

    return nearest(spread(table(spark, d, "simple_documents").select("id", "embedding")), queries=F.col("id") % 20 == 0, probes=64, max_angle=40.0).withColumn("cosine", F.round("cosine", 6))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.sites import with_site

    docs = table(spark, d, "simple_documents").where(~F.coalesce(F.col("metadata.is_yaml_fact"), F.lit(False)))
    docs = docs.select("id", "content", F.col("metadata.source").alias("file"), F.col("metadata.source_url").alias("url"))
    return with_site(spread(docs), table(spark, d, "sources"), F.col("url"), F.col("file")).drop("file", "url")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.repeated_lines import repeated_lines

    return repeated_lines(_pages(spark, d)).select("id", "line_no")


def p4_by_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in many different texts and under several dates of a site, whatever the copies of one text."""
    from tamarack.llm.repeated_lines import repeated_lines

    return repeated_lines(_pages(spark, d), by="clusters").select("id", "line_no", "n_rows", "n_clusters", "n_dates")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.repeated_lines import repeated_lines, without_repeated_lines

    pages = _pages(spark, d)
    return without_repeated_lines(pages, repeated_lines(pages).select("id", "line_no")).select("id", "site", "cleaned")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, text) of messages and questions."""
    rows = spread(table(spark, d, "messages").select(F.lit("messages").alias("tbl"), "id", F.col("content").alias("text")))
    return rows.unionByName(spread(table(spark, d, "feedback").select(F.lit("feedback").alias("tbl"), "id", F.col("question").alias("text"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.personal import find

    rows = _texts(spark, d)
    return find(rows.where("text is not null"), "text", ("tbl", "id")).select("tbl", "id", "kind", "surface").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.personal import redact

    rows = _texts(spark, d)
    return redact(rows, "text", ("tbl", "id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.pages import boilerplate_lines

    return boilerplate_lines(_pages(spark, d)).distinct()


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.pages import main_body

    return main_body(_pages(spark, d)).distinct()


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.splitting import knowledge_items, split_items

    items = knowledge_items(spread(table(spark, d, "simple_documents").select("id", "content")), spread(table(spark, d, "chunk_pairs")))
    return split_items(items, ("item_kind", "item_key", "pos"), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("item_kind", "item_key", "pos").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).distinct()


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What each item's pieces give back: its text without the overlaps, and whether they keep the limit, the overlap and the order."""
    pieces = _pieces(spark, d).distinct()
    limit = F.when(F.col("item_kind") == "child", 400).otherwise(1600)
    overlap = F.when(F.col("item_kind") == "child", 50).otherwise(200)
    listed = F.array_sort(F.collect_list(F.struct("piece_no", "begin", "end", "piece")))
    items = pieces.groupBy("item_kind", "item_key", "pos").agg(listed.alias("p"))
    before = F.concat(F.array(F.lit(0)), F.slice("p.end", 1, F.size("p") - 1))
    fresh = F.zip_with("p", before, lambda x, b: F.substr(x["piece"], b - x["begin"] + 1))
    keeps = F.forall("p", lambda x: (x["end"] - x["begin"] <= limit) & (F.length(x["piece"]) == x["end"] - x["begin"]))
    follows = F.forall(F.zip_with("p", before, lambda x, b: (x["begin"] <= b) & (b - x["begin"] <= overlap) & (x["end"] > b)), lambda ok: ok)
    return items.select("item_kind", "item_key", "pos", F.md5(F.array_join(fresh, "")).alias("text_md5"), F.element_at("p.end", -1).alias("n_chars"), (keeps & follows).alias("well_cut"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.tokenize import encode_corpus

    return encode_corpus(_documents(spark, d))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm import mixing as M

    targets = table(spark, d, "mix_targets")
    docs = M.of_targets(_documents(spark, d), targets)
    return M.mix(docs, M.plan(M.token_sizes(docs), targets))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm import mixing as M
    from tamarack.session import cut

    targets = table(spark, d, "mix_targets")
    sizes = cut(M.token_sizes(M.of_targets(_documents(spark, d), targets)))
    return M.report(sizes, M.plan(sizes, targets))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.language import mislabelled

    return mislabelled(_documents(spark, d)).select("doc_id", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.llm.language import segments

    return segments(_documents(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_defects, p2_found, p2_conversations, p3_found, p3_neighbours, p4_found, p4_by_clusters, p4_cleaned, p5_found, p5_redacted, p6_found, p6_main, p7_found, p7_pieces, p7_round_trip, p8_ids, p9_mixed, p9_shares, p10_found, p10_segments)}


_P2 = """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS LAST) n FROM messages WHERE tg_id IS NOT NULL AND created_at IS NOT NULL AND id IS NOT NULL),
m AS (SELECT tg_id, id, created_at,
  CASE WHEN r IN ('user','human','usr') THEN 0 WHEN r IN ('system','tool') THEN 1 WHEN r IN ('assistant','bot','ai','model') THEN 3 ELSE 2 END rk,
  coalesce(regexp_replace(content, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{2064}\\x{3000}\\x{feff}\\x{ad}\\x{180e}]+', '', 'g') = '', true) blank
  FROM (SELECT *, lower(regexp_replace(coalesce(role,''), '^[\\s\\x{a0}\\x{200b}\\x{feff}]+|[\\s\\x{a0}\\x{200b}\\x{feff}]+$', '', 'g')) r FROM w WHERE n = 1)),
g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY tg_id ORDER BY created_at, rk, id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM m),
s AS (SELECT *, sum(nw) OVER (PARTITION BY tg_id ORDER BY created_at, rk, id ROWS UNBOUNDED PRECEDING) c, row_number() OVER (PARTITION BY tg_id ORDER BY created_at, rk, id) pos FROM g),
a AS (SELECT tg_id, c, min_by(id, pos) first_id, count(*) FILTER (NOT blank AND rk <> 1) t, count(*) FILTER (NOT blank AND rk = 2) nn,
  min_by(rk, pos) FILTER (NOT blank AND rk <> 1) fr, max_by(rk, pos) FILTER (NOT blank AND rk <> 1) lr, count(*) FILTER (blank AND rk = 3) bb FROM s GROUP BY tg_id, c)
"""

P2_SQL = f"""{_P2}SELECT tg_id, first_id, CASE WHEN t = 0 THEN 'empty' WHEN nn > 0 OR fr = 3 THEN 'broken' ELSE 'missing_reply' END reason
FROM a WHERE t = 0 OR nn > 0 OR fr = 3 OR lr = 0 OR bb > 0
"""

P2_TURNS_SQL = f"""{_P2}SELECT s.tg_id, a.first_id, b.block, CAST(b.seg AS INTEGER) seg, b.pos, s.id, CASE WHEN s.rk = 0 THEN 'user' ELSE 'assistant' END speaker, w.content
FROM s JOIN a ON a.tg_id = s.tg_id AND a.c = s.c JOIN w ON w.id = s.id AND w.n = 1
JOIN (SELECT id, block, row_number() OVER (PARTITION BY tg_id, block ORDER BY created_at, rk, id) - 1 pos, sum(nb) OVER (PARTITION BY tg_id, block ORDER BY created_at, rk, id ROWS UNBOUNDED PRECEDING) seg
  FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY tg_id, block ORDER BY created_at, rk, id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END nb FROM (SELECT *, CAST(floor(epoch_us(created_at) / 3600000000) AS BIGINT) block FROM m))) b ON b.id = s.id
WHERE NOT (a.t = 0 OR a.nn > 0 OR a.fr = 3 OR a.lr = 0 OR a.bb > 0) AND NOT s.blank AND s.rk IN (0, 3)
"""

_P4 = """
WITH reg AS (SELECT file, min(regexp_replace(regexp_extract(lower(trim(split_part(url,'|',1))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), '^www\\.', '')) h FROM sources WHERE file IS NOT NULL GROUP BY file),
p AS (SELECT id, content, coalesce(nullif(regexp_replace(regexp_extract(lower(trim(split_part(d.metadata.source_url,'|',1))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), '^www\\.', ''), ''), h) site
  FROM (SELECT DISTINCT ON (id) * FROM simple_documents) d LEFT JOIN reg ON reg.file = d.metadata.source WHERE coalesce(d.metadata.is_yaml_fact, false) = false),
l AS (SELECT id, site, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 line_no FROM p WHERE site IS NOT NULL),
k AS (SELECT id, site, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) x FROM l),
"""

P4_SQL = f"""{_P4}n AS (SELECT site, count(DISTINCT id) sn FROM p WHERE site IS NOT NULL GROUP BY site),
r AS (SELECT site, x FROM (SELECT site, x, count(DISTINCT id) c FROM k WHERE x <> '' GROUP BY site, x) JOIN n USING (site) WHERE c >= 5 AND c >= 0.2 * sn)
SELECT k.id, CAST(k.line_no AS INTEGER) line_no FROM k JOIN r USING (site, x)
"""

P4_CLEANED_SQL = f"""{_P4}n AS (SELECT site, count(DISTINCT id) sn FROM p WHERE site IS NOT NULL GROUP BY site),
r AS (SELECT site, x FROM (SELECT site, x, count(DISTINCT id) c FROM k WHERE x <> '' GROUP BY site, x) JOIN n USING (site) WHERE c >= 5 AND c >= 0.2 * sn),
o AS (SELECT k.id, list(k.line_no) dl FROM k JOIN r USING (site, x) GROUP BY 1)
SELECT d.id, p.site, CASE WHEN dl IS NULL THEN d.content ELSE array_to_string(list_filter(string_split(d.content, chr(10)), lambda x, i: NOT list_contains(dl, i - 1)), chr(10)) END cleaned
FROM simple_documents d JOIN p ON p.id = d.id LEFT JOIN o ON o.id = d.id
"""

P4_CLUSTERS_SQL = f"""{_P4}c AS (SELECT id, string_agg(x, chr(10) ORDER BY line_no) FILTER (WHERE x <> '') letters FROM k GROUP BY id),
q AS (SELECT p.id, p.site, coalesce(letters, '') cl, nullif(regexp_extract(coalesce(content, ''), '(?:^|\\n)[^\\d\\n]{{3,60}}(\\d{{1,2}}\\.\\d{{1,2}}\\.(?:19|20)\\d{{2}}|(?:19|20)\\d{{2}}-\\d{{2}}-\\d{{2}})[ \\t\\r]*(?:\\n|\\z)', 1), '') dy FROM p LEFT JOIN c USING (id) WHERE p.site IS NOT NULL),
n AS (SELECT site, count(DISTINCT cl) sn, count(DISTINCT dy) dn FROM q GROUP BY site),
r AS (SELECT k.site, k.x, count(DISTINCT k.id) n_rows, count(DISTINCT cl) n_clusters, count(DISTINCT dy) n_dates FROM k JOIN q USING (id) WHERE k.x <> '' GROUP BY k.site, k.x)
SELECT k.id, CAST(k.line_no AS INTEGER) line_no, r.n_rows, r.n_clusters, r.n_dates FROM k JOIN r USING (site, x) JOIN n ON n.site = k.site
WHERE r.n_clusters >= 5 AND r.n_clusters >= 0.2 * n.sn AND r.n_dates >= least(2, n.dn)
"""


P7_SQL = """
SELECT DISTINCT 'content' item_kind, CAST(id AS VARCHAR) item_key, CAST(0 AS INTEGER) pos FROM simple_documents WHERE length(content) > 1600
UNION SELECT 'parent', CAST(parent_id AS VARCHAR), CAST(0 AS INTEGER) FROM chunk_pairs WHERE length(parent_content) > 1600
UNION SELECT 'child', key, pos FROM (SELECT CAST(parent_id AS VARCHAR) key, unnest(children_content) t, CAST(generate_subscripts(children_content, 1) - 1 AS INTEGER) pos FROM chunk_pairs) WHERE length(t) > 400
"""


P7_TEXT_SQL = """
SELECT DISTINCT item_kind, item_key, pos, md5(t) text_md5, CAST(length(t) AS INTEGER) n_chars, true well_cut FROM (
 SELECT 'content' item_kind, CAST(id AS VARCHAR) item_key, CAST(0 AS INTEGER) pos, content t FROM simple_documents WHERE length(content) > 1600
 UNION ALL SELECT 'parent', CAST(parent_id AS VARCHAR), CAST(0 AS INTEGER), parent_content FROM chunk_pairs WHERE length(parent_content) > 1600
 UNION ALL SELECT 'child', key, pos, t FROM (SELECT CAST(parent_id AS VARCHAR) key, unnest(children_content) t, CAST(generate_subscripts(children_content, 1) - 1 AS INTEGER) pos FROM chunk_pairs) WHERE length(t) > 400)
"""


P3_SQL = """
WITH v AS (SELECT DISTINCT ON (id) id, CAST(embedding AS DOUBLE[]) e FROM simple_documents
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c AS (SELECT a.id x, b.id y, round(list_cosine_similarity(a.e, b.e), 9) s FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) r FROM c WHERE s >= 0.9)
SELECT DISTINCT least(x, y) id_a, greatest(x, y) id_b FROM t WHERE r <= 10
"""


P3_NEIGHBOURS_SQL = """
WITH v AS (SELECT DISTINCT ON (id) id, CAST(embedding AS DOUBLE[]) e FROM simple_documents
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c AS (SELECT a.id, b.id other, round(list_cosine_similarity(a.e, b.e), 9) s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
SELECT id, other, round(s, 6) cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) r FROM c) WHERE r <= 10
"""


def oracle_sql() -> dict:
    return {"p2_found": P2_SQL, "p2_conversations": P2_TURNS_SQL, "p7_round_trip": P7_TEXT_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p4_by_clusters": P4_CLUSTERS_SQL, "p4_cleaned": P4_CLEANED_SQL, "p3_neighbours": P3_NEIGHBOURS_SQL, "p7_found": P7_SQL}
