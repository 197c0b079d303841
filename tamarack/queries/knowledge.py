"""Queries over documents, pages, registers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import lexicons as X
from tamarack.functions import text as T
from tamarack.operators import analytics as A
from tamarack.operators import chunk as C
from tamarack.operators import ingest as I
from tamarack.queries.registry import query
from tamarack.queries.retrieval import chunks
from tamarack.session import spread, table

_D = "(SELECT DISTINCT ON (id) * FROM simple_documents)"
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{k}' END" for k, w in X.TAGS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(list_sort({_TAGS}), ',') tags FROM (SELECT doc_id, lower(coalesce(text, '')) t FROM documents)")
def tag_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each document."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(K.tags(F.col("text")), ",").alias("tags"))


@query("SELECT md5(string_agg(md5(coalesce(url, '')), '' ORDER BY file NULLS FIRST, md5(coalesce(url, '')))) hash, count(*) n_files FROM (SELECT DISTINCT file, url FROM sources)")
def kb_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One hash over a register of files, as a knowledge base's change detection needs it."""
    files = table(spark, d, "sources").select("file", "url").distinct()
    return C.fingerprint(files.select(F.lit("md").alias("kind"), F.col("file").alias("path"), F.coalesce("url", F.lit("")).alias("content")))


@query("SELECT CAST(sum(CAST(('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 7)) AS BIGINT)) AS BIGINT) hash, count(*) n FROM documents")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """C22 for corpora: a fingerprint of constant size."""
    return C.corpus_fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT substr(md5(text), 1, 8) hash, min(doc_id) doc_id, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content."""
    rows = table(spark, d, "documents").where("text is not null")
    # eight digits are for display: different texts would share them among ten thousands of millions
    firsts = rows.groupBy(F.md5("text").alias("whole")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return firsts.select(F.substring("whole", 1, 8).alias("hash"), "doc_id", "n")


_WS = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}\\x{1c}-\\x{1f}"


@query(
    """WITH t AS (SELECT doc_id, text, length(regexp_replace(regexp_replace(text, '^[\\s\\x{b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ''), '[\\s\\x{b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '')) n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(text, 'Error 404') OR contains(text, 'Document not found') THEN '404_error' WHEN contains(text, 'Jump to main content') AND length(text) < 400 THEN 'navigation_only' WHEN n < 400 THEN 'too_short (' || n || ' chars)' ELSE 'ok' END status FROM t"""
)
def validity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is content."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.validity(F.col("text")).alias("status"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _clean_sql(x: str) -> str:
    """SQL of text.clean_lines."""
    lines = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), chr(10))"
    return _strip(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _letters_sql(x: str) -> str:
    """SQL of text.drop_letter_lines."""
    kept = f"list_filter(string_split({x}, chr(10)), lambda l: NOT (regexp_full_match({_strip('l')}, '(?i)[a-zäöüß.{_WS}]+\\.') AND length({_strip('l')}) < 100))"
    return _strip(f"coalesce(array_to_string({kept}, chr(10)), '')")


def _blocks_sql(source: str) -> str:
    """SQL of ingest.without_repeated_blocks: CTEs that make u(id, t) of source(id, t)."""
    window = "list_slice(ls, i + 1, i + 4)"
    return f"""bd AS (SELECT id, t, string_split(t, chr(10)) ls FROM {source}),
bi AS (SELECT *, unnest(range(len(ls))) i, len(ls) n FROM bd),
bw AS (SELECT id, n, i, ls[i + 1] x, {_strip(f"array_to_string({window}, chr(10))")} k, len(list_filter({window}, lambda l: {_strip('l')} <> '')) s FROM bi),
bb AS (SELECT id, k, min(i) born FROM bw WHERE i <= n - 4 AND s >= 3 AND k <> '' GROUP BY 1, 2),
br AS (SELECT bw.id, i, n FROM bw JOIN bb ON bb.id = bw.id AND bb.k = bw.k WHERE n >= 8 AND i <= n - 4 AND s >= 3 AND born < i),
bt AS (SELECT bw.id, bw.i FROM br JOIN bw ON bw.id = br.id AND bw.i = br.i + 4 AND bw.i > br.n - 4 JOIN bb ON bb.id = bw.id AND bb.k = bw.k AND bb.born < br.i),
bg AS (SELECT DISTINCT id, i + unnest([0, 1, 2, 3]) i FROM (SELECT id, i FROM br UNION ALL SELECT id, i FROM bt)),
bk AS (SELECT bw.id, string_agg(x, chr(10) ORDER BY bw.i) t FROM bw LEFT JOIN bg ON bg.id = bw.id AND bg.i = bw.i WHERE bg.id IS NULL GROUP BY 1),
u AS (SELECT bd.id, CASE WHEN bd.id IN (SELECT id FROM bg) THEN {_strip("coalesce(bk.t, '')")} ELSE bd.t END t FROM bd LEFT JOIN bk ON bk.id = bd.id)"""


@query(f"SELECT doc_id, {_letters_sql('t')} AS text FROM (SELECT doc_id, {_clean_sql('text')} t FROM documents WHERE text IS NOT NULL)")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned lines."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", T.drop_letter_lines(T.clean_lines(F.col("text"))).alias("text"))


@query(f"WITH src AS (SELECT id, content t FROM {_D} WHERE content IS NOT NULL), {_blocks_sql('src')} SELECT id, t AS content FROM u")
def block_dedup(spark: SparkSession, d: str) -> DataFrame:
    """I4: pages without blocks that stood in them before."""
    return chunks(spark, d).where("content is not null").select("id", I.drop_repeated_blocks(F.col("content")).alias("content"))


_STATUS = "CASE WHEN contains({t}, 'Error 404') OR contains({t}, 'Document not found') THEN '404_error' WHEN contains({t}, 'Jump to main content') AND length({t}) < 400 THEN 'navigation_only' WHEN length({t}) < 400 THEN 'too_short (' || length({t}) || ' chars)' ELSE 'ok' END"


@query(
    f"""WITH src AS (SELECT id, {_clean_sql("'## ' || regexp_replace(coalesce(x.metadata.title, ''), '^[" + _WS + "]+|[" + _WS + "]+$', '', 'g') || chr(10) || coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda l: " + _strip('l') + "), lambda l: l <> ''), chr(10)), '')")} t FROM {_D} x), {_blocks_sql('src')},
v AS (SELECT id, {_letters_sql('t')} AS text FROM u) SELECT id, text, {_STATUS.format(t='text')} status, substr(md5(text), 1, 8) content_hash FROM v"""
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages wrapped as HTML, and their main text."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(safe("content"), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><nav><a>Menu</a></nav><main><h2>"), safe("title"), F.lit("</h2>"), lines, F.lit("</main><footer>Imprint</footer></html>"))
    return I.clean_pages(chunks(spark, d).select("id", page.alias("html"))).select("id", "text", "status", "content_hash")


@query(
    """SELECT CAST(file AS VARCHAR) id, field, value FROM (SELECT DISTINCT file, 'topic' AS field, topic AS value FROM sources WHERE topic IS NOT NULL AND topic NOT IN ('admission', 'visa', 'housing')
UNION ALL SELECT file, 'level', unnest(list_distinct(list_filter(level, lambda x: x IS NOT NULL AND x NOT IN ('bachelor', 'master')))) FROM (SELECT DISTINCT file, level FROM sources))"""
)
def vocab_validation(spark: SparkSession, d: str) -> DataFrame:
    """Values of the register outside its vocabularies."""
    rows = table(spark, d, "sources").select("file", "topic", "level").distinct()
    a = I.vocabulary_errors(rows.select("file", "topic").distinct(), "file", {"topic": ["admission", "visa", "housing"]})
    return a.unionByName(I.vocabulary_errors(rows.select("file", "level").distinct(), "file", {"level": ["bachelor", "master"]}))


@query(
    f"""SELECT url, count(*) n_chunks, CAST(sum(length(content)) AS BIGINT) n_chars, CAST(sum(CAST(('0x' || substr(md5(content), 1, 7)) AS BIGINT)) AS BIGINT) content_hash FROM (SELECT trim(split_part(split_part(x.metadata.source_url, '|', 1), '#', 1), ' ') url, content FROM {_D} x WHERE content IS NOT NULL) WHERE url <> '' GROUP BY 1"""
)
def freshness_group(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by address."""
    return I.freshness_groups(chunks(spark, d))


def _markdown_sql() -> str:
    """SQL of chunk.markdown_chunks for pages without addresses in comments (there are none in the tables)."""
    start = "{'o': CAST([] AS VARCHAR[]), 'r': ''}"
    unit = lambda x: f"list_transform({x}, lambda y: {{'o': CAST([] AS VARCHAR[]), 'r': y}})"
    block = f"""CASE WHEN a.r <> '' AND length(a.r) + length(e.r) + 2 > 800 THEN {{'o': list_append(a.o, {_strip('a.r')}), 'r': CASE WHEN length(a.r) > 200 THEN right(a.r, 200) || chr(10) || chr(10) || e.r ELSE e.r END}}
  WHEN a.r <> '' THEN {{'o': a.o, 'r': a.r || chr(10) || chr(10) || e.r}} ELSE {{'o': a.o, 'r': e.r}} END"""
    sentence = f"""CASE WHEN a.r <> '' AND length(a.r) + length(e.r) > 800 THEN {{'o': list_append(a.o, {_strip('a.r')}), 'r': right(a.r, 200) || ' ' || e.r}} WHEN a.r <> '' THEN {{'o': a.o, 'r': a.r || ' ' || e.r}} ELSE {{'o': a.o, 'r': e.r}} END"""
    done = lambda f: f"CASE WHEN {_strip(f + '.r')} <> '' THEN list_append({f}.o, {_strip(f + '.r')}) ELSE {f}.o END"
    front = "(?s)^---\\n(.*?)\\n---\\n?(.*)$"
    return f"""WITH d AS (SELECT CAST(id AS VARCHAR) key, CASE WHEN regexp_matches(coalesce(content, ''), '{front}') THEN regexp_extract(content, '{front}', 2) ELSE coalesce(content, '') END body,
  nullif(x.metadata.title, '') title, nullif(x.metadata.university, '') university, nullif(x.metadata.topic, '') topic, trim(split_part(coalesce(x.metadata.source_url, ''), '|', 1)) url FROM {_D} x),
l AS (SELECT key, unnest(string_split(body, chr(10))) x, generate_subscripts(string_split(body, chr(10)), 1) i FROM d),
h AS (SELECT *, length(regexp_extract(x, '^(#{{1,6}})[{_WS}]+.+$', 1)) lv, {_strip(f"regexp_extract(x, '^#{{1,6}}[{_WS}]+(.+)$', 1)")} head FROM l),
s AS (SELECT *, count(*) FILTER (WHERE lv > 0) OVER (PARTITION BY key ORDER BY i) sec FROM h),
t AS (SELECT key, sec, max(lv) lv, max(head) FILTER (WHERE lv > 0) head, {_strip("string_agg(x, chr(10) ORDER BY i)")} txt FROM s GROUP BY key, sec),
up AS (SELECT a.key, a.sec, b.lv, b.head FROM t a JOIN t b ON a.key = b.key AND b.sec <= a.sec AND b.lv > 0 WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.key = a.key AND c.sec > b.sec AND c.sec <= a.sec AND c.lv > 0 AND c.lv <= b.lv)),
pa AS (SELECT key, sec, string_agg(head, ' > ' ORDER BY lv) FILTER (WHERE lv >= 2) path, max(head) FILTER (WHERE lv = 1) h1 FROM up GROUP BY key, sec),
n AS (SELECT t.key, t.sec, t.txt, coalesce(pa.path, '') path, first_value(pa.h1) OVER (PARTITION BY t.key ORDER BY pa.h1 IS NULL, t.sec) h1 FROM t LEFT JOIN pa ON pa.key = t.key AND pa.sec = t.sec WHERE t.txt <> ''),
ll AS (SELECT key, sec, unnest(string_split(txt, chr(10))) x, generate_subscripts(string_split(txt, chr(10)), 1) i FROM n WHERE length(txt) > 800),
lf AS (SELECT *, {_strip('x')} = '' blank, starts_with({_strip('x')}, '|') tb FROM ll),
lr AS (SELECT *, sum(CASE WHEN blank OR tb <> coalesce(ptb, NOT tb) OR coalesce(pblank, true) THEN 1 ELSE 0 END) OVER (PARTITION BY key, sec ORDER BY i) run FROM (SELECT *, lag(tb) OVER (PARTITION BY key, sec ORDER BY i) ptb, lag(blank) OVER (PARTITION BY key, sec ORDER BY i) pblank FROM lf)),
lb AS (SELECT key, sec, run, string_agg(x, chr(10) ORDER BY i) b FROM lr WHERE NOT blank GROUP BY key, sec, run),
lp AS (SELECT key, sec, list_reduce({unit('list(b ORDER BY run)')}, lambda a, e: {block}, {start}) f FROM lb GROUP BY key, sec),
lq AS (SELECT key, sec, unnest(ps) p, generate_subscripts(ps, 1) no FROM (SELECT key, sec, {done('f')} ps FROM lp)),
lz AS (SELECT key, sec, no, p, list_reduce({unit("string_split(replace(p, '. ', '.' || chr(10)), chr(10))")}, lambda a, e: {sentence}, {start}) f FROM lq),
lo AS (SELECT key, sec, flatten(list(CASE WHEN length(p) <= 1600 OR contains(p, '|') THEN [p] ELSE {done('f')} END ORDER BY no)) parts FROM lz GROUP BY key, sec),
o AS (SELECT n.key, n.sec, n.path, n.h1, CASE WHEN length(n.txt) <= 800 THEN [n.txt] ELSE lo.parts END parts FROM n LEFT JOIN lo ON lo.key = n.key AND lo.sec = n.sec WHERE length(n.txt) >= 30),
z AS (SELECT key, sec, path, h1, len(parts) np, unnest(parts) part, generate_subscripts(parts, 1) i FROM o)
SELECT z.key, CAST(row_number() OVER (PARTITION BY z.key ORDER BY sec, i) - 1 AS INTEGER) pos,
 CASE WHEN q.lead <> '' THEN '[' || q.lead || ']' || chr(10) ELSE '' END || part AS content, coalesce(d.title, z.h1, d.key) title,
 CASE WHEN np = 1 THEN path WHEN path <> '' THEN path || ' (часть ' || i || ')' ELSE 'часть ' || i END section_path, d.url source_url
FROM z JOIN d ON d.key = z.key, LATERAL (SELECT concat_ws(' | ', 'Университет: ' || d.university, 'Тема: ' || d.topic, CASE WHEN z.path <> '' THEN 'Раздел: ' || z.path END) lead) q"""


@query(_markdown_sql())
def md_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of Markdown pages by headings."""
    docs = chunks(spark, d).select(F.col("id").cast("string").alias("file"), T.front_matter(F.coalesce("content", F.lit("")))["body"].alias("body"), "title", "university", "topic", "source_url")
    return C.split_markdown(docs)


def _packing_sql() -> str:
    """SQL of chunk.parents_of and children_of for documents: folds over lists, with what is still open as part of the state."""
    none = "CAST([] AS VARCHAR[])"
    pieces = lambda x, cut: f"list_filter(list_transform(string_split({x}, {cut}), lambda p: {_strip('p')}), lambda p: p <> '')"
    paragraphs = pieces("{x}", "chr(10) || chr(10)")
    sentences = pieces("replace(p, '. ', '.' || chr(10))", "chr(10)")
    units = f"""flatten(list_transform({paragraphs}, lambda p: CASE WHEN length(p) <= 400 THEN [{{'o': {none}, 'r': p, 'k': 'paragraph'}}]
  ELSE list_concat([{{'o': {none}, 'r': '', 'k': 'flush'}}], list_transform({sentences}, lambda s: {{'o': {none}, 'r': s, 'k': 'sentence'}})) END))"""
    child = """CASE WHEN e.k = 'flush' THEN CASE WHEN length(a.r) >= 200 THEN {'o': list_append(a.o, a.r), 'r': '', 'k': ''} ELSE a END
  WHEN a.r = '' THEN {'o': a.o, 'r': e.r, 'k': ''}
  WHEN length(a.r) + length(e.r) + CASE WHEN e.k = 'sentence' THEN 1 ELSE 2 END <= 400 THEN {'o': a.o, 'r': a.r || CASE WHEN e.k = 'sentence' THEN ' ' ELSE chr(10) || chr(10) END || e.r, 'k': ''}
  WHEN e.k = 'sentence' OR length(a.r) >= 200 THEN {'o': list_append(a.o, a.r), 'r': e.r, 'k': ''} ELSE {'o': a.o, 'r': e.r, 'k': ''} END"""
    parent = """CASE WHEN a.r = '' THEN {'o': a.o, 'r': e.r, 'k': ''} WHEN length(a.r) + length(e.r) + 2 <= 1600 THEN {'o': a.o, 'r': a.r || chr(10) || chr(10) || e.r, 'k': ''}
  WHEN length(a.r) >= 800 THEN {'o': list_append(a.o, a.r), 'r': e.r, 'k': ''} ELSE {'o': a.o, 'r': e.r, 'k': ''} END"""
    start = f"{{'o': {none}, 'r': '', 'k': ''}}"
    whole = lambda f, least: f"CASE WHEN length({f}.r) >= {least} THEN list_append({f}.o, {f}.r) ELSE {f}.o END"
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) key, text, coalesce(source, '') src FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, list_reduce(list_transform({paragraphs.replace("{x}", "text")}, lambda p: {{'o': {none}, 'r': p, 'k': ''}}), lambda a, e: {parent}, {start}) st FROM d),
p AS (SELECT key, src, text, CASE WHEN length(text) <= 1600 THEN [text] ELSE {whole("st", 800)} END parents FROM f),
u AS (SELECT key, src, length(text) <= 1600 short, unnest(parents) parent, generate_subscripts(parents, 1) no FROM p),
g AS (SELECT *, list_reduce({units.replace("{x}", "parent")}, lambda a, e: {child}, {start}) st FROM u),
c AS (SELECT key, src, no, parent, CASE WHEN short AND len({whole("st", 200)}) = 0 THEN [parent] ELSE {whole("st", 200)} END children FROM g),
n AS (SELECT *, sum(1 + len(children)) OVER (PARTITION BY key ORDER BY no) - 1 - len(children) AS pos, substr(md5(src || '::' || substr(parent, 1, 100)), 1, 16) parent_id FROM c)
SELECT key, CAST(pos AS INTEGER) pos, parent AS content, parent_id, CAST(NULL AS INTEGER) child_index, true is_parent, false is_child, CAST(len(children) AS INTEGER) num_children FROM n
UNION ALL SELECT key, CAST(pos + i AS INTEGER), child, parent_id, CAST(i - 1 AS INTEGER), false, true, NULL FROM (SELECT key, pos, parent_id, unnest(children) child, generate_subscripts(children, 1) i FROM n)"""


@query(_packing_sql())
def parent_child(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children."""
    return C.parent_child(spread(table(spark, d, "documents").select("doc_id", "text", "source")), key="doc_id", content="text", source="source")


@query("SELECT doc_id, substr(md5(coalesce(source, '') || ':' || coalesce(topic, '') || ':' || substr(coalesce(text, ''), 1, 100)), 1, 16) parent_id FROM documents")
def parent_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids of parents."""
    return table(spark, d, "documents").select("doc_id", T.parent_id(F.col("source"), F.col("topic"), F.col("text")).alias("parent_id"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '/' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(o_orderdate) - 1) || '/' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END valid_for FROM orders")
def valid_for(spark: SparkSession, d: str) -> DataFrame:
    """Academic year of a semester."""
    semester = F.concat(F.when(F.month("o_orderdate") >= 7, "WS").otherwise("SS"), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.valid_for(F.lit(None).cast("string"), semester).alias("valid_for"))


@query(
    f"""SELECT doc_id, CASE WHEN len(w) > 250 THEN '... ' || array_to_string(list_slice(w, len(w) - 249, len(w)), ' ') ELSE text END summary
FROM (SELECT doc_id, text, regexp_split_to_array({_strip('text')}, '[{_WS}]+') w FROM documents WHERE text IS NOT NULL)"""
)
def summary_truncate(spark: SparkSession, d: str) -> DataFrame:
    """The last 250 words of each text."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", T.last_words(F.col("text")).alias("summary"))


@query("SELECT list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(content, ''), 'https?://\\S+'), lambda u: NOT list_contains(regexp_extract_all(coalesce(x.metadata.source_url, ''), 'https?://\\S+'), u)))) urls, id FROM " + _D + " x WHERE contains(content, 'http')")
def url_difference(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in a text that its source doesn't name."""
    return chunks(spark, d).where(F.contains("content", F.lit("http"))).select("id", A.unsupported_urls(F.col("content"), F.col("source_url")).alias("urls"))


@query(
    f"""WITH r AS (SELECT id, lower(trim(coalesce(x.metadata.topic, ''))) t, lower(trim(coalesce(x.metadata.source, ''))) s FROM {_D} x)
SELECT id, CASE WHEN t = 'housing' THEN 'housing' WHEN t IN ('student-budget', 'nutrition', 'food') THEN 'food' WHEN t IN ('visa-d', 'residence-permit') THEN 'visa' WHEN t IN ('tuition-fees', 'scholarships') THEN 'finance'
 WHEN t IN ('german-language', 'german-requirements', 'german-courses', 'english-programs') THEN 'language' WHEN t IN ('university-application', 'admission') THEN 'admission' WHEN contains(s, '/housing') OR s LIKE '%housing.md' THEN 'housing' WHEN contains(s, 'student-budget') THEN 'food' ELSE 'general' END entity_type FROM r"""
)
def entity_type_inference(spark: SparkSession, d: str) -> DataFrame:
    """C4: type of a chunk by topic and file."""
    return chunks(spark, d).select("id", K.entity_type(F.col("topic"), F.col("source")).alias("entity_type"))


@query(f"SELECT coalesce(x.metadata.source, '') source, count(*) FILTER (WHERE coalesce(x.metadata.is_yaml_fact, false)) facts, count(*) FILTER (WHERE NOT coalesce(x.metadata.is_yaml_fact, false)) narratives FROM {_D} x GROUP BY 1")
def fact_share(spark: SparkSession, d: str) -> DataFrame:
    """Facts and narratives by file."""
    return A.fact_share(chunks(spark, d).withColumn("source", F.coalesce("source", F.lit(""))), "source")


@query(
    """SELECT file, '---' || chr(10) || concat_ws(chr(10), 'url: ' || url, 'topic: ' || topic, 'country_scope: ' || CAST(to_json(country_scope) AS VARCHAR), 'level: ' || CAST(to_json(level) AS VARCHAR), 'university: ' || university,
 CASE WHEN len(related_docs) > 0 THEN 'related_docs:' || chr(10) || coalesce(array_to_string(list_transform(related_docs, lambda x: '  - ' || x), chr(10)), '') END) || chr(10) || '---' || chr(10) || chr(10) head FROM (SELECT DISTINCT * FROM sources)"""
)
def front_matter_render(spark: SparkSession, d: str) -> DataFrame:
    """I8: register entries as front matter."""
    rows = table(spark, d, "sources").distinct()
    fields = {"url": F.col("url"), "topic": F.col("topic"), "country_scope": F.to_json("country_scope"), "level": F.to_json("level"), "university": F.col("university")}
    return rows.select("file", I.with_front_matter(F.lit(""), fields, F.col("related_docs")).alias("head"))


@query(
    """WITH n AS (SELECT coalesce(topic, '') topic, CAST(sum(CAST(('0x' || substr(md5(coalesce(file, '') || ':' || coalesce(url, '')), 1, 7)) AS BIGINT)) AS BIGINT) hash FROM (SELECT DISTINCT file, url, topic FROM sources) GROUP BY 1)
SELECT topic, hash, 'offline' provider, CAST(64 AS INTEGER) embedding_dim, topic NOT IN (SELECT topic FROM n WHERE hash % 2 = 0) reindex FROM n"""
)
def reindex_decision(spark: SparkSession, d: str) -> DataFrame:
    """Which topics' files differ from the state stored (every second one), and so are indexed anew."""
    files = table(spark, d, "sources").select("file", "url", F.coalesce("topic", F.lit("")).alias("topic")).distinct()
    key = F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce("url", F.lit("")))
    new = files.groupBy("topic").agg(F.sum(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")).alias("hash")).withColumn("provider", F.lit("offline")).withColumn("embedding_dim", F.lit(64))
    old = new.withColumn("hash", F.col("hash") + F.col("hash") % 2)
    return C.needs_reindex(old, new, "topic")
