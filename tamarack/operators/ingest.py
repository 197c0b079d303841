"""Pages to clean text: HTML, repeated blocks, front matter, registry."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamarack.functions import text as T

# What is no content, by tag and by class.
DROPPED = {"header", "footer", "nav", "aside", "script", "style", "noscript", "iframe"}
DROPPED_CLASS = re.compile(r"cookie|privacy|language.?switch|breadcrumb|skip|sidebar|social|share|print|ad-|banner", re.IGNORECASE)
MAIN_CLASS = re.compile(r"^(main|content|article)$", re.IGNORECASE)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []


class _Builder(HTMLParser):
    def __init__(self, dropped: set[str]):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.dropped = dropped

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _walk(node: _Node):
    for c in node.children:
        if isinstance(c, _Node):
            yield c
            yield from _walk(c)


def _pruned(node: _Node, dropped: set[str], by_class: bool) -> None:
    keep = []
    for c in node.children:
        if isinstance(c, _Node):
            if c.tag in dropped or (by_class and any(DROPPED_CLASS.search(x) for x in c.attrs.get("class", "").split())):
                continue
            _pruned(c, dropped, by_class)
        keep.append(c)
    node.children = keep


def _lines(node: _Node, out: list[str], mark: bool) -> None:
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append(c.strip())
        elif mark and re.fullmatch(r"h[1-6]", c.tag):
            inner: list[str] = []
            _lines(c, inner, False)
            out.append("#" * int(c.tag[1]) + " " + " ".join(inner))
        elif mark and c.tag == "li":
            inner = []
            _lines(c, inner, False)
            out.append("- " + " ".join(inner))
        else:
            _lines(c, out, mark)


def html_text(html: str | None, dropped: set[str] = DROPPED, main_only: bool = True) -> str:
    """Text of a page's main part: headings as #, list items as -, one line per piece of text."""
    if not html:
        return ""
    b = _Builder(dropped)
    b.feed(html)
    b.close()
    _pruned(b.root, dropped, main_only)
    top = b.root
    if main_only:
        nodes = list(_walk(b.root))
        tests = (
            lambda n: n.tag == "main",
            lambda n: n.attrs.get("id") == "content",
            lambda n: "main" in n.attrs.get("id", "").lower(),
            lambda n: any(MAIN_CLASS.match(x) for x in n.attrs.get("class", "").split()),
            lambda n: n.tag == "article",
            lambda n: n.tag == "body",
        )
        for test in tests:
            found = next((n for n in nodes if test(n)), None)
            if found is not None:
                top = found
                break
    out: list[str] = []
    _lines(top, out, main_only)
    return "\n".join(out)


def without_repeated_blocks(text: str, size: int = 4) -> str:
    """Text without blocks of so many lines that stood in it before.

    A window of size lines, at most one of them blank, is born where its text stands first. Each later window of that text goes, and
    with it a shorter window behind it, at the end of the text, if that repeats one too. Without such windows the text stays as it is.
    """
    lines = text.split("\n")
    windows = ["\n".join(lines[i : i + size]).strip() for i in range(len(lines))]
    whole = len(lines) - size + 1
    if whole <= size:
        return text
    blanks = np.cumsum([0, *(not x.strip() for x in lines)])
    solid = [i for i in range(whole) if blanks[i + size] - blanks[i] <= 1 and windows[i]]
    born = {windows[i]: i for i in reversed(solid)}
    repeats = [i for i in solid if born[windows[i]] < i]
    tails = [i + size for i in repeats if whole <= i + size < len(lines) and born.get(windows[i + size], i) < i]
    gone = {line for i in repeats + tails for line in range(i, i + size)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone).strip() if gone else text


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


@F.pandas_udf(StringType())
def html_to_plain_lines(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_text(h, {"script", "style", "nav", "footer"}, main_only=False))


@F.pandas_udf(StringType())
def drop_repeated_blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else without_repeated_blocks(t))


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text (cleaned), status and content_hash."""
    raw = T.clean_lines(html_to_text(F.col(html)))
    out = pages.withColumn("text", T.drop_letter_lines(drop_repeated_blocks(raw)))
    return out.withColumn("status", T.validity(F.col("text"))).withColumn("content_hash", T.short_hash(F.col("text")))


def with_front_matter(text: Column, fields: dict[str, Column], related: Column | None = None) -> Column:
    """Text under a --- block of the fields in their order; arrays as JSON; null fields are left out."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v))
    parts = [line(k, v) for k, v in fields.items()]
    if related is not None:
        parts.append(F.when(F.size(related) > 0, F.concat(F.lit("related_docs:\n"), F.array_join(F.transform(related, lambda x: F.concat(F.lit("  - "), x)), "\n"))))
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit("\n---\n\n"), text)


def vocabulary_errors(rows: DataFrame, id_col: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(id, field, value) of values outside the allowed ones; fields may be scalars or arrays, nulls pass."""
    out = None
    for field, values in allowed.items():
        is_array = rows.schema[field].dataType.typeName() == "array"
        found = F.col(field) if is_array else F.array(F.col(field))
        wrong = rows.select(F.col(id_col).cast("string").alias("id"), F.lit(field).alias("field"), F.explode(F.array_except(F.array_compact(found), F.array(*[F.lit(v) for v in values]))).alias("value"))
        out = wrong if out is None else out.unionByName(wrong)
    return out


def page_address(url: Column) -> Column:
    """An address without its fragment, the first of several; null for none."""
    return F.nullif(F.trim(F.substring_index(F.substring_index(url, "|", 1), "#", 1)), F.lit(""))


def freshness_groups(chunks: DataFrame, url: str = "source_url", content: str = "content") -> DataFrame:
    """(url, n_chunks, n_chars, content_hash): chunks of one address as one text's fingerprint.

    The fingerprint sums the chunks' hashes (modulo 2**64), so that it depends on every copy of a chunk and on no order, and an
    address with very many chunks needs no long list.
    """
    rows = chunks.withColumn("__u", page_address(F.col(url))).where(F.col("__u").isNotNull() & F.col(content).isNotNull())
    # sums of seven hexadecimal digits of each hash don't overflow, whatever the number of chunks
    part = F.conv(F.substring(F.md5(content), 1, 7), 16, 10).cast("long")
    return rows.groupBy(F.col("__u").alias("url")).agg(F.count("*").alias("n_chunks"), F.sum(F.length(content)).alias("n_chars"), F.sum(part).alias("content_hash"))


def joined_contents(chunks: DataFrame, url: str = "source_url", content: str = "content", pos: str = "pos", most: int = 1000) -> DataFrame:
    """(url, part, text): the chunks of one address in their order, joined by blank lines, as the text that is compared to the page.

    An address with more than most chunks comes out in parts of so many, so that no list is long.
    """
    rows = chunks.select(page_address(F.col(url)).alias("url"), F.col(pos).alias("__p"), F.col(content).alias("__t")).where("url is not null and __t is not null")
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("url").orderBy("__p")) - 1) / most).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__t"))), lambda x: x["__t"])
    return rows.groupBy("url", "part").agg(F.array_join(texts, "\n\n").alias("text"))


def verdicts(rows: DataFrame, response: str = "response") -> DataFrame:
    """Adds status, changes, confidence of a JSON verdict; ERROR where it can't be read."""
    v = F.from_json(response, "status string, changes_detected array<string>, additions_suggested array<string>, deletions_suggested array<string>, confidence int, reasoning string")
    return rows.withColumn("status", F.coalesce(F.when(v["status"].isin("UP_TO_DATE", "NEEDS_UPDATE", "ERROR"), v["status"]), F.lit("ERROR"))).withColumn("changes", F.coalesce(v["changes_detected"], F.array().cast("array<string>"))).withColumn("confidence", v["confidence"])


def source_registry(pages: DataFrame) -> DataFrame:
    """One line per source: file, url, status, hash."""
    return pages.select("file", "url", "status", "content_hash", F.concat_ws(" | ", F.lit(""), "file", "url", "status", "content_hash", F.lit("")).alias("row"))


def parse_yaml(text: str | None):
    """Mapping of a YAML text, or None."""
    import yaml

    try:
        v = yaml.safe_load(text) if text else None
    except yaml.YAMLError:
        return None
    return v if isinstance(v, dict) else None


@F.pandas_udf(StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """A YAML mapping as JSON text; null for anything else."""
    return text.map(lambda t: json.dumps(v, ensure_ascii=False, default=str) if (v := parse_yaml(t)) is not None else None)

