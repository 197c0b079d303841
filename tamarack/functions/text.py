"""Text functions as column expressions: cleaning, answers, citations, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that stay, notices, prefixes.
ALLOWED_TAGS = ["b", "strong", "i", "em", "u", "ins", "s", "strike", "del", "a", "code", "pre", "blockquote", "tg-spoiler", "span"]
BLOCK_TAGS = ["p", "div", "li", "ul", "ol", "details", "summary", "section", "article", "header", "footer", "h[1-6]", "tr", "td", "th", "table", "thead", "tbody"]
MIN_CONTENT = 400


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.md5(text), 1, length)


def strip_python(text: Column) -> Column:
    """White space of both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_lines(text: Column) -> Column:
    """Lines stripped, runs of blank lines made one, ends stripped."""
    lines = F.transform(F.split(text, "\n", -1), strip_python)
    return strip_python(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def drop_letter_lines(text: Column, longest: int = 100) -> Column:
    """Without lines that, stripped, are shorter than longest, hold letters of German, blanks and stops only and end with a stop."""

    def keep(line: Column) -> Column:
        bare = strip_python(line)
        return ~(bare.rlike(r"(?iU)\A[a-zäöüß\s.]+\.\z") & (F.length(bare) < longest))

    return strip_python(F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n"))


def validity(text: Column, least: int = MIN_CONTENT) -> Column:
    """ok, or why a page is no content."""
    n = F.length(strip_python(text))
    return (
        F.when(F.contains(text, F.lit("Error 404")) | F.contains(text, F.lit("Document not found")), "404_error")
        .when(F.contains(text, F.lit("Jump to main content")) & (F.length(text) < least), "navigation_only")
        .when(n < least, F.concat(F.lit("too_short ("), n.cast("string"), F.lit(" chars)")))
        .otherwise("ok")
    )


def front_matter(text: Column) -> Column:
    """struct(head, body): the block between --- lines at the top, and the rest."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)
    has = text.rlike(r"(?s)^---\n(.*?)\n---\n?(.*)$")
    return F.struct(F.when(has, head).alias("head"), F.when(has, body).otherwise(text).alias("body"))


def valid_for(explicit: Column, semester: Column) -> Column:
    """Academic year: the given one, else from WS2026, WS2026/27 or SS2027 (2026/27 each), else ''."""
    given = F.trim(F.coalesce(explicit, F.lit("")))
    sem = F.upper(F.trim(F.coalesce(semester, F.lit(""))))
    kind = F.regexp_extract(sem, r"^(WS|SS)(\d{4})(?:/(\d{2,4}))?$", 1)
    year = F.regexp_extract(sem, r"^(WS|SS)(\d{4})(?:/(\d{2,4}))?$", 2).try_cast("int")
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    stated = missing(F.regexp_extract(sem, r"^(WS|SS)(\d{4})(?:/(\d{2,4}))?$", 3))
    derived = F.when(kind == "WS", F.concat(year.cast("string"), F.lit("/"), F.coalesce(stated, two(year + 1)))).when(kind == "SS", F.concat((year - 1).cast("string"), F.lit("/"), two(year))).otherwise("")
    return F.when(given != "", given).otherwise(derived)


def parent_id(source: Column, section: Column, content: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    return short_hash(F.concat_ws(":", none(source), none(section), F.substring(none(content), 1, 100)), 16)


def _without_blank_runs(text: Column) -> Column:
    return strip_python(F.regexp_replace(text, "\n{3,}", "\n\n"))


def sanitized_html(text: Column) -> Column:
    """Block tags and <br> become line ends, tags outside the allowed ones go, their content stays."""
    out = F.regexp_replace(text, rf"(?iU)</?(?:{'|'.join(BLOCK_TAGS)})(?:\s+[^>]*)?>", "\n")
    out = F.regexp_replace(out, r"(?iU)<br\s*/?>", "\n")
    tag = r"[\w-]*(?:\s+[^>]*)?/?>"
    out = F.regexp_replace(out, rf"(?iU)</?(?!(?:{'|'.join(ALLOWED_TAGS)})(?:\s+[^>]*)?/?>)\w{tag}", "")
    return _without_blank_runs(out)


def plain_text(text: Column) -> Column:
    """As sanitized_html, without any tags."""
    out = F.regexp_replace(text, r"(?iU)<br\s*/?>", "\n")
    out = F.regexp_replace(out, rf"(?iU)</?(?:{'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    return _without_blank_runs(F.regexp_replace(out, r"<[^>]+>", ""))


def cited_numbers(text: Column) -> Column:
    """Sorted distinct numbers of marks such as [1] and [2, 3]."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("int"))))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://\S+"), F.lit(0)))


def is_valid_answer(text: Column) -> Column:
    """At least three characters that are neither ASCII punctuation nor white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\p{Punct}\s]", "")) >= 3, F.lit(False))


def answer_and_suggestions(response: Column, apology: str) -> Column:
    """struct(answer, suggested): from the outermost {...}, parsed if it is JSON as a whole, else salvaged; other text as it is; the
    apology for a void answer."""
    whole = F.try_parse_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1))
    parsed = F.struct(F.try_variant_get(whole, "$.answer", "string").alias("answer"), F.try_variant_get(whole, "$.suggested_questions", "array<string>").alias("suggested_questions"))
    loose = F.regexp_extract(response, r'(?s)"answer"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    loose = F.replace(F.replace(F.replace(loose, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    listed = F.regexp_extract(response, r'(?s)"suggested_questions"\s*:\s*\[(.*?)(?:\]|$)', 1)
    suggestions = F.regexp_extract_all(listed, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    answer = F.when(parsed["answer"].isNotNull(), parsed["answer"]).when(F.length(loose) > 0, loose).otherwise(response)
    suggested = F.coalesce(parsed["suggested_questions"], suggestions)
    return F.struct(F.when(is_valid_answer(answer), answer).otherwise(F.lit(apology)).alias("answer"), suggested.alias("suggested"))


def faithfulness(response: Column) -> Column:
    """struct(is_faithful, unsupported_claims, reason): faithful unless the verdict says no or names claims."""
    body = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)(\{.*\})", 1)
    v = F.from_json(body, "is_faithful boolean, unsupported_claims array<string>, reason string")
    claims = F.coalesce(v["unsupported_claims"], F.array().cast("array<string>"))
    return F.struct((F.coalesce(v["is_faithful"], F.lit(True)) & (F.size(claims) == 0)).alias("is_faithful"), claims.alias("unsupported_claims"), F.coalesce(v["reason"], F.lit("")).alias("reason"))


def last_words(text: Column, n: int = 250) -> Column:
    """Text of n words at most: the last ones, marked by a leading '... '."""
    w = F.split(strip_python(text), r"(?U)[\s\x1c-\x1f]+")
    return F.when(F.size(w) > n, F.concat(F.lit("... "), F.concat_ws(" ", F.slice(w, -n, n)))).otherwise(text)


def summary_line(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("В: "), F.substring(question, 1, 150), F.lit(" | О: "), F.substring(answer, 1, 200))


def button_label(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def without_command(text: Column, command: str) -> Column:
    return strip_python(F.regexp_replace(text, rf"^/?{command}", ""))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """Template with {name} and {{ name }} replaced; null values as ''."""
    out = template
    for name, value in values.items():
        given = F.coalesce(value.cast("string"), F.lit(""))
        for mark in ("{{ %s }}" % name, "{{%s}}" % name, "{%s}" % name):
            out = F.replace(out, F.lit(mark), given)
    return out


def missing(text: Column) -> Column:
    """Null for '' too: what counts as missing in a chain of alternatives."""
    return F.nullif(text, F.lit(""))
