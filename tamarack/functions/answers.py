"""What model replies become: parsed choices with their fallbacks, checked answers, tables as cards."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamarack.functions import text as T

# Kinds of small talk, tried in this order.
SMALL_TALK = {
    "greeting": r"(привет|здравствуй|добр|хай|хей|hello|hi|hey)",
    "thanks": r"(спасибо|благодар|thanks|thank|данке|danke)",
    "bye": r"(пока|до свидания|bye|чао|ciao)",
}
CAUTION = "⚠️ "


def or_else(reply: Column, fallback: Column) -> Column:
    """The reply, stripped, or the fallback for a blank or missing one."""
    return F.coalesce(T.missing(T.strip_python(reply)), fallback)


def sub_questions(reply: Column, question: Column) -> Column:
    """Questions of {"sub_questions": [...]}; the question itself without usable ones."""
    found = F.from_json(reply, "sub_questions array<string>")["sub_questions"]
    usable = F.filter(found, lambda q: F.length(F.trim(q)) > 0)
    return F.when(F.size(usable) > 0, usable).otherwise(F.array(question))


def query_type_of_reply(reply: Column, fallback: Column) -> Column:
    """FACT, NARRATIVE or HYBRID as the reply names them; the fallback without a reply."""
    up = F.upper(reply)
    return F.when(T.missing(F.trim(reply)).isNull(), fallback).when(F.contains(up, F.lit("FACT")), "FACT").when(F.contains(up, F.lit("NARRATIVE")), "NARRATIVE").otherwise("HYBRID")


def tool_call(reply: Column, known: Sequence[str]) -> Column:
    """struct(tool_name, arguments) of {"use_tool": true, ...}; null for no use, unknown tools and what isn't JSON."""
    v = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "use_tool boolean, tool_name string, arguments map<string,string>")
    return F.when(v["use_tool"] & v["tool_name"].isin(*known), F.struct(v["tool_name"].alias("tool_name"), v["arguments"].alias("arguments")))


def small_talk(question: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    out = F.lit("ok")
    for kind, pattern in reversed(list(SMALL_TALK.items())):
        out = F.when(q.rlike("(?iU)" + pattern), F.lit(kind)).otherwise(out)
    return out


def picked(options: Sequence[str], key: Column) -> Column:
    """One of the options, the same for the same key."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(key), F.lit(len(options))).cast("int"))


def embedding_key(text: Column, dims: int | None = None) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(f"_t{dims}" if dims else ""))


def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def even_spacing(text: Column | str) -> Column:
    """Entities decoded, hard and narrow blanks made plain, runs of blanks made one. Only texts with an & meet Python."""
    text = F.col(text) if isinstance(text, str) else text
    decoded = F.when(F.contains(text, F.lit("&")), F.pandas_udf(_unescaped, StringType())(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)
    return F.regexp_replace(F.translate(decoded, "\u00a0\u202f", "  "), r"[ \t]{2,}", " ")


def cards(text: str, trigger: str, headers: Sequence[str], row_start: str, sections: Sequence[str] = ()) -> str:
    """Table rows that were flattened to a name line and one line per column, as cards.

    headers: the column titles, the first of which names the rows; a row is a line that matches row_start followed by a line for
    each other column. Texts without the trigger stay as they are.
    """
    if trigger not in text:
        return text
    lines = [x.strip() for x in text.splitlines()]
    columns, section, out, i = list(headers[1:]), "", [], 0
    while i < len(lines):
        x, values = lines[i], lines[i + 1 : i + 1 + len(columns)]
        if x in headers:
            i += 1
        elif x and re.search(row_start, x) and len(values) == len(columns) and all(v and v not in headers for v in values):
            out += [f"📍 {x}", *([f"• Раздел: {section}"] if section else []), *(f"• {c}: {v}" for c, v in zip(columns, values)), ""]
            i += 1 + len(columns)
        else:
            section = x.lstrip("📋 ") if x in sections else section
            out.append(x)
            i += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def as_cards(column: Column, trigger: str, headers: Sequence[str], row_start: str, sections: Sequence[str] = ()) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else cards(t, trigger, headers, row_start, sections)), StringType())(column)


def unless_confirmed(answer: Column, confirmed: Column, wording: Mapping[str, str]) -> Column:
    """Claims (patterns) put into neutral words where they aren't confirmed."""
    out = answer
    for pattern, neutral in wording.items():
        out = F.regexp_replace(out, "(?iU)" + pattern, neutral)
    return F.when(F.coalesce(confirmed, F.lit(False)), answer).otherwise(out)


def with_sources(answer: Column, sources: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(sources, F.lit("")))) > 0, F.concat(answer, F.lit("\n\n📎 Источники:\n"), sources)).otherwise(answer)


def with_disclaimer(answer: Column, warnings: Column) -> Column:
    return F.when(F.size(warnings) > 0, F.concat(F.lit(CAUTION), F.array_join(warnings, "; "), F.lit("\n\n"), answer)).otherwise(answer)


def context_with_tool(tool: Column, result: Column, context: Column) -> Column:
    """Result of a tool as a block before the found context."""
    block = F.concat(F.lit("["), tool, F.lit("]\n"), result)
    return F.when(result.isNull(), context).otherwise(F.concat_ws("\n\n", block, T.missing(context)))


def asserted(answers: DataFrame, least: int = 50) -> DataFrame:
    """Final answer of (answer, n_docs, verdict, second_answer, second_verdict), verdicts being replies of a judge.

    Answers without chunks or shorter than least aren't judged; an unfaithful one gives way to the second if that is faithful,
    else the second (or the first, without one) carries a caution.
    """
    judged = (F.col("n_docs") > 0) & (F.length("answer") >= least)
    first, second = T.faithfulness(F.col("verdict"))["is_faithful"], T.faithfulness(F.col("second_verdict"))["is_faithful"]
    cautious = F.concat(F.coalesce("second_answer", "answer"), F.lit("\n\n" + CAUTION), F.lit("Проверьте эти сведения в первоисточнике."))
    final = F.when(~judged | first, F.col("answer")).when(F.col("second_answer").isNotNull() & second, F.col("second_answer")).otherwise(cautious)
    return answers.withColumn("final", final).withColumn("regenerated", judged & ~first & F.col("second_answer").isNotNull())


def rerank_policy(n_docs: Column, k: int, provider_enabled: bool) -> Column:
    """none for lists that fit, else by an interface or by a model."""
    return F.when(n_docs <= k, "none").otherwise("api" if provider_enabled else "llm")


def audit_section(file: Column, status: Column, changes: Column, additions: Column, deletions: Column) -> Column:
    """Part of an audit report in Markdown: one file, its state and three lists."""
    icon = F.when(status == "UP_TO_DATE", "✅").when(status == "NEEDS_UPDATE", "⚠️").otherwise("❌")

    def bullets(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n**{title}**\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))

    return F.concat_ws("\n", F.concat(F.lit("## "), icon, F.lit(" "), file), bullets("Changes", changes), bullets("Additions", additions), bullets("Deletions", deletions))


def suggested(asked: DataFrame, by_message: DataFrame, latest: DataFrame, stored: DataFrame) -> DataFrame:
    """Question behind a button: of the message, else the latest of the user, else the stored one."""
    out = asked.join(by_message.withColumnRenamed("questions", "__a"), ["tg_id", "message_id"], "left")
    out = out.join(latest.withColumnRenamed("questions", "__b"), "tg_id", "left").join(stored.withColumnRenamed("questions", "__c"), "tg_id", "left")
    return out.withColumn("question", F.get(F.coalesce("__a", "__b", "__c"), F.col("index"))).drop("__a", "__b", "__c")
