"""Fact files (YAML) to chunks: one row per fact, its text out of the card of its type.

A card is a table of lines with places for values. A line whose place has nothing to show, and no other word for that, is left out.
What a card says stands in CARDS as data; this module only fills it in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.operators.ingest import parse_yaml


@dataclass(frozen=True)
class Card:
    """section: where the facts stand in a file; shape: list of mappings, mapping of mappings, of lists of mappings, or one mapping.

    Lines are templates. {a.b} shows a value, {a/c} the first of two, {a|x} the value or x; {^a} looks in the mapping around. A pair
    (path, templates) repeats for each entry below path: the first template for mappings, a second one for plain values ({value}).
    A list of templates gives its first line that can be filled. A line that begins with "path? " needs a mapping there.
    """

    section: str
    shape: str
    head: str
    lines: tuple
    title: str
    dated: str | None = None  # the semester that decides the academic year, as a template; None for facts without one
    skipped: tuple[str, ...] = ()


# The wording of each type of fact.
UNIVERSITY_CARDS = {
    "deadline": Card(
        "deadlines", "list", "[Дедлайн: {uni} ({id})]",
        (
            "Семестр: {semester|Unknown}", "Категория: {category|all}", "Уровни: {level}", ["submission? Подача: {submission.start|?} — {submission.end|?}", "Дедлайн подачи: {submission_deadline}"],
            "enrollment? Зачисление: {enrollment.start|?} — {enrollment.end|?}", "Примечание: {notes}",
        ),
        "Дедлайн {uni}", "{semester|}",
    ),
    "tuition": Card(
        "tuition", "list", "[Стоимость обучения: {uni} ({id})]",
        (
            "Категория: {category|unknown}", "Studienbeitrag: {amount|0} {currency|EUR}/{period|semester}", ("additional", ("  + {name|?}: {amount|?} {^currency|EUR}",)),
            ["Итого: {total} {currency|EUR}/{period|semester}", "Итого: {amount|0} {currency|EUR}/{period|semester}"], "Примечание: {notes}",
        ),
        "Стоимость {uni}", "",
    ),
    "german": Card(
        "language_requirements.german", "one", "[Требования к немецкому: {uni} ({id})]",
        (
            "Для подачи: {for_registration/submission_minimum}", "Для зачисления: {for_enrollment/enrollment}", "Прямое зачисление: {direct_admission}", ["certificates? ", "Сертификаты: {certificates}"],
            ("certificates", ("  {key}: {value}",)), "Срок действия сертификата: {certificate_validity_years} года/лет", "Примечание: {notes}",
        ),
        "Немецкий для {uni}",
    ),
    "english": Card(
        "language_requirements.english", "one", "[Требования к английскому: {uni} ({id})]",
        ("Требуется для: {required_for}", "Минимальный уровень: {min_level}", ("certificates", ("  - {name|?}: {min_score|}", "  - {value}")), "Примечание: {notes}"),
        "Английский для {uni}",
    ),
    "quota": Card(
        "quotas", "map", "[Квоты/Места: {uni} - {key}]",
        ("Всего мест: {total_places}", ("", ("{key}: {percentage|?}% ({places|?} мест)\n  Условие: {condition}", "{key}: {value}"))),
        "Квоты {uni}", skipped=("source_url", "last_verified", "distribution_process", "quota_determination"),
    ),
    "contact": Card(
        "contacts", "map", "[Контакты: {uni} - {key}]",
        ("Отдел: {name|{key}}", "Адрес: {address}", "Email: {email}", "Телефон: {phone}", "Сайт: {website}", "Часы работы: {hours}"),
        "Контакты {uni}",
    ),
    "key_dates": Card(
        "key_dates_2026", "one", "[Ключевые даты 2026: {uni}]",
        (
            "Открытие регистрации: {registration_open}", "Дедлайн регистрации: {registration_deadline}", "Стоимость регистрации: €{registration_fee}", "Дата MedAT: {medat_date}", "Результаты: {results}",
            ("critical_notes", ("⚠️ {value}", "⚠️ {value}")),
        ),
        "Ключевые даты {uni} 2026", "WS2026/27",
    ),
    "general_info": Card(
        "", "one", "[Информация: {uni} ({id})]",
        ("Город: {city}", "Сайт: {website}", "Студентов: {students_count}", "Основан: {founded}", "Описание: {description}"),
        "{uni}",
    ),
}
OTHER_CARDS = {
    "gotcha": Card("gotchas", "map", "[Важно: {title|{key}}]", ("Уровень важности: {severity|high}", "{description}", "Рекомендация: {recommendation}"), "{title|{key}}"),
    "certificate": Card(
        "certificates", "map of lists", "[Сертификат: {name|?} (уровень {key})]",
        ("Организация: {organization}", "Стоимость: {cost_range/cost}", "Из России: {from_russia}", "Примечание: {notes}"), "Сертификат {name|?}",
    ),
    "vwu_location": Card(
        "locations", "map", "[VWU: {name|{key}}]",
        ("Полное название: {full_name}", "Стоимость: €{cost_per_semester}/семестр", "Стоимость: {cost_range}", ("cost_options", ("  {hours|?}: €{cost|?}",)), "Примечание: {notes}", "⚠️ {warning}"), "{name|{key}}",
    ),
    "tuition_tariff": Card("tariffs", "map", "[Тариф: {key}]", ("Studienbeitrag: €{studienbeitrag|0}", "ÖH-Beitrag: €{oeh_beitrag|25.2}", "Итого: €{total}/семестр", "Примечание: {notes}"), "Тариф {key}"),
    "tuition_exemption": Card("exemptions", "map", "[Освобождение: {key}]", ("{description}", "Условие: {condition}", "Для граждан России: {russia_eligible}"), "Освобождение {key}"),
}
KINDS = {"german": "language_requirement", "english": "language_requirement"}
OEH = 25.2  # fee of the students' union where a tariff states none
YEAR_LINE = "(актуально для приёма {})"

_PLACE = re.compile(r"\{([^{}|]*)(?:\|((?:[^{}]|\{[^{}]*\})*))?\}")
_SEMESTER = re.compile(r"(WS|SS)(\d{4})(?:/(\d{2,4}))?", re.IGNORECASE)


def shown(value) -> str:
    if isinstance(value, bool):
        return "Да" if value else "Нет"
    return ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def found(path: str, scopes: list[Mapping]):
    """Value of the first of the paths that has one, in the innermost scope, or with ^ in the one around it."""
    for one in path.split("/"):
        value = scopes[-2] if one.startswith("^") else scopes[-1]
        for step in one.lstrip("^").split("."):
            value = value.get(step) if isinstance(value, Mapping) else None
        if value or value is False or (value == 0 and "/" not in path):
            return value
    return None


def filled(template: str, scopes: list[Mapping], fixed: Mapping[str, str]) -> str | None:
    """The line, or None if it has a place without value and without another word for that. 0 counts as a value where there is one."""
    need = re.match(r"([\w.]+)\? ", template)
    if need:
        if not isinstance(found(need.group(1), scopes), Mapping):
            return None
        template = template[need.end() :]

    class Empty(Exception):
        pass

    def value(m: re.Match) -> str:
        path, otherwise = m.group(1), m.group(2)
        v = fixed.get(path)
        v = found(path, scopes) if v is None else v
        if v is None or (otherwise is None and v == 0 and v is not False):
            if otherwise is None:
                raise Empty
            return filled(otherwise, scopes, fixed) or ""
        return shown(v)

    try:
        return _PLACE.sub(value, template)
    except Empty:
        return None


def lines_of(lines: tuple, scopes: list[Mapping], fixed: Mapping[str, str]) -> Iterator[str]:
    for line in lines:
        if isinstance(line, str):
            text = filled(line, scopes, fixed)
        elif isinstance(line, list):
            text = next((t for x in line if (t := filled(x, scopes, fixed)) is not None), None)
        else:
            yield from repeated(line[0], line[1], scopes, fixed)
            continue
        if text:
            yield text


def repeated(path: str, templates: tuple, scopes: list[Mapping], fixed: Mapping[str, str]) -> Iterator[str]:
    """Lines for the entries below a path. Entries of the fact itself (no path) are those that describe places."""
    below = found(path, scopes) if path else scopes[-1]
    entries = below.items() if isinstance(below, Mapping) else [("", v) for v in below] if isinstance(below, list) else []
    for key, v in entries:
        if not path and (key == "total_places" or not (isinstance(v, Mapping) or key.endswith("_places"))):
            continue
        if isinstance(below, Mapping) and path and not v:
            continue
        # a mapping shows its own values unless the template asks for the entry as a whole
        template = templates[0] if isinstance(v, Mapping) or isinstance(below, Mapping) and path else templates[1] if len(templates) > 1 else None
        if template is None:
            continue
        inner = v if isinstance(v, Mapping) else {}
        for part in template.split("\n"):
            text = filled(part, [*scopes, inner], fixed | {"key": key} | ({} if isinstance(v, Mapping) else {"value": shown(v)}))
            if text is not None:
                yield text


def academic_year(explicit, semester) -> str:
    """The stated year, else that of a semester: WS2026, WS2026/27 and SS2027 belong to 2026/27."""
    if explicit:
        return str(explicit)
    m = _SEMESTER.match(str(semester).strip()) if semester else None
    if not m:
        return ""
    year = int(m.group(2))
    if m.group(1).upper() == "SS":
        return f"{year - 1}/{year % 100:02d}"
    return f"{year}/{m.group(3) or format((year + 1) % 100, '02d')}"


def entries_of(card: Card, content: Mapping) -> Iterator[tuple[str, Mapping]]:
    """(key, fact) of a card's section; what has another shape is passed over."""
    below = content
    for step in filter(None, card.section.split(".")):
        below = below.get(step) if isinstance(below, Mapping) else None
    if card.shape == "one":
        own = [("", below)] if below else []
    elif card.shape == "list":
        own = [(str(i), v) for i, v in enumerate(below)] if isinstance(below, list) else []
    else:
        own = [(str(k), v) for k, v in below.items()] if isinstance(below, Mapping) else []
    if card.shape == "map of lists":
        own = [(f"{k}.{i}", v) for k, each in own if isinstance(each, list) for i, v in enumerate(each)]
    for key, v in own:
        if isinstance(v, Mapping) and key not in card.skipped:
            yield key, v


def facts_of(content: dict) -> list[dict]:
    """Facts of a file: type, key, title, text, address and academic year. A file whose name is a mapping of languages is a university's."""
    names = content["name"] if isinstance(content.get("name"), dict) else None
    uni = next((str(v) for v in [*((names or {}).get(k) for k in ("de", "en", "ru")), content.get("id")] if v), "")
    listed = content.get("source_urls")
    first = listed[0] if isinstance(listed, list) and listed else ""
    out = []
    for name, card in (UNIVERSITY_CARDS if names is not None else OTHER_CARDS).items():
        for key, fact in entries_of(card, content):
            if name == "tuition_tariff" and fact.get("total") is None:
                fact = fact | {"total": round((fact.get("studienbeitrag") or 0) + (OEH if fact.get("oeh_beitrag") is None else fact["oeh_beitrag"]), 2)}
            fixed = {"uni": uni, "id": str(content.get("id") or ""), "key": key.split(".")[0]}
            scopes = [content, fact]
            semester = None if card.dated is None else filled(card.dated, scopes, fixed)
            year = academic_year(fact.get("valid_for"), semester) if card.dated is not None else ""
            lines = [filled(card.head, scopes, fixed), *lines_of(card.lines, scopes, fixed), *([YEAR_LINE.format(year)] if year else [])]
            url = {"quota": content.get("quotas", {}).get("source_url") if isinstance(content.get("quotas"), dict) else None, "general_info": content.get("website"), "deadline": fact.get("source_url", first)}.get(name, fact.get("source_url"))
            out.append({"fact_type": KINDS.get(name, name), "fact_key": name if name in KINDS else key, "title": filled(card.title, scopes, fixed), "content": "\n".join(x for x in lines if x), "source_url": url, "valid_for": year})
    return [{k: None if v is None else str(v) for k, v in f.items()} for f in out]


def fact_chunks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(source, fact_type, fact_key, title, content, source_url, valid_for, entity_type, is_yaml_fact); a file that can't be read has no rows."""
    names = ["source", "fact_type", "fact_key", "title", "content", "source_url", "valid_for"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"source": p, **fact} for p, c in zip(f["p"], f["c"]) if (y := parse_yaml(c)) for fact in facts_of(y)]
            yield pd.DataFrame(rows, columns=names)

    rows = files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, ", ".join(f"{n} string" for n in names))
    return rows.select(*names, K.fact_entity_type(F.col("fact_type"), F.lit(""), F.col("source")).alias("entity_type"), F.lit(True).alias("is_yaml_fact"))


def unreadable(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files that hold no YAML mapping."""
    from tamarack.operators.ingest import yaml_json

    return files.where(yaml_json(F.col(content)).isNull()).select(path)
