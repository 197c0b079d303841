"""Facts of files: cards, counts."""

import collections
import glob
import os

import pytest
import yaml

from tamarack.operators import facts as Y

FACTS = os.environ.get("FACTS_DIR", "")


def test_university_shape():
    got = Y.facts_of({"id": "u", "name": {"de": "Uni", "ru": "Уни"}, "city": "Wien", "website": "https://u.example", "quotas": {"medicine": {"total_places": 7}, "distribution_process": {"a": 1}, "quota_determination": {"b": 2}}})
    assert [(f["fact_type"], f["fact_key"]) for f in got] == [("quota", "medicine"), ("general_info", "")]
    assert got[1]["content"] == "[Информация: Uni (u)]\nГород: Wien\nСайт: https://u.example" and got[1]["source_url"] == "https://u.example"
    assert got[0]["content"] == "[Квоты/Места: Uni - medicine]\nВсего мест: 7"


def test_tariff_total():
    got = Y.facts_of({"tariffs": {"a": {"studienbeitrag": 363.36}, "b": {"notes": "x"}, "c": {"total": 1}}})
    assert ["Итого: €388.56/" in got[0]["content"], "Итого: €25.2/" in got[1]["content"], "Итого: €1/" in got[2]["content"]] == [True, True, True]


def test_cards():
    content = {
        "id": "u", "name": {"en": "Uni"}, "source_urls": ["https://first.example"],
        "deadlines": [{"semester": "SS2027", "submission_deadline": "1 May", "level": ["bachelor", "master"]}, {"submission": {"start": 1}, "submission_deadline": "no", "valid_for": "2030/31", "source_url": "https://own.example"}, "no mapping"],
        "language_requirements": {"german": {"submission_minimum": "A2", "certificates": {"b2": ["x", "y"], "c1": None}}, "english": {"certificates": [{"name": "T", "min_score": 79}, "plain"]}},
        "quotas": {"source_url": "https://q.example", "m": {"total_places": 9, "eu": {"percentage": 20, "condition": "c"}, "extra_places": 3, "note": "n"}},
        "key_dates_2026": {"registration_fee": 110, "critical_notes": ["now"]},
    }
    got = Y.facts_of(content)
    assert [f["content"] for f in got[:5]] == [
        "[Дедлайн: Uni (u)]\nСеместр: SS2027\nКатегория: all\nУровни: bachelor, master\nДедлайн подачи: 1 May\n(актуально для приёма 2026/27)",
        "[Дедлайн: Uni (u)]\nСеместр: Unknown\nКатегория: all\nПодача: 1 — ?\n(актуально для приёма 2030/31)",
        "[Требования к немецкому: Uni (u)]\nДля подачи: A2\n  b2: x, y",
        "[Требования к английскому: Uni (u)]\n  - T: 79\n  - plain",
        "[Квоты/Места: Uni - m]\nВсего мест: 9\neu: 20% (? мест)\n  Условие: c\nextra_places: 3",
    ]
    assert got[5]["content"] == "[Ключевые даты 2026: Uni]\nСтоимость регистрации: €110\n⚠️ now\n(актуально для приёма 2026/27)"
    assert [f["source_url"] for f in got[:2]] == ["https://first.example", "https://own.example"] and got[4]["source_url"] == "https://q.example"
    other = Y.facts_of({"id": "l", "gotchas": {"g": {"description": "text"}}, "certificates": {"a2": [{"cost": 5, "from_russia": True}]}, "exemptions": {"e": {"russia_eligible": False}}, "locations": {"v": {"cost_options": [{"hours": "20"}]}}})
    assert [f["content"] for f in other] == [
        "[Важно: g]\nУровень важности: high\ntext", "[Сертификат: ? (уровень a2)]\nСтоимость: 5\nИз России: Да", "[VWU: v]\n  20: €?", "[Освобождение: e]\nДля граждан России: Нет",
    ]
    assert Y.facts_of({"deadlines": "no list", "name": {}}) == [{"fact_type": "general_info", "fact_key": "", "title": "", "content": "[Информация:  ()]", "source_url": None, "valid_for": ""}]


@pytest.mark.skipif(not os.path.isdir(FACTS), reason="no fact files here")
def test_counts_of_the_survey():
    files = glob.glob(f"{FACTS}/**/*.yaml", recursive=True)
    n = collections.Counter(f["fact_type"] for p in files for f in Y.facts_of(yaml.safe_load(open(p, encoding="utf-8"))))
    assert n == {"deadline": 26, "tuition": 30, "language_requirement": 18, "quota": 2, "contact": 30, "key_dates": 1, "general_info": 10, "gotcha": 5, "certificate": 20, "vwu_location": 6, "tuition_tariff": 11, "tuition_exemption": 4}
