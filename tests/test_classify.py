import re

from pyspark.sql import functions as F

from tamarack.functions import classify as K
from tamarack.functions import lexicons as X

QUESTIONS = [
    "Привет!", "спасибо большое", "Какой мой прогресс?", "что дальше делать?", "Сколько стоит жизнь, какой бюджет на месяц?", "сколько дней до подачи", "Когда подавать документы?", "успею подать?", "Какие документы нужны?",
    "какие мои документы нужны", "Что такое нострификация?", "How to apply step by step", "TU Wien tuition fee", "Какой уровень немецкого B2 для Uni Wien?", "дедлайн и как подать заявку", "", None, "ничего особенного", "ДЕДЛАЙН для бакалавра",
    "non-eu quota 5%", "лучше ли WU Wien, плюсы и минусы", "виза", "сколько мест и квота, как подготовиться",
]


def brute_intent(q):
    q = (q or "").lower().strip()
    hit = lambda ps: any(re.search(p, q) for p in ps)
    if hit(X.CHITCHAT):
        return "CHITCHAT", [], 0.95
    if hit(X.PERSONAL):
        return "TOOL_ONLY", [t for t, p in X.PERSONAL_TOOLS if re.search(p, q)] or ["get_my_progress", "get_next_steps"], 0.9
    if hit(X.CALCULATOR):
        return ("TOOL_THEN_RAG", ["calculate_budget"], 0.8) if hit(X.BUDGET) else ("TOOL_ONLY", ["calculate_days_until"], 0.85) if hit(X.DATE_MATH) else ("RAG_ONLY", [], 0.85) if hit(X.DEADLINE) else ("RAG_ONLY", [], 0.6)
    if hit(X.DOCUMENT):
        return ("TOOL_THEN_RAG", ["get_my_progress"], 0.8) if re.search(X.MINE, q) else ("RAG_ONLY", [], 0.75)
    return "RAG_ONLY", [], 0.85 if hit(X.KNOWLEDGE) else 0.5


def brute_type(q):
    q = (q or "").lower().strip()
    if not q:
        return "NARRATIVE", 0.5
    count = lambda ps: sum(len(list(re.finditer(p, q, re.I))) for p, _ in ps)
    f, n = count(X.FACT), count(X.NARRATIVE)
    unis = [u for u, ps in X.UNIVERSITIES.items() if any(re.search(p, q, re.I) for p in ps)]
    why = {c for p, c in X.NARRATIVE if re.search(p, q, re.I)}
    if unis and f and not n:
        f += 1.5
    if f and n:
        if why <= {"explanation"}:
            return "FACT", min(0.9, 0.65 + 0.1 * f)
        if f > 2 * n:
            return "FACT", min(0.9, 0.6 + 0.1 * f)
        return ("NARRATIVE", min(0.9, 0.6 + 0.1 * n)) if n > 2 * f else ("HYBRID", 0.7)
    if f:
        return ("HYBRID", 0.65) if re.search(X.CONNECTOR, q, re.I) else ("FACT", min(0.95, 0.7 + 0.1 * f))
    return ("NARRATIVE", min(0.95, 0.7 + 0.1 * n)) if n else ("HYBRID", 0.5)


def test_routers_match_brute_force(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "i int, q string")
    rows = df.select("i", K.route_intent(F.col("q")).alias("r"), K.classify_query(F.col("q")).alias("t")).collect()
    for row in rows:
        q = QUESTIONS[row["i"]]
        intent, tools, confidence = brute_intent(q)
        assert (row["r"]["intent"], row["r"]["tools"], row["r"]["confidence"]) == (intent, tools, confidence), q
        kind, c = brute_type(q)
        assert row["t"]["query_type"] == kind and abs(row["t"]["confidence"] - c) < 1e-9, q


def test_focus_tags_and_boost(spark):
    df = spark.createDataFrame([("общежитие и столовая", "housing"), ("vegan canteen", None), (None, "")], "t string, e string")
    rows = df.select(K.entity_focus(F.col("t")).alias("f"), K.tags(F.col("t"), F.col("e")).alias("g"), K.topic(F.col("t")).alias("o"), K.mood(F.col("t")).alias("m")).collect()
    assert [r["f"] for r in rows] == ["housing", "food", None]
    assert "housing:dormitory" in rows[0]["g"] and "entity:housing" in rows[0]["g"] and rows[2]["g"] == []
    assert rows[0]["o"] == "housing" and rows[2]["o"] is None and rows[2]["m"] == "calm"
    sets = [(["a"], ["a"], 1.5), (["a"], ["a", "b"], 1.5), (["a"], ["a", "b", "c"], 1 + 1 / 3), (["x"], ["a"], 1.0), ([], ["a"], 1.0), (["a"], [], 1.0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(sets)], "i int, a array<string>, b array<string>").select("i", K.tag_boost(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        assert abs(r["x"] - sets[r["i"]][2]) < 1e-9


def test_entities(spark):
    text = "до 15 март, Uni Wien и TU Graz, сертификат B2; 01.09.2026, дедлайн 15.03"
    rows = {(r["entity_type"], r["entity_value"]) for r in spark.createDataFrame([(text,)], "t string").select(F.inline(K.entities(F.col("t")))).collect()}
    assert ("university", "Uni Wien") in rows and ("deadline", "01 09 2026") in rows and ("language_level", "B2") in rows and ("document", "сертификат") in rows


def test_entities_without_case_and_under_one_name(spark):
    text = "Дедлайн 15.07.2026. До 5 мая подать, в Вене или Uni Wien, Бакалавр с b2"
    rows = [(r["entity_type"], r["entity_value"]) for r in spark.createDataFrame([(text,)], "t string").select(F.inline(K.entities(F.col("t")))).collect()]
    assert [v for k, v in rows if k == "deadline"] == ["15 07 2026", "5 ма", "15.07.2026"] or len([v for k, v in rows if k == "deadline"]) == 3
    assert ("city", "Vienna") in rows and ("university", "Uni Wien") in rows and ("program", "bachelor") in rows and ("language_level", "B2") in rows
    assert rows.count(("city", "Vienna")) == 1


def test_reported_facts(spark):
    said = {"Zulassungsbescheid уже есть": {"zulassungsbescheid": "done"}, "Пока не получил Zulassungsbescheid": {"zulassungsbescheid": "not_done"}, "Что такое Zulassungsbescheid?": {}, "получил письмо": {}, None: {}}
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", K.reported_facts(F.col("t")).alias("f"))
    assert {r["t"]: r["f"] for r in df.collect()} == said


def test_block_tags_and_letter_lines(spark):
    from tamarack.functions import text as T

    df = spark.createDataFrame([("<section>один</section><td>два</td><details open>x</details>", "Überschrift.\n  kurz und gut. \nMit Zahl 5.\nend\n")], "h string, l string")
    r = df.select(T.sanitized_html(F.col("h")).alias("h"), T.plain_text(F.col("h")).alias("p"), T.drop_letter_lines(F.col("l")).alias("l")).first()
    assert r["h"] == r["p"] == "один\n\nдва\n\nx" and r["l"] == "Mit Zahl 5.\nend"
