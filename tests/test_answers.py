from pyspark.sql import functions as F

from tamarack.functions import answers as A


def test_replies_and_fallbacks(spark):
    df = spark.createDataFrame([(0, '{"sub_questions": ["a", " "]}'), (1, '{"sub_questions": []}'), (2, "no"), (3, None), (4, '{"use_tool": true, "tool_name": "t", "arguments": {"x": "1"}}'), (5, '{"use_tool": true, "tool_name": "u"}'), (6, "It is a narrative question")], "i int, r string")
    rows = df.select("i", A.sub_questions(F.col("r"), F.lit("q")).alias("s"), A.tool_call(F.col("r"), ["t"]).alias("t"), A.query_type_of_reply(F.col("r"), F.lit("HYBRID")).alias("k"), A.or_else(F.col("r"), F.lit("f")).alias("o")).orderBy("i").collect()
    assert [r["s"] for r in rows][:4] == [["a"], ["q"], ["q"], ["q"]]
    assert rows[4]["t"]["arguments"] == {"x": "1"} and rows[5]["t"] is None and rows[2]["t"] is None
    assert rows[6]["k"] == "NARRATIVE" and rows[3]["k"] == "HYBRID" and rows[3]["o"] == "f"


def test_small_talk_is_stable(spark):
    df = spark.createDataFrame([("Привет",), ("Danke!",), ("пока",), ("ок",), (None,)], "q string")
    assert [r[0] for r in df.select(A.small_talk(F.col("q"))).collect()] == ["greeting", "thanks", "bye", "ok", "ok"]
    once = [r[0] for r in df.select(A.picked(["a", "b", "c"], F.col("q"))).collect()]
    assert once == [r[0] for r in df.select(A.picked(["a", "b", "c"], F.col("q"))).collect()] and set(once) <= {"a", "b", "c"}


def test_cards(spark):
    text = "📋 Bachelor\nSchool\nWinter\nSummer\nUniversität A\n1 May\n1 Nov\nother"
    assert A.cards(text, "School", ["School", "Winter", "Summer"], "Universität", ["📋 Bachelor"]) == "📋 Bachelor\n📍 Universität A\n• Раздел: Bachelor\n• Winter: 1 May\n• Summer: 1 Nov\n\nother"
    assert A.cards("plain", "School", ["School"], "x") == "plain"
    df = spark.createDataFrame([("a&nbsp;&nbsp;b  c",), (None,)], "t string")
    assert [r[0] for r in df.select(A.even_spacing("t")).collect()] == ["a b c", None]


def test_assertion_step(spark):
    long = "x" * 60
    rows = [(1, long, 2, '{"is_faithful": true}', None, None), (2, long, 2, '{"is_faithful": false}', "second", '{"is_faithful": true}'), (3, long, 2, '{"is_faithful": false}', None, None), (4, "short", 2, '{"is_faithful": false}', None, None), (5, long, 0, '{"is_faithful": false}', None, None)]
    df = spark.createDataFrame(rows, "i int, answer string, n_docs int, verdict string, second_answer string, second_verdict string")
    got = {r["i"]: r["final"] for r in A.asserted(df).collect()}
    assert got[1] == long and got[2] == "second" and A.CAUTION in got[3] and got[4] == "short" and got[5] == long


def test_wording_and_reports(spark):
    df = spark.createDataFrame([("Вы уже получили Zulassungsbescheid.", False), ("Вы уже получили Zulassungsbescheid.", True)], "a string, c boolean")
    got = [r[0] for r in df.select(A.unless_confirmed(F.col("a"), F.col("c"), {r"\bвы уже получили\s+zulassungsbescheid\b": "нужно получить Zulassungsbescheid"})).collect()]
    assert got == ["нужно получить Zulassungsbescheid.", "Вы уже получили Zulassungsbescheid."]
    row = spark.range(1).select(A.audit_section(F.lit("f.md"), F.lit("NEEDS_UPDATE"), F.array(F.lit("c")), F.array().cast("array<string>"), F.array(F.lit("d"))).alias("x"), A.with_sources(F.lit("a"), F.lit(" ")).alias("y"), A.context_with_tool(F.lit("t"), F.lit("{}"), F.lit("ctx")).alias("z")).first()
    assert row["x"].startswith("## ⚠️ f.md\n") and "- c" in row["x"] and row["y"] == "a" and row["z"] == "[t]\n{}\n\nctx"


def test_suggested_question(spark):
    asked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 5, 0)], "tg_id int, message_id int, index int")
    by = spark.createDataFrame([(1, 10, ["m"])], "tg_id int, message_id int, questions array<string>")
    latest = spark.createDataFrame([(1, ["x", "l"])], "tg_id int, questions array<string>")
    stored = spark.createDataFrame([(2, ["s"])], "tg_id int, questions array<string>")
    got = {(r["tg_id"], r["message_id"]): r["question"] for r in A.suggested(asked, by, latest, stored).collect()}
    assert got == {(1, 10): "m", (1, 11): "l", (2, 5): "s"}
