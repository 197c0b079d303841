from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import chunk as C
from tamarack.operators import facts as Y
from tamarack.operators import ingest as I


def test_markdown_headings_and_addresses():
    body = "# Top\n" + "x" * 40 + "\n## A\n<!-- url: https://a.example -->\n" + "y" * 40 + "\n## B\n" + "z" * 40 + "\n### C\n" + "w" * 29
    out = C.markdown_chunks(body, file="dir/some-file.md", university="U", source_url="https://s.example | https://t.example")
    assert [c["section_path"] for c in out] == ["", "A", "B", "B > C"]
    assert [c["source_url"] for c in out] == ["https://s.example", "https://a.example", "https://a.example", "https://a.example"]
    assert out[0]["title"] == "Top" and out[1]["content"].startswith("[Университет: U | Раздел: A]\n")
    assert C.markdown_chunks("short", file="a-b.md") == []


def test_long_section_keeps_tables_whole():
    table = "\n".join(f"| row {i} | value |" for i in range(120))
    assert any(table in p for p in C.long_section("Intro text.\n\n" + table + "\n\nEnd.", 800))
    parts = C.long_section("Sentence one is here. " * 200, 200, 50)
    assert len(parts) > 2 and all(len(p) < 500 for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n|", max_size=3000))
def test_chunkers_take_any_text(text):
    for p in C.long_section(text, 100, 20):
        assert p.strip() == p
    for parent, children in C.parents_of(text, drop_short=False):
        assert len(parent) >= 0 and all(len(c) <= 400 or ". " not in c for c in children)


def test_parent_child_golden():
    assert C.parents_of("A text of 26 characters...") == [("A text of 26 characters...", ["A text of 26 characters..."])]
    sections = "\n\n".join("s" * 900 for _ in range(5))
    assert [len(p) for p, _ in C.parents_of(sections)] == [900] * 5
    assert C.parents_of("a" * 1000 + "\n\n" + "b" * 700) == [("a" * 1000, ["a" * 1000])]


def test_parent_child_rows(spark):
    df = spark.createDataFrame([(1, "para one.\n\npara two."), (2, None), (3, "")], "id int, content string")
    rows = sorted(C.parent_child(df).collect(), key=lambda r: (r["key"], r["pos"]))
    assert [(r["key"], r["is_parent"], r["child_index"]) for r in rows][:2] == [("1", True, None), ("1", False, 0)]
    assert len(rows[0]["parent_id"]) == 16


def test_html_and_blocks():
    page = "<html><header>H</header><div class='cookie-bar'>C</div><main><h2>Title</h2><p>Text <b>bold</b></p><ul><li>one</li></ul></main><footer>F</footer></html>"
    assert I.html_text(page) == "## Title\nText\nbold\n- one"
    assert I.html_text(None) == ""
    lines = "\n".join(["a", "b", "c", "d", "x", "a", "b", "c", "d", "y"])
    assert I.without_repeated_blocks(lines) == "a\nb\nc\nd\nx\ny"
    assert I.without_repeated_blocks("a\nb") == "a\nb"


def test_text_functions(spark):
    df = spark.createDataFrame([("---\ntitle: x\n---\nbody", "WS2026", '{"answer": "Да, можно", "suggested_questions": ["a"]}', "см. [1] и [2, 3]")], "t string, s string, j string, c string")
    r = df.select(
        T.front_matter(F.col("t")).alias("f"), T.valid_for(F.lit(None).cast("string"), F.col("s")).alias("v"), T.valid_for(F.lit(None).cast("string"), F.lit("SS2027")).alias("w"), T.answer_and_suggestions(F.col("j"), "sorry").alias("a"),
        T.cited_numbers(F.col("c")).alias("n"), T.answer_and_suggestions(F.lit('{"answer": "..."}'), "sorry").alias("x"), T.sanitized_html(F.lit("<h1>A</h1><b>k</b><script>z</script><br/>q")).alias("h"), T.last_words(F.lit("a b c d"), 2).alias("l"),
        T.faithfulness(F.lit('{"is_faithful": true, "unsupported_claims": ["x"]}')).alias("g"), T.faithfulness(F.lit("none")).alias("k"),
    ).first()
    assert r["f"]["head"] == "title: x" and r["f"]["body"] == "body" and r["v"] == "2026/27" and r["w"] == "2026/27"
    assert r["a"]["answer"] == "Да, можно" and r["a"]["suggested"] == ["a"] and r["n"] == [1, 2, 3] and r["x"]["answer"] == "sorry"
    assert r["h"] == "A\n<b>k</b>z\nq" and r["l"] == "... c d" and not r["g"]["is_faithful"] and r["k"]["is_faithful"]


FACTS = """
id: u1
name:
  de: Uni Test
deadlines:
  - semester: WS2026
    category: EU
    level: [bachelor]
    source_url: https://x.example
tuition:
  - category: EU
    amount: 20.5
contacts:
  office:
    email: a@b.example
"""


def test_facts(spark):
    df = spark.createDataFrame([("universities/u.yaml", FACTS), ("bad.yaml", "a: [b"), ("list.yaml", "- 1"), ("none.yaml", None)], "path string, content string")
    rows = {r["fact_type"]: r for r in Y.fact_chunks(df).collect()}
    assert set(rows) == {"deadline", "tuition", "contact", "general_info"}
    assert rows["deadline"]["valid_for"] == "2026/27" and rows["deadline"]["entity_type"] == "admission" and rows["contact"]["entity_type"] == "university"
    assert rows["deadline"]["content"] == "[Дедлайн: Uni Test (u1)]\nСеместр: WS2026\nКатегория: EU\nУровни: bachelor\n(актуально для приёма 2026/27)"
    assert rows["tuition"]["content"] == "[Стоимость обучения: Uni Test (u1)]\nКатегория: EU\nStudienbeitrag: 20.5 EUR/semester\nИтого: 20.5 EUR/semester"
    assert rows["contact"]["content"] == "[Контакты: Uni Test - office]\nОтдел: office\nEmail: a@b.example" and rows["contact"]["title"] == "Контакты Uni Test"
    assert Y.unreadable(df).count() == 3


def test_splitting_follows_line_ends():
    text = "\n".join(f"line {i} without a stop at its end" for i in range(200))
    assert max(map(len, C.long_section(text))) <= 1000
    assert C.packed(["a" * 5, "", " b ", "c" * 9], " ", 8, 3) == (["aaaaa b"], "c" * 9)
    assert C.packed(["b" * 9], " ", 8, 3, "zz") == ([], "b" * 9)
    children = C.children_of("Short one.\n\n" + "A sentence of some length. " * 30 + "\n\nTail.")
    assert all(len(c) <= 400 for c in children) and children[0].startswith("Short one. A sentence")


def test_repeated_blocks():
    block = ["a", "b", "c", "d"]
    again = "\n".join([*block, "x", *block, *block, "y"])
    assert I.without_repeated_blocks(again) == "a\nb\nc\nd\nx\ny"
    assert I.without_repeated_blocks(" \n".join("abcdefgh") + "\n ") == " \n".join("abcdefgh") + "\n "  # nothing repeats: as it was
    # a run into the last, shorter window
    assert I.without_repeated_blocks("\n".join(["a", "b", "c", "", "a", "b", "c", "", "a", "b", "c"])) == "a\nb\nc"
    assert I.without_repeated_blocks("\n".join("x" for _ in range(100_000))) == "x"
