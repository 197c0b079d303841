from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tamarack.plans.providers import Offline, embedded
from tamarack.sources import files as S
from tamarack.streaming import logs as L


def test_file_trees(spark, tmp_path):
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    for name in ("a.md", "_draft.md", "README.md", "sub/b.md", "x.yaml", "schema.yaml"):
        (tmp_path / "kb" / name).write_text(f"text of {name}", encoding="utf-8")
    assert sorted(r["name"] for r in S.markdown_files(spark, str(tmp_path / "kb")).collect()) == ["a.md", "b.md"]
    assert [r["name"] for r in S.yaml_files(spark, str(tmp_path / "kb")).collect()] == ["x.yaml"]


def test_append_and_reports(spark, tmp_path):
    path = str(tmp_path / "chunks")
    S.write_chunks(spark.createDataFrame([(1, "a", [1.0]), (7, "b", [2.0])], "id long, content string, embedding array<double>"), path)
    new = spark.createDataFrame([("c", [3.0]), ("d", [])], "content string, embedding array<double>")
    S.append_with_ids(spark, path, new)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 3 and max(r["id"] for r in rows) > 7 and {r["content"] for r in rows} == {"a", "b", "c"}
    sheets = {"users": spark.range(2), "empty": spark.range(0)}
    assert S.write_report(sheets, str(tmp_path / "report")) == ["users"]
    S.write_markdown(spark.createDataFrame([("f.md", "body", "u")], "file string, text string, url string"), str(tmp_path / "md"), fields={"url": "url"})
    assert "url: u" in spark.read.text(str(tmp_path / "md"), wholetext=True).first()["value"]


def test_pages_and_evaluation(spark, tmp_path):
    p = tmp_path / "pages.json"
    p.write_text('{"url":"a","html":"<p>x</p>","status":200}\n{"url":"b","html":null,"status":404}\n')
    assert {r["url"]: r["fetch_error"] for r in S.pages(spark, str(p), "json").collect()} == {"a": None, "b": "HTTP ERROR: 404"}
    e = tmp_path / "eval.json"
    e.write_text('[{"id":1,"question":"q","expected_keywords":["k"],"topic":"t","difficulty":"basic"}]')
    assert S.evaluation_set(spark, str(e)).first()["expected_keywords"] == ["k"]


def test_stream_counts_each_row_once(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(f"r{i}", start + timedelta(minutes=7 * i), i % 2 == 0, float(i), None) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "id string, created_at timestamp, cache_hit boolean, t_total double, error string")
    df.write.parquet(str(tmp_path / "in"))
    stream = L.once_each(L.read_files(spark, str(tmp_path / "in"), df.schema))
    L.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    q = L.metrics(L.read_files(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("queries")).first()[0] == 25


def test_offline_provider(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embedded(df, Offline(8)).collect()}
    assert got[1] == got[2] and len(got[1]) == 8 and got[3] == [] and got[4] == []
