import json

import pytest

from brindle.sources import apis, sinks


def test_performance_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"keys": ["2026-03-10", "q1"], "clicks": 20, "impressions": 300, "ctr": 0.06, "position": 3.2}]}))
    (tmp_path / "b.json").write_text("{}")
    r = apis.performance_rows(spark, str(tmp_path), ["date", "query"]).collect()
    assert [(str(x.date), x.query, x.clicks) for x in r] == [("2026-03-10", "q1", 20)]
    with pytest.raises(Exception, match="dimension page"):
        apis.performance_rows(spark, str(tmp_path), ["date", "query", "page"]).collect()


def test_speed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "u1", "lighthouseResult": {"audits": {"largest-contentful-paint": {"numericValue": 2500}}, "categories": {"performance": {"score": 0.9}}}, "loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 1800}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12}}}}))
    m = apis.speed_measurements(spark, str(tmp_path))
    assert {(r.kind, r.lcp_ms, r.cls) for r in m.collect()} == {("lab", 2500.0, None), ("field", 1800.0, 0.12)}
    assert apis.slowest(m).first().kind == "field"


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", None)], "k string, v int")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", None)}
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"], first=True).collect()} == {("a", 1), ("b", 2), ("c", None)}


def test_replace_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, v int")
    sinks.replace_partitions(df, p, ["run"])
    sinks.replace_partitions(spark.createDataFrame([("r1", 9)], "run string, v int"), p, ["run"])
    assert {(r.run, r.v) for r in sinks.read_partitioned(spark, p).collect()} == {("r1", 9), ("r2", 2)}


def test_texts(spark):
    df = spark.createDataFrame([("wiki", "b", 2), ("wiki", "a", 1)], "section string, url string, rank int")
    assert sinks.text_sections(df, "section", "url", "rank").first().text == "## wiki\n- a\n- b"
    a = sinks.article_schema(spark.createDataFrame([("x<" + "y" * 200, "https://a.example", "2026-01-01")], "t string, u string, d string"), "t", "u", "d").first()
    assert "<" not in a.json_ld and len(json.loads(a.json_ld)["headline"]) == 110


def test_engine_answers(spark):
    bodies = [
        json.dumps({"candidates": [{"content": {"parts": [{"text": "one"}, {"text": "two"}]}, "finishReason": "STOP", "groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://a.example/"}}]}}]}),
        json.dumps({"candidates": [{"finishReason": "SAFETY"}]}),
        "{not json",
        None,
    ]
    got = apis.engine_answers(spark.createDataFrame([(b,) for b in bodies], "body string"), "candidates").collect()
    assert [(r.text, r.refusal, r.fetch_error) for r in got] == [("one\ntwo", None, None), (None, "SAFETY", None), (None, None, "bad_json"), (None, None, "empty_body")]
    assert got[0].grounding == ["https://a.example/"]
    c = apis.engine_answers(spark.createDataFrame([(json.dumps({"choices": [{"message": {"content": "hi"}, "finish_reason": "content_filter"}]}),)], "body string"), "choices").first()
    assert (c.text, c.refusal) == ("hi", "content_filter")


def test_draft_and_ranking(spark):
    from pyspark.sql import functions as F

    from brindle.operators.ranking import ranked

    title, body = apis.split_draft(F.col("t"))
    r = spark.createDataFrame([("# A title\n\nText",), ("No title",)], "t string").select(title.alias("a"), body.alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [("A title", "Text"), (None, "No title")]
    docs = spark.createDataFrame([("1", "Red shoes", "about boots"), ("2", "Boots", "red shoes here"), ("3", "Other", None)], "id string, name string, body string")
    assert [x.id for x in ranked(docs, "red shoes").collect()] == ["1", "2"]
