from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.plans import generation
from sievework.sources import html, models, records, sinks, statutes
from sievework.streaming import scoring


def test_all_record_shapes(spark, tmp_path):
    rows = [
        {"fact": " 事实 Ａ ", "meta": {"accusation": ["盗窃", " "], "relevant_articles": ["264", "x"], "term_of_imprisonment": {"imprisonment": "8", "fine": "1000", "death_penalty": False, "life_imprisonment": False}}},
        {"input": "事实二", "output": {"罪名": ["抢劫"], "有期徒刑": "12", "是否死刑": False, "是否无期": True, "罚金": "-5"}},
        {"case_id": "c3", "fact": "三", "labels": {"accusations": ["b", "a", "b"], "imprisonment_months": "3", "fine": "unknown"}, "accusation_ids": ["2", "x"]},
        {"id": "c4", "text": "四", "accusations": []},
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("﻿" + "\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    got = records.normalized(records.read_jsonl(spark, str(path), records.RAW), "train", {"盗窃": 0, "抢劫": 1}).collect()
    a, b, c, d = got
    assert a["fact"] == "事实 A" and a["accusations"] == ["盗窃"] and a["accusation_ids"] == [0] and a["relevant_articles"] == [264] and a["penalty"]["fine"] == 1000
    assert a["case_id"].startswith("train-") and len(a["case_id"]) == 22
    assert b["accusations"] == ["抢劫"] and b["penalty"]["life_imprisonment"] and b["penalty"]["fine"] is None and b["penalty"]["imprisonment_months"] == 12
    assert c["case_id"] == "c3" and c["accusations"] == ["a", "b"] and c["accusation_ids"] == [2] and c["penalty"]["fine"] is None
    assert d["case_id"] == "c4" and d["accusations"] == [] and d["penalty"] is None


def test_bad_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string").collect()
    assert records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string", strict=False).count() == 2


def test_external_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"CaseId": "1", "Fact": "f", "Fine": ["1", "2"], "Sentence": ["x", "y"], "Crime Type": ["t"], "Law Articles": ["1"]}, {"CaseId": "2", "Fact": "f", "Fine": "9", "Sentence": [], "Crime Type": [], "Law Articles": []}]))
    one, two = records.read_array(spark, str(tmp_path / "a.json")).orderBy("id").collect()
    assert one["fine"] is None and one["fine_unaligned"] == ["1", "2"] and one["sentence"] == "x；y" and two["fine"] == "9"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in.jsonl", json.dumps({"id": "7", "fact": "张三盗窃", "criminals_info": {"张三": {"accusations": ["盗窃"], "laws": [264], "term": "1"}, "李四": {"accusations": [], "laws": [], "term": "0"}}}, ensure_ascii=False))
    got = {r["defendant"]: r["alignment_reliable"] for r in records.read_archives(spark, str(tmp_path / "b.zip")).collect()}
    assert got == {"张三": True, "李四": False}
    (tmp_path / "c.csv").write_text("﻿index,fact,accusation\n1,\"a,b\",\"['x', 'y']\"\n2,c,plain\n", encoding="utf-8")
    r = records.read_csv(spark, str(tmp_path / "c.csv")).orderBy("index").collect()
    assert json.loads(r[0]["accusation"]) == ["x", "y"] and json.loads(r[1]["accusation"]) == "plain"
    (tmp_path / "d.jsonl").write_text('{"id": "1", "fact": "f", "meta": {"punish_of_money": null}}\n{"id": "2", "fact": "f", "meta": {}}\n')
    assert {r["id"]: r["fine_present"] for r in records.read_lines(spark, str(tmp_path / "d.jsonl")).collect()} == {"1": True, "2": False}


def test_visible_text():
    assert html.text_of("<p>a  b</p><script>x</script><style>y</style><div> c &amp; d </div>") == "a b\nc & d"
    assert html.text_of(None) is None


def test_articles(spark):
    df = spark.createDataFrame([("总则 第一条 短。第二条 乙\n文。第一条 更长的正文。第三条 ",)], "t string")
    got = {r["number"]: (r["clause_id"], r["body"], r["version"]) for r in statutes.articles(df, "t", version="v1").collect()}
    assert got == {1: ("PRC-CRIMINAL-LAW#1", "更长的正文。", "v1"), 2: ("PRC-CRIMINAL-LAW#2", "乙 文。", "v1")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string").coalesce(1)
    sinks.write_jsonl(df, str(tmp_path / "o"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "o")).collect()] == [{"a": None, "b": 2}, {"a": "x", "b": 1}]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_jsonl(df, str(tmp_path / "o"))
    spark.createDataFrame([("a", 1), ("b c", 2)], "part string, n int").coalesce(1).write.partitionBy("part").parquet(str(tmp_path / "i"))
    files = json.loads(sinks.manifest(spark, str(tmp_path / "i"), rows=2))["files"]
    assert sorted(f.split("/")[0] for f in files) == ["part=a", "part=b c"] and len(set(files.values())) == 2


def test_models(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id long, text string")
    assert models.embed(df, "id", "text", dim=64).count() == 2
    with pytest.raises(ValueError, match="wrong size"):
        models.checked([[float("nan")]], 1, 1)
    with pytest.raises(ValueError, match="2 texts"):
        models.checked([[1.0]], 2, None)
    hits = spark.createDataFrame([(1, 2, 0.5, {"a": 1.0})], "query long, doc long, score double, sources map<string,double>")
    q, d = spark.createDataFrame([(1, "x")], "query long, text string"), spark.createDataFrame([(2, "y")], "doc long, text string")
    r = models.rerank(hits, q, d, lambda pairs: [0.9 for _ in pairs]).first()
    assert r["score"] == 0.9 and r["sources"] == {"a": 1.0, "rrf": 0.5, "reranker": 0.9}
    out = models.generate(df, "id", "text", lambda t: t, lambda o: o == "abc", lambda t: "fallback").orderBy("id").collect()
    assert [(r["output"], r["attempts"]) for r in out] == [("abc", 1), ("fallback", 2)]
    scored = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.1), (2, "a", 0.9)], "id long, label string, probability double")
    got = models.predicted_labels(scored, "id", spark.createDataFrame([("a", 0.6)], "label string, threshold double"), k=1).orderBy("id").collect()
    assert [(r["label"], r["used_fallback"]) for r in got] == [("a", True), ("a", False)]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": i, "text": t, "ts": "2024-01-01T00:00:00Z"}) for i, t in enumerate(["A b", "A  b", "c"])))
    stream = scoring.read_stream(spark, str(tmp_path / "in"), "id int, text string, ts timestamp")
    q = scoring.write_stream(scoring.deduplicated(stream, "text", "ts"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.withColumn("n", F.length("text")))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_statute_articles_are_of_all_parts(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name").collect()
    best = {}
    for r in sorted(parts, key=lambda r: r["p_partkey"]):
        number, body = (1, 2, 10, 21, 102)[r["p_partkey"] % 5], " ".join(r["p_name"].split())
        if len(body) > len(best.get(number, "")):
            best[number] = body
    got = generation.statute_articles(spark, "/root/testdata/sf0.001").collect()
    assert {r["number"]: r["body"] for r in got} == best
