from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.text import selected_sentences
from sievework.operators import bm25, conversion, dense, grounding, metrics
from sievework.sources import labels, models, plugins, records, sinks


def shortened(text, keywords, limit, ends):
    """selected_sentences() in plain Python."""
    parts = [s for s in (p.strip(" ") for p in re.split(f"(?<=[{ends}])", text)) if s]
    if len(text) <= limit or len(parts) <= 1:
        return text
    budget, kept, used = limit - 8, {}, 0
    worth = [10 * sum(k in s for k in keywords) + (i in (0, len(parts) - 1)) for i, s in enumerate(parts)]
    for i in sorted(range(len(parts)), key=lambda i: (-worth[i], i)):
        if used >= budget:
            break
        s = parts[i]
        if kept and used + len(s) > budget:
            continue
        if len(s) > budget:
            head = budget * 2 // 3
            s = s[:head] + s[head - budget :]
        kept[i] = s
        used += len(s)
    return "".join(kept[i] for i in sorted(kept))


def test_selected_sentences(spark):
    keywords = ["the", "and"]
    texts = ["", "short. text", "x" * 100, "a the. " * 30, "one. two and the. " + "y" * 90 + ". last.", "z" * 200 + " the and. b. c.", "q. " * 60 + "the end. " + "r. " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", selected_sentences(F.col("t"), keywords, 60, ".!?").alias("x")).collect()}
    assert got.pop(99) is None
    assert got == {i: shortened(t, keywords, 60, ".!?") for i, t in enumerate(texts)}


def test_selected_sentences_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    keywords = ["the", "and", "que", "der"]
    for r in d.select("text", selected_sentences(F.col("text"), keywords, 512, ".!?").alias("x")).collect():
        assert r["x"] == shortened(r["text"], keywords, 512, ".!?")


def test_label_mappings(spark, tmp_path):
    want = {"盗窃": 0, "抢劫": 1}
    for i, raw in enumerate([json.dumps(want).encode("utf-8-sig"), json.dumps(want, ensure_ascii=False).encode("gb18030"), repr(want).encode()]):
        (tmp_path / f"{i}").write_bytes(raw)
        assert labels.read_mapping(spark, str(tmp_path / f"{i}")) == want
    with pytest.raises(ValueError):
        labels.parsed_mapping(b"neither")
    assert list(json.loads(labels.mapping_json({"b": 1, "a": 0}))) == ["a", "b"]
    assert labels.mapping_faults({"a": 0, "b": 2}, 3) == ["ids_with_gaps", "wrong_size"]
    assert labels.mapping_faults(want, 2) == []
    assert labels.checked_thresholds({"1": 0.2, "0": 0.1}, 2) == [0.1, 0.2]
    with pytest.raises(ValueError):
        labels.checked_thresholds({"0": 0.1}, 2)


def test_configuration(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("x: {y: 1}\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    (tmp_path / "c.yaml").write_text("")
    c = labels.read_config(str(tmp_path / "a.yaml"))
    assert labels.nested(c, "x", "y") == 1 and labels.nested(c, "x", "y", "z") is None and labels.nested(c, "q") is None
    assert labels.read_config(str(tmp_path / "c.yaml")) == {}
    with pytest.raises(TypeError):
        labels.read_config(str(tmp_path / "b.yaml"))
    with pytest.raises(FileNotFoundError):
        labels.read_config(str(tmp_path / "none.yaml"))
    assert labels.resolved("/a/b") == "/a/b" and labels.resolved("b", "/a") == "/a/b"


def test_source_plugin(spark):
    class Numbers(plugins.Adapter):
        name, schema = "numbers", "n int, text string"

        def parts(self):
            return list(range(int(self.options["parts"])))

        def records(self, part):
            yield {"n": part}
            yield {"n": part + 100, "text": self.options["path"]}

    plugins.register(spark, Numbers)
    got = spark.read.format("numbers").option("parts", 3).load("here").collect()
    assert sorted((r["n"], r["text"]) for r in got) == [(0, None), (1, None), (2, None), (100, "here"), (101, "here"), (102, "here")]


def test_first_lines_and_validated(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id": "{i}"}}\n' if i % 3 else "broken {\n\n" for i in range(9)))
    got = records.read_jsonl_head(spark, str(tmp_path / "a.jsonl"), "id string", 4).orderBy("part", "line").collect()
    assert [r["id"] for r in got if r["id"]] == ["1", "2", "4", "5"][: len([r for r in got if r["id"]])]
    raw = records.read_jsonl(spark, str(tmp_path / "b.jsonl"), records.RAW) if (tmp_path / "b.jsonl").write_text('{"fact": "x", "accusations": ["a"]}\n{"fact": "", "accusations": []}\n') else None
    good, bad = records.validated(raw, "train", F.array_compact(F.array(F.when(F.col("fact") == "", F.lit("no_fact")))))
    assert good.count() == 1 and [r["faults"] for r in bad.collect()] == [["no_fact"]]


def test_run_manifest(spark, tmp_path):
    text = sinks.run_manifest(spark, str(tmp_path / "m"), str(tmp_path), rows=3)
    got = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert got == json.loads(text) and got["rows"] == 3 and got["source_revision"] == "unversioned" and got["environment"]["spark"] == spark.version
    (tmp_path / ".source-commit").write_text("abc\n")
    assert sinks.revision(str(tmp_path)) == "abc"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.run_manifest(spark, str(tmp_path / "m"))


def test_generation_repairs(spark):
    df = spark.createDataFrame([(1, "good"), (2, "mend"), (3, "never"), (4, "down")], "id int, p string")

    def generator(prompt):
        if prompt.startswith("down"):
            raise ConnectionError
        return "ok" if prompt.startswith("good") or "no ok in it" in prompt and prompt.startswith("mend") else "bad"

    out = models.generate(df, "id", "p", generator, lambda o: None if o == "ok" else "no ok in it", lambda p: "fallback")
    got = {r["id"]: (r["output"], r["attempts"], r["error"]) for r in out.collect()}
    assert got == {1: ("ok", 1, None), 2: ("ok", 2, None), 3: ("fallback", 2, "generation_validation_failed"), 4: ("fallback", 1, "generation_provider_unavailable")}


def test_converted_cases(spark):
    schema = "case_id string, split string, fact string, accusations array<string>, relevant_articles array<int>, months int, fine int, death boolean, life boolean"
    rows = [
        ("1", "train", "甲盗窃财物，电话13800138000。", ["盗窃"], [264], 6, 0, None, None),
        ("2", "test", "甲盗窃财物；电话13800138000", ["盗窃"], [], 0, 5, False, False),
        ("3", "train", "乙杀人。", [], None, 3, None, True, True),
        ("4", "train", None, None, None, None, None, None, None),
        ("5", "test", "丙抢劫。", ["抢劫"], [263], 7, None, False, True),
    ]
    got = {r["source_case_id"]: r for r in conversion.converted(spark.createDataFrame(rows, schema), "s", "1").collect()}
    assert {k: r["excluded"] for k, r in got.items()} == {"1": None, "2": "cross_split_duplicates_excluded", "3": None, "4": "empty_after_leakage_clean", "5": None}
    assert got["1"]["sentence_type"] == "fixed_term" and got["1"]["relevant_articles"] == ["刑法第264条"] and got["1"]["privacy_status"] == "redacted" and got["1"]["fine"]["status"] == "zero"
    assert got["3"]["sentence_type"] == "unknown" and got["3"]["label_quality"] == "invalid_conflicting_special_penalty" and not got["3"]["death_penalty"]
    assert got["5"]["sentence_type"] == "life" and got["5"]["imprisonment_months"] is None and got["5"]["fine"]["status"] == "missing" and got["5"]["data_quality"]["sentence_type_reliable"]
    assert got["2"]["sentence_type"] == "exempt" and got["2"]["imprisonment_months"] == 0


def test_aligned_rows_have_partners(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string"), spark.createDataFrame([(1, 5), (2, 6)], "id int, b int")
    assert sorted(map(tuple, metrics.aligned(a, b, "id").collect())) == [(1, "x", 5), (2, "y", 6)]
    with pytest.raises(Exception, match="without a partner"):
        metrics.aligned(a, b.where("id = 1"), "id").collect()
    with pytest.raises(ValueError):
        metrics.aligned(a.union(a), b, "id")


def test_packets_and_prompts(spark):
    facts = spark.createDataFrame([(1, "f", ["x"]), (2, "g", [])], "request int, fact string, predicted_labels array<string>")
    hits = spark.createDataFrame([(1, "s1", "statute", 1, "law", ["x"], ["264"]), (1, "c2", "case", 2, "two", [], []), (1, "c1", "case", 1, "one", ["x", "y"], [])], "request int, evidence_id string, kind string, rank int, text string, labels array<string>, articles array<string>")
    p = grounding.evidence_packet(facts, hits, F.lit(None).cast("string"))
    got = {r["request"]: r for r in p.collect()}
    assert [e["evidence_id"] for e in got[1]["evidence"]] == ["c1", "c2", "s1"] and got[2]["evidence"] == []
    assert [e["title"] for e in got[1]["evidence"]] == ["c1", "c2", "法条 s1"]
    text = {r["request"]: r["t"] for r in p.select("request", grounding.grounded_prompt(F.col("fact"), F.col("evidence"), "Do.").alias("t")).collect()}
    assert text[2] == "Do.\n\nQuestion:\ng\n\nEvidence:\n" and "[c1]\nlabels: x,y\narticles: unknown\ntext: one\n\n[c2]" in text[1]


@pytest.mark.parametrize("several", [False, True])
def test_dense_gates(spark, several):
    rng = np.random.default_rng(5)
    kinds = ["a", "b", None]
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 4 else 2)], [kinds[i % 3], kinds[i % 2]] if several else kinds[i % 3]) for i in range(40)]
    rows += [(100, None, rows[0][2]), (101, [1.0, float("nan"), 0.0], rows[0][2])]
    df = spark.createDataFrame(rows, f"id long, v array<double>, g {'array<string>' if several else 'string'}")
    got = {}
    for r in dense.search(df, df.where("id % 5 = 0"), "id", "v", 4, "g").orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    want = {}
    full = [r for r in rows[:40]]
    for q, v, g in full:
        if q % 5:
            continue
        mine = set(filter(None, g if several else [g]))
        near = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), d) for d, w, h in full if d != q and len(w) == len(v) and mine & set(filter(None, h if several else [h]))]
        if near:
            want[q] = [d for _, d in sorted(near)[:4]]
    assert got == want


def test_okapi_top_without_pairs(spark):
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(["abc", "xyz", "abx", "", None, "qqq", "abab"])], "id long, t string, l string")
    asked = spark.createDataFrame([(1, "ab"), (2, "zz"), (3, "yz q"), (4, "")], "q long, t string")
    index = bm25.build(docs, "id", "t")
    for k in (1, 3, 6, 20):
        every = bm25.top(bm25.okapi_scores(index, asked, "q", "t"), k)
        few = bm25.okapi_top(index, asked, "q", "t", k)
        pick = lambda d: sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in d.collect())
        assert pick(every) == pick(few)


def test_sentencing_model(spark):
    from sievework.operators import sentencing

    rows = []
    for i in range(120):
        kind = ["fixed_term", "life", "exempt"][i % 3]
        rows.append((i, [kind, "rich" if i % 2 else "poor", f"w{i % 5}"], kind, 20 + i % 3 if kind == "fixed_term" else None, 3000 if i % 2 else 0))
    df = spark.createDataFrame(rows, "id int, grams array<string>, sentence_type string, months int, fine int")
    model = sentencing.SentencingModel(df, buckets=256)
    for r in model.predict(df.select("id", "grams", "sentence_type")).collect():
        kind = ["fixed_term", "life", "exempt"][r["id"] % 3]
        assert r["sentence_type"] == kind and abs(sum(r["sentence_type_probabilities"].values()) - 1) < 1e-6
        assert (r["imprisonment_months"] is None) == (kind != "fixed_term") and r["fine_imposed"] == (r["id"] % 2 == 1)
        if kind == "fixed_term":
            assert r["imprisonment_range"]["lower"] <= r["imprisonment_months"] <= r["imprisonment_range"]["upper"]
        if r["fine_imposed"]:
            assert r["fine_range"]["lower"] == 2000 and 2000 <= r["fine_amount"] <= r["fine_range"]["upper"]
    one = sentencing.SentencingModel(df.where("id = 0"), buckets=16).predict(df.select("grams"))
    assert {(r["sentence_type"], r["fine_imposed"]) for r in one.collect()} == {("fixed_term", False)}
