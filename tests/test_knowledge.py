"""The incremental knowledge base, clients of remote models, and the multilabel baseline."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import chunking
from sievework.functions.text import character_ngrams
from sievework.operators import baselines, knowledge
from sievework.sources import models, remote
from sievework.sources.publish import Publication


def texts(n):
    return {f"c{i}": f"第{i}案。" + "事实经过如下；" * (i * 7) for i in range(n)}


def frame(spark, cases):
    return spark.createDataFrame(list(cases.items()), "case_id string, fact string")


def expected(cases):
    return sorted((k, i, (t or "")[a:b]) for k, t in cases.items() for i, (a, b) in enumerate(chunking.cuts(t or "", 60, 10)))


def test_only_changed_cases_are_chunked_again(spark, tmp_path):
    root = f"file://{tmp_path}/k"
    cases = texts(20) | {"null": None}

    def build(cases):
        return knowledge.build(frame(spark, cases), root, size=60, overlap=10)

    def held():
        return sorted((r["case_id"], r["chunk_index"], r["text"]) for r in knowledge.chunks(spark, root).collect())

    first = build(cases)
    assert (first["cases"], first["changed"], first["removed"]) == (21, 21, 0) and held() == expected(cases)
    before = sorted(os.listdir(tmp_path / "k/data"))
    assert build(cases) == first and sorted(os.listdir(tmp_path / "k/data")) == before  # nothing is written
    cases["c3"] += "又查明。"
    cases["new"] = "新案。"
    del cases["c5"]
    second = build(cases)
    assert (second["cases"], second["changed"], second["removed"]) == (21, 2, 1) and held() == expected(cases)
    written = spark.read.parquet(f"{tmp_path}/k/data/{second['version']}/chunks")
    assert {r["case_id"] for r in written.collect()} == {"c3", "new"}
    p = Publication(spark, root)
    assert p.vacuum(keep=1) == [] and held() == expected(cases)  # the first segment still serves
    assert knowledge.build(frame(spark, cases), root, size=50, overlap=10)["changed"] == 21  # other settings
    p.rollback()
    assert held() == expected(cases)
    assert build({})["cases"] == 0 and held() == []


class Service:
    """Fails first, answers backwards and tells what it was asked."""

    def __init__(self, fails=(), answer=None):
        self.fails, self.answer, self.asked, self.now, self.waits = list(fails), answer, [], 0.0, []

    def __call__(self, path, payload, seconds):
        self.asked.append((path, payload, seconds))
        if self.fails:
            fault = self.fails.pop(0)
            if isinstance(fault, float):  # a slow answer
                self.now += min(fault, seconds)
                raise TimeoutError
            raise fault
        if self.answer is not None:
            return self.answer
        return {"data": [{"index": i, "embedding": [3.0 * len(t), 4.0]} for i, t in enumerate(payload["input"])][::-1]}

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds

    def made(self, kind, **more):
        return kind(self, "m", clock=lambda: self.now, sleep=self.sleep, **more)


def test_encoder_batches_orders_and_normalises():
    s = Service()
    out = s.made(remote.Encoder, dimensions=2).documents(["x" * i for i in range(21)])
    assert [len(p["input"]) for _, p, _ in s.asked] == [10, 10, 1] and s.asked[0][1]["dimensions"] == 2
    assert all(math.isclose(math.hypot(*v), 1) for v in out) and [v[0] for v in out] == sorted(v[0] for v in out)
    s.made(remote.Encoder, instruction="find").query("q")
    assert s.asked[-1][1]["input"] == ["Instruct: find\nQuery: q"]
    assert s.made(remote.Encoder).documents([]) == []


@pytest.mark.parametrize("data", [[], [{"index": 1, "embedding": [1.0]}], [{"index": 0, "embedding": [0.0]}], [{"index": 0, "embedding": [math.nan]}], [{"index": 0, "embedding": [1.0, 2.0]}], [{"index": 0, "embedding": [1.0]}] * 2])
def test_wrong_vectors_are_refused(data):
    with pytest.raises(ValueError):
        Service(answer={"data": data}).made(remote.Encoder, dimensions=1).documents(["a"])


def test_retries_back_off_until_the_deadline():
    s = Service([remote.Unavailable(), ConnectionError(), remote.Unavailable(after=5)])
    assert len(s.made(remote.Encoder).documents(["a"])) == 1 and s.waits == [0.5, 1.0, 5]
    s = Service([remote.Unavailable("busy")] * 9)
    with pytest.raises(remote.Unavailable, match="busy"):
        s.made(remote.Encoder, tries=3).documents(["a"])
    assert len(s.asked) == 3
    s = Service([ValueError("no such model")])
    with pytest.raises(ValueError, match="no such model"):  # not worth another try
        s.made(remote.Encoder).documents(["a"])
    assert len(s.asked) == 1 and s.waits == []
    s = Service([100.0] * 9)
    with pytest.raises(remote.DeadlineExceeded):
        s.made(remote.Encoder, timeout=60, deadline=100).documents(["a"])
    assert [round(x[2], 1) for x in s.asked] == [60, 39.5] and s.now <= 100


def test_reranker_checks_its_answer():
    def ranked(results, k=2, **more):
        s = Service(answer={"results": [{"index": i, "relevance_score": x} for i, x in results]})
        return s.made(remote.Reranker, **more).rank("q", ["a", "b"], k), s

    got, s = ranked([(0, 0.2), (1, 0.9)], instruction="law")
    assert got == [(1, 0.9), (0, 0.2)] and s.asked[0][1]["instruct"] == "law" and s.asked[0][1]["top_n"] == 2
    for wrong in ([(0, 0.2), (0, 0.3)], [(0, 0.2), (2, 0.3)], [(0, math.nan), (1, 0.3)], [(0, 0.3)], [(True, 0.3), (0, 0.1)]):
        with pytest.raises(ValueError):
            ranked(wrong)
    assert Service().made(remote.Reranker).rank("q", [], 3) == []


def test_chat_and_encoder_in_tasks(spark):
    assert Service(answer={"choices": [{"message": {"content": "yes"}}]}).made(remote.Chat).answer([{"role": "user", "content": "?"}]) == "yes"
    for wrong in ({}, {"choices": []}, {"choices": [{"message": {"content": "  "}}]}):
        with pytest.raises(ValueError, match="empty"):
            Service(answer=wrong).made(remote.Chat).answer([])

    def transport(path, payload, seconds):
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(payload["input"])]}

    df = spark.createDataFrame([(i, "x" * i) for i in range(25)], "id long, t string")
    got = models.embed(df, "id", "t", remote.Encoder(transport, "m", dimensions=2).documents, dim=2).collect()
    assert all(math.isclose(r["embedding"][0] / r["embedding"][1], r["id"], abs_tol=1e-9) for r in got) and len(got) == 25


def test_vocabulary_and_weights_are_those_of_brute_force(spark):
    docs = {1: "Aba  ba", 2: "abab", 3: "", 4: None, 5: "xyz\nab"}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    grams = {k: Counter(c[i : i + n] for c in [" ".join((t or "").lower().split())] for n in (2, 3, 4) for i in range(len(c) - n + 1)) for k, t in docs.items()}
    counts = baselines.gram_counts(df, "id", "t")
    assert {(r["id"], r["gram"]): r["tf"] for r in counts.collect()} == {(k, g): n for k, c in grams.items() for g, n in c.items()}
    total, df_ = sum(grams.values(), Counter()), Counter(g for c in grams.values() for g in c)
    best = sorted((g for g in total if df_[g] >= 2), key=lambda g: (-total[g], g))[:3]
    words = baselines.vocabulary(counts, "id", 5, 3)
    assert {r["gram"]: (r["feature"], round(r["idf"], 9)) for r in words.collect()} == {g: (i, round(math.log(6 / (1 + df_[g])) + 1, 9)) for i, g in enumerate(sorted(best))}
    for r in baselines.weighted(counts, "id", words).collect():
        raw = {sorted(best).index(g): (1 + math.log(n)) * (math.log(6 / (1 + df_[g])) + 1) for g, n in grams[r["id"]].items() if g in best}
        length = math.sqrt(sum(x * x for x in raw.values()))
        assert dict(zip(r["features"], [round(x, 9) for x in r["weights"]])) == {k: round(x / length, 9) for k, x in raw.items()}


def test_grams_counted_in_tasks_are_those_of_tables(spark, monkeypatch):
    texts = ["Aba  ba", "abab", "", None, "xyz\nab", "a", "\U00020000é\x00 ab\x00", "é\x00 é", "ab" * 300, "ÄB İab", "abab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    counts = baselines.gram_counts(df, "id", "t")
    words = baselines.vocabulary(counts, "id", len(texts), 40)
    want = {r["id"]: sorted(zip(r["features"], [round(x, 9) for x in r["weights"]])) for r in baselines.weighted(counts, "id", words).collect()}
    plain = df.select("id", baselines.plain_text(F.col("t")).alias("text"))
    totals = baselines.gram_totals(plain)
    assert sorted(map(tuple, totals.collect())) == sorted((r["gram"], r["tf"], r["df"]) for r in counts.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).collect())
    assert sorted(map(tuple, baselines.chosen(totals, len(texts), 40).collect())) == sorted(map(tuple, words.collect()))
    got = {r["id"]: sorted(zip(r["features"], [round(x, 9) for x in r["weights"]])) for r in baselines.vectors(plain, words).collect()}
    assert got == {i: want.get(i, []) for i in range(len(texts))}
    slab = pa.array([t or "" for t in texts])
    in_table = [baselines.Slab(slab).counts(n) for n in baselines.SIZES]
    monkeypatch.setattr(baselines, "TABLE", 4)  # pairs of characters are sorted instead
    assert all(a[0] == b[0] and all(map(np.array_equal, a[1:], b[1:])) for a, b in zip(in_table, [baselines.Slab(slab).counts(n) for n in baselines.SIZES]))
    assert baselines.Slab(pa.array(["", ""])).counts(4)[0] == []


def test_linear_models_beat_the_majority(spark):
    rng = random.Random(4)
    stems = {"theft": "stolen phone taken purse", "fraud": "forged cheque false claim", "assault": "struck injured fist wound"}

    def row(i):
        labels = rng.sample(sorted(stems), rng.choice([1, 1, 2]))
        return i, " ".join(rng.choice((" ".join(stems[x] for x in labels) + " the a of court day").split()) for _ in range(25)), labels

    rows = [row(i) for i in range(500)] + [(900, None, ["theft"]), (901, "", []), (902, "zzzz", None)]
    df = spark.createDataFrame(rows, "id long, t string, l array<string>").repartition(3)
    got = {r["model"]: r for r in baselines.multilabel(df.where("id % 4 > 0"), df.where("id % 4 = 0"), "id", "t", "l", 500).collect()}
    assert got["ngrams"]["rows"] == got["majority"]["rows"] == df.where("id % 4 = 0").count() and got["ngrams"]["features"] == 500
    assert got["ngrams"]["micro_f1"] > 0.95 > 0.6 > got["majority"]["micro_f1"]


def test_hashed_grams_are_those_of_hashing_tf_and_made_once(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["stolen phone", "a", "ab", " a\nb c", "", "\U00020000é", "第一案。被告人", "ab" * 500, "é\u2003é", "\x00", "aaaa"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(2)
    tf = baselines.hashed(df, 64)
    grams = df.select("doc_id", F.array_union(character_ngrams(F.col("text"), 2), character_ngrams(F.col("text"), 3)).alias("g"))
    want = HashingTF(inputCol="g", outputCol="tf", numFeatures=64).transform(grams)
    assert {r["doc_id"]: r["tf"] for r in tf.collect()} == {r["doc_id"]: r["tf"] for r in want.collect()}
    assert tf.inputFiles()  # the fit's passes read what was written, not texts
