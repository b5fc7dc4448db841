from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import md5_bits
from sievework.operators import audits, bm25, dedup, policy, sentencing


def test_statutes_are_of_different_articles(spark):
    hits = spark.createDataFrame([(1, 1, 1, "a", 10), (1, 1, 2, "b", 11), (1, 2, 1, "c", 10), (1, 2, 2, "d", 12), (2, 1, 1, "a", 10)], "query int, label_rank int, rank int, clause_id string, article int")
    fact = spark.createDataFrame([(1, 1, "b", 10), (1, 2, "e", 13)], "query int, rank int, clause_id string, article int")
    got = sorted(tuple(r) for r in policy.statutes(hits, fact, 5).collect())
    assert got == [(1, "a", 10, 1), (1, "d", 12, 2), (1, "e", 13, 3), (2, "a", 10, 1)]


def test_tags_take_turns(spark):
    rows = spark.createDataFrame([(i, ["head"] if i < 30 else ["amount"]) for i in range(34)], "id int, tags array<string>")
    got = policy.diverse_queries(rows, "id", "tags", 8)
    assert len(got) == 8 and sum(k >= 30 for k in got) == 4 and got == policy.diverse_queries(rows, "id", "tags", 8)
    assert len(policy.diverse_queries(rows, "id", "tags", 50)) == 34
    assert len(policy.diverse_queries(rows.withColumn("tags", F.array(F.lit("none"))), "id", "tags", 5)) == 5


def test_narrowed_labels(spark):
    df = spark.createDataFrame([(1, f"l{i}", 1 - i / 10, True) for i in range(5)] + [(2, f"l{i}", 0.5, False) for i in range(5)], "query int, label string, probability double, used_fallback boolean")
    assert dict(policy.narrowed_labels(df).groupBy("query").count().collect()) == {1: 3, 2: 5}


def test_evidence_ranks_nearer_facts_first(spark):
    docs = spark.createDataFrame([(1, "盗窃手机一部"), (2, "持刀抢劫商店"), (3, "盗窃手机两部")], "doc long, t string")
    q = spark.createDataFrame([(9, "盗窃手机一部")], "query long, t string")
    met = sentencing.cosines(sentencing.vectors(docs, "doc", F.col("t")), sentencing.vectors(q, "query", F.col("t")))
    got = sentencing.evidence(met.select("*", F.col("doc").alias("case_id"), F.lit(0.5).alias("structure"), F.lit(True).alias("same_labels"))).orderBy("rank").collect()
    assert [r["doc"] for r in got[:2]] == [1, 3] and abs(got[0]["score"] - 0.9) < 1e-6


def test_service_decision(one):
    d = sentencing.service_decision(F.col("t"), F.col("c"))
    assert tuple(one(d, t="短", c=[0.9])) == (True, 0.0, True)
    assert tuple(one(d, t="长" * 30, c=[0.9, 0.5])) == (False, 0.7, False)
    assert tuple(one(d, t="长" * 30, c=[0.5])) == (False, 0.5, True)


def test_gate_and_errors(spark):
    m = spark.createDataFrame([(0.9, 3)], "rate double, leaks int")
    r = audits.threshold_gate(m, {"rate": 0.95}, {"leaks": 3}).first()
    assert r["failed"] == ["rate"] and not r["passed"]
    df = spark.createDataFrame([([0, 5],), ([1],)], "ids array<int>")
    assert audits.unknown_labels(df, "ids", 5).first()["invalid_label_rows"] == 1


@pytest.mark.parametrize("by", ["id", "name"])
def test_bm25_scan_equals_joins(spark, by):
    """Texts are passed over, and no gram of theirs is a row; the joins of term tables are the reference."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde é \t") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " ", "a", "b c", "法律条文", "x" * 400] + ["abcde abcde"] * 9
    docs = spark.createDataFrame([(i, f"n{i:03}", t, rng.choice(["p", "q", None])) for i, t in enumerate(texts)], "id long, name string, t string, part string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["abc de", "a", "", None, "éa b", "法律", "zzz", "abcde abcde abcde"])], "q long, t string")
    for part in (None, "part"):
        index = bm25.build(docs, by, "t", part)
        plain = replace(index, texts=None)
        for n, where in ((2, None), (1, None), (3, F.col("id" if by == "name" else "name") < ("n200" if by == "id" else 200))):
            keys = ["query", "part"]
            got = bm25.best(bm25.build(docs, by, "t", part, n), asked, "q", "t", 4, n, where=where)
            assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
            scored = bm25.scores(replace(bm25.build(docs, by, "t", part, n), texts=None), asked, "q", "t", n)
            if where is not None:
                scored = scored.join(docs.where(where).select(F.col(by).alias("doc")), "doc", "left_semi")
            rows = [sorted((tuple(r[c] for c in ("query", "part", "rank", "doc", "score")) for r in bm25.top(x, 4, keys).collect()), key=str) for x in (got, scored)]
            assert rows[0] == rows[1] and rows[0]
        if part is None:
            every = [sorted(map(tuple, bm25.okapi_top(x, asked, "q", "t", 5).select("query", "doc", "score", "rank").collect())) for x in (index, plain)]
            assert every[0] == every[1]


def test_simhash_votes_without_gram_rows(spark):
    texts = ["", " ", "a", "ab", "abc", "abcabc déjà vu", "x" * 3000, "法律 条文", None, "-!", "the same the same"]
    docs = spark.createDataFrame([*enumerate(texts), (5, "another row of a key")], "k long, t string")
    for letters in (False, True):
        got = dedup.simhash(docs, "k", F.col("t"), letters_only=letters)
        want = dedup.simhash(docs, "k", F.col("t"), letters_only=letters, bits64=lambda g: md5_bits(g, 16))
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_near_pairs_broadcast_nothing(spark):
    """Twenty keys a hash are far more than the planner's estimate."""
    plan = dedup.near_pairs(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 7).alias("simhash")), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_packed_vectors_without_gram_rows(spark):
    texts = ["", " ", "a", "abc", "abcd", "déjà vu déjà", "x" * 2000, "法律 条文法律", None]
    docs = spark.createDataFrame([*enumerate(texts)], "k long, t string")
    got = sentencing.packed(docs, "k", F.col("t"))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["k"], b, round(w, 9)) for r in got.collect() for b, w in zip(r["buckets"], r["weights"]))
    assert rows == sorted((r["k"], r["bucket"], round(r["weight"], 9)) for r in sentencing.vectors(docs, "k", F.col("t")).collect())
