from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.operators import bm25, dedup, fusion, grounding, metrics, partitioned, quality, split, stats, validity


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect())


def test_first_failing_reason_counts(spark):
    df = spark.createDataFrame([("",), ("ab",), ("a" * 30,)], "t string")
    kept, why = quality.filter_with_reasons(df, [("empty", F.col("t") == ""), ("short", F.length("t") < 20)])
    assert rows(kept) == [("a" * 30,)] and rows(why) == [("empty", 1), ("short", 1)]


def test_modal_value_and_conflict(spark):
    df = spark.createDataFrame([(1, 8, 1000), (1, 8, 1000), (1, 10, 2000), (2, 1, 1)], "k int, m int, f int")
    assert rows(stats.modal_value(df, ["k"], ["m", "f"])) == [(1, 8, 1000, 2, True), (2, 1, 1, 1, False)]


def test_exceedance(spark):
    df = spark.createDataFrame([(10,), (100,), (1024,), (2049,)], "n int")
    assert rows(stats.exceedance(df, "n", [1024, 2048])) == [(4, 1024, 1, 0.25), (4, 2048, 1, 0.25)]


def test_floor_percentile_is_no_percentile_disc(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "g string, n int")
    assert rows(stats.floor_percentiles(df, ["g"], "n", [0.9])) == [("a", 0.9, 2)]


def test_merge_duplicates(spark):
    df = spark.createDataFrame([("k", 1, "t", ["x"]), ("k", 2, "u", ["y"])], "k string, o int, t string, l array<string>")
    r = stats.merge_duplicates(df, "k", "o", "t", "l").first()
    assert (r["t"], r["l"], r["label_conflict"], r["merged"]) == ("t", ["x", "y"], True, 2)


def test_simhash_of_near_texts(spark):
    base = "".join(chr(0x4E00 + (i * 37) % 900) for i in range(300))
    df = spark.createDataFrame([(1, base), (2, base + "。"), (3, base[::-1]), (4, base)], "id long, t string")
    got = rows(dedup.near_pairs(dedup.simhash(df, "id", F.col("t")), "id"), "a", "b")
    assert (1, 2) in got and (1, 4) in got and not any(3 in p for p in got)


def test_bm25_prefers_shared_bigrams(spark):
    docs = spark.createDataFrame([(1, "被告人入户盗窃手机"), (2, "被告人持刀抢劫商店"), (3, "被告人交通肇事逃逸")], "id long, t string")
    q = spark.createDataFrame([(9, "入户盗窃")], "id long, t string")
    top = bm25.top(bm25.scores(bm25.build(docs, "id", "t"), q, "id", "t"), 3).collect()
    assert top[0]["doc"] == 1


def test_noise_terms_serve_if_there_are_no_others(spark):
    docs = spark.createDataFrame([(i, "甲乙") for i in range(20)], "id long, t string")
    q = spark.createDataFrame([(9, "甲乙")], "id long, t string")
    assert bm25.scores(bm25.build(docs, "id", "t"), q, "id", "t").count() == 20


def test_fusion_and_case_dedup(spark):
    a = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 4.0)], "query long, doc long, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.8)], "query long, doc long, rank int, score double")
    fused = fusion.reranked(fusion.reciprocal_rank({"a": a, "b": b}), 9).orderBy("rank").collect()
    assert [r["doc"] for r in fused] == [11, 10, 12] and fused[0]["sources"] == {"a": 4.0, "b": 0.9}
    boosted = fusion.reranked(fusion.reciprocal_rank({"a": a, "b": b}, boost=F.when(F.col("doc") == 12, 1.5).otherwise(0.0)), 1).first()
    assert boosted["doc"] == 12
    cased = fusion.reranked(fusion.reciprocal_rank({"a": a, "b": b}), 9).withColumn("c", F.col("doc") % 2)
    assert rows(fusion.first_per_case(cased, "c", 3), "doc", "rank") == [(10, 2), (11, 1)]


@pytest.mark.parametrize(
    ("given", "k", "want"),
    [
        ({"a": 0.8, "b": 0.2}, 3, {"a": 2, "b": 1}),
        ({"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, 3, {"a": 1, "b": 1, "c": 1}),
        ({"a": 0.0}, 3, {"a": 3}),
        ({"a": 0.5, "b": 0.3, "c": 0.2}, 10, {"a": 5, "b": 3, "c": 2}),
        ({"a": 0.9, "b": 0.04, "c": 0.03, "d": 0.03}, 4, {"a": 1, "b": 1, "c": 1, "d": 1}),
        ({"a": 0.46, "b": 0.44, "c": 0.05, "d": 0.05}, 6, {"a": 2, "b": 2, "c": 1, "d": 1}),
    ],
)
def test_quotas(spark, given, k, want):
    predicted = spark.createDataFrame([(1, x, p) for x, p in given.items()], "query long, label string, probability double")
    assert {r["part"]: r["quota"] for r in partitioned.quotas(predicted, k).collect()} == want


def test_open_interval_is_in_force(spark):
    rows_ = [(1, 10, "2024-01-01", None), (1, 11, "2020-01-01", "2024-01-02"), (2, 12, None, None)]
    intervals = spark.createDataFrame(rows_, "k int, i int, s string, e string").select("k", "i", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    points = spark.createDataFrame([(1, "2024-01-01"), (1, "2031-05-05"), (2, "2024-01-01"), (1, None)], "k int, a string").select("k", F.to_date("a").alias("a"))
    got = validity.in_force(intervals, points, "k", "s", "e", "a").collect()
    assert sorted((str(r["a"]), r["i"]) for r in got) == [("2024-01-01", 10), ("2024-01-01", 11), ("2031-05-05", 10)]


def test_statute_reasons(spark):
    ok = ("statute", "https://www.npc.gov.cn/x", "verified_official", "现行有效", "2021-03-01", None, "2021-03-01")
    bad = [
        (ok, []),
        (("case", *ok[1:]), ["not_statute_evidence"]),
        (("statute", "https://npc.gov.cn.example.com/", *ok[2:]), ["non_authoritative_source_url"]),
        ((*ok[:2], "unverified", *ok[3:]), ["source_not_human_verified"]),
        ((*ok[:6], None), ["missing_as_of_date"]),
        ((*ok[:4], "2022-01-01", None, "2021-12-31"), ["not_yet_effective"]),
        ((*ok[:5], "2021-03-01", "2021-03-01"), ["expired"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(bad)], "i int, kind string, url string, s string, l string, e string, x string, a string")
    why = validity.reasons(F.col("kind"), F.col("url"), F.col("s"), F.col("l"), *[validity.iso_date(F.col(c)) for c in "exa"])
    assert [r["w"] for r in df.select("i", why.alias("w")).orderBy("i").collect()] == [w for _, w in bad]


def test_contracts(one):
    rule = quality.violations(quality.fine_contract(F.col("s"), F.col("a")))
    assert one(rule, s="positive", a=0) == ["positive_fine_without_amount"] and one(rule, s="zero", a=0) == [] and one(rule, s="missing", a=0) == ["amount_without_fine"]
    term = quality.violations(quality.term_contract(F.col("s"), F.col("a")))
    assert one(term, s="life", a=5) == ["months_with_death_or_life"] and one(term, s="fixed_term", a=5) == []


def test_gate(spark):
    r = spark.range(1).select(quality.gate(F.create_map(F.lit("a"), F.lit(True)), ["a", "b"]).alias("g")).first()["g"]
    assert not r["passed"] and r["failed"] == ["b"]


def test_overrides(spark):
    cases = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "case_id int, accusations array<string>")
    over = spark.createDataFrame([(1, ["x"], ["z"], "approved"), (2, ["y"], ["z"], "pending")], "case_id int, original_accusations array<string>, corrected_accusations array<string>, status string")
    assert rows(quality.apply_overrides(cases, over)) == [(1, ["z"]), (2, ["y"])]


def test_temporal_split_keeps_groups(spark):
    df = spark.createDataFrame([(g, f"{2000 + g}-01-0{m + 1}") for g in range(10) for m in range(2)], "g int, d string").withColumn("d", F.to_date("d"))
    got = dict(split.temporal_split(df, "g", "d", 0.2, 0.2).collect())
    assert [got[g] for g in range(10)] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2


def test_multilabel_metrics(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["b"], ["b"])], "g array<string>, p array<string>")
    r = metrics.multilabel(metrics.label_counts(df, "g", "p", ["a", "b", "c"]), 2).first()
    assert (r["micro_f1"], r["macro_f1"], r["macro_f1_supported"], r["hamming"]) == (1.0, 0.666667, 1.0, 0.0)


def test_threshold_stays_with_few_positives(spark):
    df = spark.createDataFrame([("a", i == 0, 0.3) for i in range(6)], "l string, t boolean, s double")
    assert metrics.tuned_thresholds(df, "l", "t", "s").first()["threshold"] == 0.5


def test_ranking_metrics(spark):
    q = spark.createDataFrame([(1, 5, 2), (1, 6, 0)], "query int, doc int, relevance int")
    run = spark.createDataFrame([(1, 6, 1), (1, 5, 2)], "query int, doc int, rank int")
    r = metrics.ranking(q, run, 10).first()
    assert (r["recall"], r["mrr"]) == (1.0, 0.5) and abs(r["ndcg"] - 0.63093) < 1e-5


def test_binarize_falls_back_to_the_largest(one):
    e = metrics.binarized(F.col("p"), F.array(F.lit(0.5), F.lit(0.5)))
    assert one(e, p=[0.1, 0.4]) == [1] and one(e, p=[0.6, 0.7]) == [0, 1]


def test_response_rules(one):
    rule = grounding.response_violations(F.col("c"), F.col("r"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.col("t"), F.lit(True), F.lit(None).cast("date"), F.lit(False), F.lit(True), rules.ZH_PRIVACY)
    assert one(rule, c=["x"], r=["y"], t="电话13812345678。") == ["citation_outside_retrieval", "private_data_in_case_text", "passed_without_date", "passed_without_statutes", "hidden_review"]


def test_isolation(spark):
    import pytest

    df = spark.createDataFrame([(1, "a"), (1, "b")], "g int, s string")
    with pytest.raises(ValueError, match="several splits"):
        dedup.assert_isolated(df, "s", "g")
