"""Validation of training, retrieval and split data sets, and the audit of external ones."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievework.operators import audits, validation

SOUND = json.dumps({"candidate_accusations": ["a"], "key_facts": [], "confidence": "high", "requires_manual_review": True})
BARE = json.dumps({"confidence": "low", "requires_manual_review": True})
SHORT = "deterministic_insufficient_information"
SCHEMA = "split string, case_id string, sft_id string, source_split string, review_status string, construction_type string, target string, answer string"


def errors(df):
    return {r["error"]: r["n"] for r in df.collect()}


def test_training_rows(spark):
    def row(split="train", case="c", sft="1", source=None, review="unreviewed", kind="plain", target=SOUND, answer=None):
        return (split, case, sft, source or split, review, kind, target, target if answer is None else answer)

    sound = [row(), row(sft="2", kind=SHORT, target=BARE), row("validation", "d")]
    # the same content in another order and with other spacing agrees
    sound.append(row(sft="3", answer=json.dumps({"requires_manual_review": True, **dict(reversed(json.loads(SOUND).items()))}, indent=1)))
    assert errors(validation.training_errors(spark.createDataFrame(sound, SCHEMA))) == {}
    bad = [
        row(sft="1"), row(sft="1"), row(sft=None), row(sft=""),
        row("validation", "c", sft="1"), row(sft="4", source="test"), row(sft="5", review=None),
        row(sft="6", target="[]"), row(sft="7", target=None, answer="x"), row(sft="8", answer="{}"), row(sft="9", answer=BARE),
        row(sft="10", kind=SHORT), row(sft="11", kind=SHORT, target=BARE.replace("true", "false")),
    ]
    assert errors(validation.training_errors(spark.createDataFrame(sound + bad, SCHEMA))) == {
        "missing_or_duplicate_sft_id": 5,
        "source_case_cross_split_overlap": 1,
        "source_split_mismatch": 1,
        "invalid_review_status": 1,
        "target_schema_invalid": 2,
        "assistant_json_invalid": 1,
        "assistant_target_mismatch": 1,
        "insufficient_information_has_accusation": 1,
        "insufficient_information_not_escalated": 2,
    }
    assert errors(validation.training_errors(spark.createDataFrame([], SCHEMA))) == {}


def test_retrieval_rows(spark):
    q = spark.createDataFrame([(1, "validation", "unreviewed"), (2, "test", None)], "query_id int, source_split string, review_status string")
    c = spark.createDataFrame([(1, "train"), (1, "train"), (2, None)], "candidate_id int, source_split string")
    j = spark.createDataFrame([(1, 1, "silver_proxy", "unreviewed"), (1, 9, "silver_proxy", "unreviewed"), (None, 1, None, "x")], "query_id int, candidate_id int, judgment_source string, review_status string")
    want = {"query_not_validation": 1, "query_review_status_invalid": 1, "candidate_not_train": 1, "dangling_qrel": 2, "qrel_claims_non_proxy_judgment": 1, "qrel_review_status_invalid": 1}
    assert errors(validation.retrieval_errors(q, c, j, spark.range(0))) == want
    assert errors(validation.retrieval_errors(q, c, j, spark.range(3))) == {**want, "reviewed_qrels_must_be_empty_before_human_review": 3}


def test_report_of_splits(spark):
    schema = "split string, label_ids array<int>, review_status string, fact_sha256 string, group_id string"
    known = F.array(F.lit(0), F.lit(1))
    good = [("train", [0, 1], "unreviewed", "a", "g"), ("train", [], None, "b", "g"), ("test", None, "unreviewed", "c", None), ("train", [0], "x", None, None)]
    report = validation.dataset_report(spark.createDataFrame(good, schema), known)
    assert validation.is_valid(report) and {(r["splits"], r["n"]) for r in report.where("check = 'size'").collect()} == {("train", 3), ("test", 1)}
    bad = good + [("test", [0, 5], "manually_reviewed", "a", "g"), ("validation", [0], "", "a", "h")]
    report = validation.dataset_report(spark.createDataFrame(bad, schema), known)
    got = {(r["check"], r["splits"]): r["n"] for r in report.where("n > 0 and check <> 'size'").collect()}
    assert not validation.is_valid(report)
    assert got == {("invalid_label_rows", "test"): 1, ("manually_reviewed_rows", "test"): 1, ("shared_facts", "test|train"): 1, ("shared_facts", "test|validation"): 1, ("shared_facts", "train|validation"): 1, ("shared_groups", "test|train"): 1}


def test_findings_of_sentencing_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, -1, "判处死刑"), (3, 100_000_000, None), (4, 0, "x")], "id int, fine long, t string")
    got = validation.sentencing_findings(df, "fine", "t", "判处死刑|并处罚金")
    assert {(r["id"], r["finding"]) for r in got.collect()} == {(1, "invalid_fine"), (2, "invalid_fine"), (2, "residual_marker"), (3, "fine_outlier")}


def test_external_report(spark):
    df = spark.createDataFrame([("ab", None, "positive", 5), ("ab", "2020", "positive", 9), ("abc", "2020", "zero", 0), ("", "1999", "positive", 1), (None, None, None, None)], "t string, y string, s string, f int")
    got = {(r["section"], r["key"]): r["value"] for r in audits.external_report(df, "t", "y", "s", "f", [], [("b", "b")], [("a", "a")], None).collect()}
    assert got == {
        ("counters", "rows"): 5, ("counters", "empty_texts"): 2, ("counters", "private_hits"): 3, ("counters", "private_rows"): 3, ("counters", "leakage_hits"): 3, ("counters", "leaking_rows"): 3, ("counters", "duplicates"): 1,
        ("years", "missing"): 1, ("years", "2020"): 2, ("fines", "positive"): 2, ("fines", "zero"): 1,
        ("lengths", "p50"): 2, ("lengths", "p90"): 2, ("lengths", "p99"): 2, ("lengths", "p100"): 3,
        ("positive_fines", "p50"): 5, ("positive_fines", "p90"): 5, ("positive_fines", "p99"): 5, ("positive_fines", "p100"): 9,
    }
