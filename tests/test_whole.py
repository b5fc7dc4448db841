"""Queries that do their whole job: nothing that a caller would find is left out."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.functions import features
from sievework.operators import dense, sentencing
from sievework.sources import files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, items):
    spark.createDataFrame([(*d, len(d[1])) for d in docs], DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def beside_sql(spark, folder, name):
    """Rows of a query, which equal those of its SQL."""
    df = entry.queries()[name](spark, folder)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(duck.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall())
    return got


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_saved_index"])
def test_every_term_of_a_query_finds_documents(spark, tmp_path, name):
    """The query has more than 64 terms; documents 2 and 3 share the weaker ones only, the latter one that nearly all have."""
    letters = [chr(0x4E00 + i) for i in range(100)]
    rare, weak = "".join(letters[:80]), "".join(letters[90:100])
    docs = [(1, rare, "en", "a"), (2, weak, "en", "a"), (3, "xy", "en", "b")] + [(i, f"xy{weak}", "en", "b") for i in range(4, 9)] + [(9, "", "en", "b")]
    got = beside_sql(spark, tables(spark, tmp_path, docs, [(1, rare + weak), (2, f"{rare} xy")]), name)
    assert {(1, 2), (2, 3)} <= {(r[0], r[1]) for r in got}


def test_hybrid_search_gives_one_hit_of_a_case(spark, tmp_path):
    docs = [(i, f"fraud and theft of money {i}", "en", "a" if i < 6 else f"s{i % 2}") for i in range(9)]
    folder = tables(spark, tmp_path, docs, [(1, "theft of money")])
    got = beside_sql(spark, folder, "hybrid_topk")
    sources = {d[0]: d[3] for d in docs}
    assert sorted(sources[r[1]] for r in got) == ["a", "s0", "s1"]


def test_letter_profiles_are_counted_in_bytes(spark):
    """As by functions; also for the two other characters with a small letter from a to z."""
    texts = ["", None, "Abc zZ", "\u212a\u0130k\u0131 \u00e4\U0001f600", "\u212a", "\u0130" * 3 + "x", "@[`{", "法律 K" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r[0]: r[1] for r in rows.where("text is not null").select("id", features.letter_profile(F.col("text"))).collect()}
    got = dense.letter_profiles(rows.coalesce(1))
    assert {r[0]: r[1] for r in got.collect()} == want and len(want) == 7
    plan = entry.queries()["hybrid_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan.lower()


def test_evidence_writes_no_vectors_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "shared_dir", lambda _: f"file://{tmp_path}")
    data = Path("/root/testdata/sf0.001")
    assert entry.queries()["sentencing_evidence"](spark, str(data)).count()
    assert not list(tmp_path.glob("vectors*"))


@pytest.mark.parametrize("block", [256, 3])
def test_texts_are_found_as_by_vectors(spark, monkeypatch, block):
    """Also of equal ids, with several labels or none, and in several blocks of queries."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd 法") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "a\x00", "abc\x00\x00d"] + ["abcd abcd"] * 8
    docs = [(i // 2 if i < 20 else i, t, rng.choice([["p"], ["q"], ["p", "q"], [], None, [None]])) for i, t in enumerate(texts)]
    asked = [(i, t, g) for i, (t, g) in enumerate([("abc da", ["p"]), ("dd法", []), ("", ["p"]), ("abcd abcd", ["q", "p"]), ("ab", None), ("c", ["z"]), ("bcda", ["q"]), ("abcd abcd", [None])])]
    docs = spark.createDataFrame(docs, "doc long, text string, labels array<string>")
    asked = spark.createDataFrame(asked, "query long, text string, labels array<string>")
    queries = sentencing.packed(asked.select(F.struct("query", "labels").alias("key"), "text"), "key", F.col("text")).select("key.*", "buckets", "weights")
    monkeypatch.setattr(sentencing.scan, "BLOCK", block)
    monkeypatch.setattr(sentencing, "OFTEN", 2)
    got = sorted(map(tuple, sentencing.similar_texts(docs, queries, 1, 5).collect()))
    monkeypatch.setattr(sentencing, "SENT", 0)
    want = sorted(map(tuple, sentencing.similar_texts(docs, queries, 1, 5).collect()))
    assert got == want and {r[0] for r in got} == {0, 1, 3, 4, 6, 7}
