"""The pipeline beside a version of each stage that compares everything with everything."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline

from sievework.llm import line_dedup, packing, quality, textops, tokens

from .test_texts import classes, contained, lines_kept

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = docs.orderBy("doc_id").collect()
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = quality.score(model, *quality.features(*textops.byte_view(pa.array([r["text"] or "" for r in table]))))
    kept = [(r["doc_id"], r["text"]) for r, s in zip(table, score) if s >= 0.5]
    assert 0 < len(kept) < len(table)
    lines = lines_kept(kept, line_dedup.THRESHOLD, line_dedup.MIN_CHARS)
    kept = [(i, lines[i]) for i, t in kept if lines[i] == t or lines[i].strip()]
    same = classes(dict(kept), 5, Fraction(4, 5))
    kept = [(i, t) for i, t in kept if same[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = contained(kept, items, 10)
    want = {i: t for i, t in kept if not hit[i][1]}

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    filled, seen = defaultdict(int), defaultdict(int)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [tokens.END_ID]) for i, t in want.items()}
    for r in pieces:
        assert tokens.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        filled[r["sequence_id"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(x) for i, x in ids.items()) and max(filled.values()) <= packing.WINDOW


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_rows(spark):
    line = "a line of some forty characters, repeated often"
    rows = [
        (1, None, None, None, None, 1.0, ["x"], 7),
        (2, "", "en", "s", 0, None, None, None),
        (None, f"{line}\nmore", None, "s", None, 1.0, ["x"], 7),
        (3, f"{line}\nmore of it", "en", "s", 9, 1.0, ["x"], 7),
        (3, f"{line}\nmore of it", "en", "s", 9, 1.0, ["x"], 7),
        (4, line, "en", "s", 9, 1.0, ["x"], 7),
        (5, "very long words " * 40_000, "en", "s", 9, 1.0, ["x"], 7),
        (6, "very long words " * 40_000 + "end", "en", "s", 9, 1.0, ["x"], 7),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, items array<string>, tkey int")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if docs is not odd:
                assert got == []
            elif name == "line_dedup":
                # the null id comes first; equal rows are one document; 4 has nothing left
                assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["doc_id"] not in (5, 6)) == sorted([("None", f"{line}\nmore"), ("1", None), ("2", ""), ("3", "more of it"), ("3", "more of it")])
                assert all(r["tkey"] in (7, None) for r in got)
            elif name == "ngram_jaccard_join":
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "5", "6", "None"]
