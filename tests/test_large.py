"""Rows and figures that must not grow with the postings, grams and sentences of the texts."""

from __future__ import annotations

import pytest

from sievework.operators import bm25, saved

TEXT = "sphinx of black quartz judge my vow the five boxing wizards jump quickly"


@pytest.mark.parametrize("hot", [saved.HOT, 5])
def test_a_saved_index_holds_postings_in_lists(spark, tmp_path, hot):
    rows = [(i, " ".join(TEXT.split()[i % 5 : 5 + i % 9]), "ab"[i % 2]) for i in range(300)] + [(300, None, "a"), (301, "x", "b"), (302, "é\x00", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    index, root = bm25.build(docs, "doc_id", "text", "lang"), f"file://{tmp_path}/i"
    saved.save_sparse(index, root, hot=hot)
    loaded = saved.load_sparse(spark, root)
    assert loaded.slabs.count() < index.terms.count() / 5
    columns = ["doc", "part", "dl", "term", "tf"]
    assert sorted(map(tuple, loaded.terms.select(columns).collect())) == sorted(map(tuple, index.terms.select(columns).collect()))
    queries = spark.createDataFrame([(1, "black wizards"), (2, "zzz"), (3, None), (4, TEXT), (5, "é\x00")], "q long, t string")
    for by_root in (False, True):
        want = bm25.top(bm25.best(index, queries, "q", "t", 4, by_root=by_root), 4, ["query", "part"])
        got = bm25.top(bm25.best(loaded, queries, "q", "t", 4, by_root=by_root), 4, ["query", "part"])
        columns = ["query", "part", "doc", "score", "rank"]
        assert want.count() and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_grams_of_many_letters_are_in_lists_too(spark):
    from sievework.operators import scan

    rows = [(i, "p", "".join(chr(0x4E00 + (i * 7919 + j * j) % 20000) for j in range(50)) + "ab ab") for i in range(2000)]
    texts = spark.createDataFrame(rows, "doc long, part string, text string").coalesce(1)
    for n in (1, 2, 3):
        want: dict = {}
        for doc, _, text in rows:
            plain = text.replace(" ", "")
            for j in range(len(plain) - n + 1):
                want[plain[j : j + n], doc] = want.get((plain[j : j + n], doc), 0) + 1
        found = scan.inverted(texts, n).collect()
        assert {(r["term"], d): tf for r in found for d, tf in zip(r["docs"], r["tfs"])} == want


def test_only_characters_that_nfkc_may_change_leave_the_jvm(spark):
    import re
    import sys
    import unicodedata

    from pyspark.sql import functions as F

    from sievework.functions import text

    changed = re.compile(text.CHANGED)
    safe = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and not changed.match(c)]
    assert len(safe) > 20000
    marks = [c for c in map(chr, range(0x300, 0x370))]
    for c in safe:
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
    assert all(changed.match(m) for m in marks)
    assert not any(changed.match(unicodedata.normalize("NFD", chr(i))[-1]) is None for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(i))) == chr(i) != unicodedata.normalize("NFD", chr(i)))
    rows = [(0, None), (1, ""), (2, "plain é ß"), (3, "é"), (4, "ﬁ １² x"), (5, "café̀"), (6, "가"), (7, "中文。「x」€—")]
    for r in spark.createDataFrame(rows, "id int, t string").select("t", text.nfkc(F.col("t")).alias("x")).collect():
        assert r["x"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"]))


def test_sentences_are_split_once_a_text(spark):
    import time

    from pyspark.sql import functions as F

    from sievework.functions.text import selected_sentences

    def seconds(n):
        df = spark.createDataFrame([("One more sentence. " * n,)], "t string")
        begin = time.perf_counter()
        assert len(df.select(selected_sentences(F.col("t"), ["more"], 100, ".").alias("x")).first()["x"]) <= 100
        return time.perf_counter() - begin

    seconds(10)
    assert seconds(8000) < 4 * seconds(800) + 2  # a hundred times as long, if each sentence splits the text


def test_boundaries_test_the_next_character_first(spark):
    import re

    from pyspark.sql import functions as F

    from sievework.functions.redaction import portable

    rows = ["a 1234 b", "x1234", "é1234 é", "1234é", "the theé ether _the the", "12345", ""]
    for pattern in (r"\b[0-9]{4}\b", r"\bthe\b", r"\b[0-9]?4", r"a|\bb", r"\\b", r"\b(?:the|e)\b", r"\bt?h"):
        df = spark.createDataFrame([(x,) for x in rows], "t string")
        got = [r[0] for r in df.select(F.regexp_count("t", F.lit(portable(pattern)))).collect()]
        assert got == [len(re.findall(pattern, x, re.ASCII)) for x in rows], pattern


def test_chunks_leave_a_task_in_slabs(spark, monkeypatch):
    from sievework.functions import chunking

    rows = [(i, "ab。" * (i % 300)) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "case_id long, fact string").coalesce(1)
    want = [(str(k), i, a, b, (t or "")[a:b]) for k, t in rows for i, (a, b) in enumerate(chunking.cuts(t or ""))]
    got = [(r["case_id"], r["chunk_index"], r["start_char"], r["end_char"], r["text"]) for r in chunking.chunks(df).collect()]
    assert sorted(got) == sorted(want)
