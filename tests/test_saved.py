"""Publication and saved search indexes."""

from __future__ import annotations

import os
import random
import shutil

import numpy as np
import pytest

from sievework.operators import bm25, dense, saved
from sievework.sources.publish import Publication

TEXT = "sphinx of black quartz judge my vow the five boxing wizards jump quickly "


def corpus(spark, n=60):
    rng = random.Random(2)
    words = TEXT.split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30))), "ab"[i % 2]) for i in range(n)] + [(n, None, "a"), (n + 1, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_a_reader_always_finds_a_whole_version(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        p.read()
    first = p.publish(spark.range(3), rows=3)
    staged = p.stage()
    spark.range(5).write.parquet(staged)
    assert p.read().count() == 3  # written, but not committed
    (tmp_path / "t/commits/0000000002.json").write_text("")  # a commit that is being written
    assert p.current()["number"] == 1 and p.read().count() == 3
    second = p.commit(staged, rows=5)
    assert (second["number"], p.read().count(), p.current()["rows"]) == (3, 5, 5)
    with pytest.raises(RuntimeError, match="has changed"):
        p.commit(staged, expected=first["number"])
    with pytest.raises(Exception, match="(?i)exists"):  # two writers of one number
        p.files.create(f"{p.root}/commits/0000000003.json", "{}")
    back = p.rollback()
    assert p.read().count() == 3 and back["rolled_back_from"] == second["version"] and back["rows"] == 3
    p.publish(spark.range(7))
    left = p.stage()
    spark.range(1).write.parquet(left)
    assert len(p.vacuum(keep=2)) == 2  # the second version and what was never committed
    assert p.read().count() == 7 and p.rollback()["version"] == first["version"] and p.read().count() == 3


@pytest.mark.parametrize("part", [None, "lang"])
@pytest.mark.parametrize("hot", [saved.HOT, 5])
def test_sparse_search_from_disk(spark, tmp_path, part, hot):
    docs = corpus(spark)
    index, root = bm25.build(docs, "doc_id", "text", part), f"file://{tmp_path}/i"
    commit = saved.save_sparse(index, root, hot=hot)
    loaded = saved.load_sparse(spark, root)
    assert (loaded.vocabulary.agg({"salts": "max"}).first()[0] > 1) == (hot == 5)
    kept = [commit["tables"][t]["rows"] for t in ("postings", "cold", "hot") if t in commit["tables"]]
    assert sum(kept) == index.terms.count() and len(kept) == (1 if hot > 5 else 2)
    queries = spark.createDataFrame([(1, "black wizards"), (2, "zzz"), (3, None), (4, TEXT)], "q long, t string")
    want = sorted(bm25.scores(index, queries, "q", "t").collect(), key=str)
    got = bm25.scores(loaded, queries, "q", "t")
    assert want and sorted(got.collect(), key=str) == want
    # of the postings nothing is shuffled before the sums by document
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "tf" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-")) < depth]
    join = max(i for i, x in enumerate(above) if "ShuffledHashJoin" in x)
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x or "Sort" in x.replace("SortMerge", "") for x in above[join:])


def test_dense_search_from_disk(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], [["x"], ["x", "y"], ["y", "z"], []][i % 4]) for i in range(90)] + [(90, None, ["x"]), (91, [1.0, float("nan")], ["x"]), (92, [], ["x"]), (93, [0.0] * 6, ["y"]), (93, [1.0] * 6, ["z"])]
    df = spark.createDataFrame(rows, "id long, v array<double>, g array<string>")
    asked = df.where("id % 10 = 0 or id > 89")
    for gate in (None, "g"):
        root = f"file://{tmp_path}/{gate}"
        saved.save_dense(df, root, "id", "v", gate)
        want = sorted(map(str, dense.search(df, asked, "id", "v", 4, gate).collect()))
        assert want and sorted(map(str, saved.search_dense(spark, root, asked, "id", "v", 4, gate).collect())) == want
        with pytest.raises(ValueError, match="gate"):
            saved.search_dense(spark, root, asked, "id", "v", 4, None if gate else "g")


def test_small_blocks_give_the_same_hits(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(150, 4)), 1)  # many ties
    df = spark.createDataFrame([(i, [float(x) for x in v[i % 100]], int(i % 3)) for i in range(150)], "id long, v array<double>, g int")
    unit = v[np.arange(150) % 100] / np.maximum(np.linalg.norm(v[np.arange(150) % 100], axis=1, keepdims=True), 1e-9)
    score = np.round(unit @ unit.T, 9)
    for gate in (None, "g"):
        stored = dense.blocks(df, "id", "v", gate, size=32 * 7)
        assert stored.count() > 15 and stored.selectExpr("max(size(rows))").first()[0] < 40
        got = {}
        for r in dense.search_blocks(stored, df, "id", "v", 5, gate).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["doc"])
        for q in range(150):
            others = [d for d in range(150) if d != q and (gate is None or d % 3 == q % 3)]
            assert got[q] == sorted(others, key=lambda d: (-score[q, d], d))[:5]


def test_a_damaged_index_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    saved.save_sparse(bm25.build(corpus(spark), "doc_id", "text"), root)
    with pytest.raises(ValueError, match="not dense"):
        saved.load(spark, root, "dense")
    folder = Publication(spark, root).folder().removeprefix("file://") + "/postings"
    lost = max((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: os.path.getsize(f"{folder}/{f}"))
    shutil.move(f"{folder}/{lost}", tmp_path / "lost")
    with pytest.raises(ValueError, match="rows instead of"):
        saved.load_sparse(spark, root)


def test_sparse_search_is_exact_with_few_candidates(spark):
    from pyspark.sql import functions as F

    from sievework.operators import sparse

    rng = np.random.default_rng(6)
    chance = 1 / np.arange(1, 3001)

    def vector(topic):
        b = np.unique(np.concatenate([rng.choice(3000, 12, p=chance / chance.sum()), topic]))
        w = rng.integers(1, 6, len(b)).astype(float)
        return [int(x) for x in b], [float(x) for x in w / np.sqrt((w * w).sum())]

    topics = [rng.choice(np.arange(500, 3000), 40) for _ in range(30)]
    docs = [(i, *vector(rng.choice(topics[i % 30], 90)), [["a"], ["a", "b"], [], None, ["c", None]][i % 5]) for i in range(1500)]
    docs += [(2000 + i, *docs[3][1:3], ["b"]) for i in range(30)] + [(3000, [], [], ["a"])]  # ties, and a text without grams
    asked = [(i, *vector(rng.choice(topics[i % 30], 90)), [["a"], ["b", "c"], []][i % 3]) for i in range(40)] + [(90, [5000], [1.0], ["a"]), (91, [], [], ["a"])]
    d = spark.createDataFrame(docs, "doc long, buckets array<int>, weights array<double>, labels array<string>")
    q = spark.createDataFrame(asked, "query long, buckets array<int>, weights array<double>, labels array<string>")
    k, want, pairs = 7, {}, 0
    for query, b, w, labels in asked:
        mine, found = dict(zip(b, w)), []
        for doc, db, dw, dl in docs:
            s = sum(mine[x] * y for x, y in zip(db, dw) if x in mine)
            if s > 0 and (not labels or set(labels) & set(dl or [])):
                found.append((-round(s, 9), doc))
        pairs += len(found)
        want[query] = [(doc, -s) for s, doc in sorted(found)[:k]]
    got: dict = {query: [] for query in want}
    for r in sparse.nearest(d, q, "doc", "query", k, F.col("labels"), F.col("labels")).orderBy("query", F.desc("cosine"), "doc").collect():
        got[r["query"]].append((r["doc"], r["cosine"]))
    assert {x: [doc for doc, _ in v] for x, v in got.items()} == {x: [doc for doc, _ in v] for x, v in want.items()}
    for size in (4000, sparse.BLOCK):  # many blocks, or one
        stored = sparse.blocks(d, "doc", sparse.gates(F.col("labels")), size)
        few = sparse.candidates(stored, sparse.blocks(q, "query", sparse.asked_gates(F.col("labels"))), k).count()
        assert few < pairs / (2 if size == 4000 else 10)
    # documents that are verified with all buckets are few
    block = sparse._Inverted(np.array([x[0] for x in docs[:1500]]), np.cumsum([0] + [len(x[1]) for x in docs[:1500]]), np.concatenate([x[1] for x in docs[:1500]]), np.concatenate([x[2] for x in docs[:1500]]))
    for _, b, w, _ in asked[:40]:
        block.best(np.array(b), np.array(w), k, -1.0)
    assert block.verified < 0.3 * 40 * 1500
