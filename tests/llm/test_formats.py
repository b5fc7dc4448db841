"""Round trips of the formats, exact search and packing."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import chat, packing, queries, storage, textops, token_store, tokens, topk

from .test_texts import thue_morse

TEXTS = [*thue_morse(10), "Hello, world.Foo bar's!", "", None, "a <|endoftext|> b.c,d <|ENDOFTEXT|>x", "it's don't.it", "é, € , €,x 12,3.4 ... a...b!!, Ünḯ İ x", "  \n\t ", "क़ख़ x ǅ Σς", "word " * 20_000, "Hello, world.Foo bar's!"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]


def test_chunks_encode_like_whole_texts(spark, whole):
    sample = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = TEXTS + sample
    ids, off = tokens.encoder(tokens.tokenizer_path()).encode(*textops.byte_view(pa.array([t or "" for t in texts])))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == whole(t)


def test_store_round_trip(spark, whole):
    rows = [(i * 7 - 20, t, "x") for i, t in enumerate(TEXTS)] + [(None, "none", "x"), (1, "twice", "x"), (1, "twice more", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    store = token_store.write_store(df, storage.fresh_uri(spark, "ids"), shards=3)
    got = sorted(token_store.read_digests(spark, store).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (k, t, _) in zip(got, want, strict=True):
        ids = whole(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), tokens.crc(np.array(ids)))
        at += len(ids)
    assert [x.tolist() for x in store.get(1)] == [whole(t) for k, t, _ in want if k == 1]
    assert [x.tolist() for x in store.get(None)] == [whole("none")]
    assert store.get(123456) == []


def test_store_of_nothing(spark):
    store = token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), storage.fresh_uri(spark, "ids"))
    assert store.shards == [] and token_store.read_digests(spark, store).collect() == [] and store.get(1) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_011])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    seeds = token_store.build_mph(keys)
    if n:
        assert sorted(token_store.mph_slots(seeds, len(keys), keys).tolist()) == list(range(len(keys)))


def check_packing(pieces, texts, whole, window=packing.WINDOW):
    filled, seen = defaultdict(int), defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = whole(texts[r["doc_id"]])
        assert r["offset"] == filled[r["sequence_id"]] and r["length"] > 0
        filled[r["sequence_id"]] += r["length"]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == tokens.crc(np.array(ids[r["start"] : r["start"] + r["length"]]))
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == seen[r["doc_id"]]
        seen[r["doc_id"]] += r["length"]
    assert all(seen[d] == len(whole(t)) for d, t in texts.items())
    assert all(n <= window and n & (n - 1) == 0 for n in filled.values())


def test_packing(spark, whole):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()} | {10_000 + i: t for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int").repartition(3)
    check_packing(packing.pack(df).collect(), texts, whole)
    check_packing(packing.pack(df, shard_bytes=50_000).collect(), texts, whole)
    assert packing.pack(df.limit(0)).collect() == []
    assert len(packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()) == 1


def test_packing_takes_neighbours():
    # documents of two kinds, each too short for a window: a window holds one kind
    ids, off = [], [0]
    for d in range(40):
        base = 100 if d % 2 else 5000
        ids += [base + (i * 7 + d) % 50 for i in range(99)] + [2]
        off.append(len(ids))
    pieces = packing.pack_shard(np.array(ids, np.uint32), np.array(off), 400)
    kinds = defaultdict(set)
    for d, _, _, seq, _ in pieces:
        kinds[seq].add(d % 2)
    assert sum(len(k) == 1 for k in kinds.values()) >= len(kinds) - 2


def test_packing_finds_neighbours_in_other_shards(spark):
    # documents of ten subjects, each too short for a window, in shards of a few documents
    rng = random.Random(4)
    words = [["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)] for _ in range(10)]
    rows = [(d, " ".join(rng.choices(words[d % 10], k=60))) for d in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=1024, shard_bytes=4000).collect()
    kinds = defaultdict(list)
    for r in pieces:
        kinds[r["sequence_id"]].append(r["doc_id"] % 10)
    pure = sum(max(map(k.count, k)) for k in kinds.values()) / len(pieces)
    assert pure > 0.8, pure


def test_packing_asks_with_all_terms():
    # the seed's rarest terms are its own; what it shares with one other document is more common
    own, shared = list(range(1000, 1030)), list(range(100, 140))
    docs = [own + shared, *[[k, 2] for k in range(200, 230)], shared + [2], *[[*range(100, 140, 8), 50 + k] for k in range(8)]]
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    pieces = packing.pack_shard(np.concatenate(docs).astype(np.uint32), off, 100)
    assert [p[0] for p in pieces][:2] == [0, 31]


def test_packing_lanes_take_the_best_of_all_shards():
    rng = np.random.default_rng(8)
    docs = [np.append(rng.choice(300, rng.integers(1, 60), p=np.arange(300) / np.arange(300).sum()) + 3, 2) for _ in range(150)]
    ids, off = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    size, cut = np.diff(off), [0, 40, 41, 97, 150]
    df = np.zeros(400, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    index = packing.ShardIndex(ids, off)
    own = [np.unique(d) for d in docs]
    shards = [(size[a:b], *packing.postings(ids[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in zip(cut, cut[1:])]
    for share in (0.01, 0.6):  # all terms in the matrix, or few

        def neighbours(seeds, rooms, free):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(packing, "DENSE_SHARE", share)
                sets = [own[s] for s in seeds]
                q = packing.Query(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), rooms, free, dict(enumerate(cut)), df, len(docs), size.mean())
            found = [x for k, s in enumerate(shards) for x in q.ask(k, *s)]
            k, doc, score, _, more = packing.best(*(np.concatenate(x) for x in zip(*found)), q.enough) if found else [np.zeros(0, np.int64)] * 5
            for i, s in enumerate(seeds):  # what is certain is the head of the full ranking
                want = np.where(free, index.scores(s), 0)
                got = doc[k == i]
                assert np.allclose(score[k == i], np.sort(want)[::-1][: len(got)], rtol=1e-4)
            return k, doc, score, more.astype(bool)

        assert [p for batch in packing.pack_lanes(size, 1, 128, neighbours) for p in batch] == packing.pack_shard(ids, off, 128)
        many = [p for batch in packing.pack_lanes(size, 5, 128, neighbours) for p in batch]
        assert sum(p[2] for p in many) == len(ids)


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["\\", "\\l", "\\b", "<", ">", "</turn>", "<turn new assistant>", "word", "é😀", "\n", " ", "\\\\g", "\\### Assistant: </turn> ok"]
    rows = [(c, t if rng.random() < 0.9 else 3, rng.choice(["system", "user", "assistant", "assistant", "<o>", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) if rng.random() < 0.9 else None) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", "long text " * rng.randrange(1, 400)) for t in range(700)] + [(None, 0, "user", "x"), (None, None, "assistant", "y"), (60, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, place int").repartition(3)
    formatted = chat.windows(df, 200, 60)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == brute_chat(rows)
    again = chat.parse(formatted).where("kind = 'again'").count()
    assert again > 5
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_chat_windows_keep_the_budget(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "a b c d e f g h") for t in range(1, 60)], "conv_id long, turn long, role string, text string")
    for r in chat.windows(df, 50, 20).collect():
        assert r["n_tokens"] <= 50 + 10 + 20 + 10 + 4
        assert "system>be kind</turn>" in r["formatted"]


def test_chat_history_is_bounded(spark):
    sizes = random.Random(4).choices([5, 40, 90, 200, 1500], k=60)
    turns = [(1, None, "user", "first of all"), (1, -300, "system", "s " * 400)] + [(1, t, "user", "w " * n) for t, n in enumerate(sizes)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(df)
    read = chat.parse(formatted).withColumn("n", chat.turn_tokens(F.col("text"))).orderBy("window", "at").collect()
    assert [(r["role"], r["text"]) for r in read if r["kind"] == "new"] == [(r, t) for _, _, r, t in turns]
    history, system = defaultdict(int), defaultdict(int)
    for r in read:
        if r["kind"] == "again":
            (system if r["role"] == "system" else history)[r["window"]] += r["n"]
    assert history and max(history.values()) <= chat.HISTORY
    assert system and max(system.values()) <= chat.SYSTEM and len(system) >= len({r["window"] for r in read}) - 1
    assert {r["window"]: r["n_tokens"] for r in formatted.collect()} == {w: sum(r["n"] for r in read if r["window"] == w) for w in {r["window"] for r in read}}


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(60)] + [(400, None), (500, [float("nan")] * 6), (600, [None] * 6), (700, [1.0] * 3), (701, [0.5] * 3), (800, [float("inf")] + [0.0] * 5), (900, [3e7] * 6), (900, [3e7] * 6), (None, [1.0] * 6), (1000, []), (1001, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = defaultdict(list)
    for r in topk.exact_topk(df, df.where("vec_id % 100 = 0"), 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 100:
            continue
        want = sorted(((-sum(a * b for a, b in zip(v, w)), k) for k, w in good if k != q and len(w) == len(v)))[:10]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    assert set(got) <= {q for q, _ in good if q % 100 == 0}
    small = topk.exact_topk(df.where("vec_id < 30"), df.where("vec_id = 0"), 10, block=1).collect()
    assert len(small) == 10
    assert topk.exact_topk(df.limit(0), df.limit(0)).collect() == []


def test_chat_query_holds_the_probe(spark):
    r = {x["conv_id"]: x for x in queries.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}[-7]
    p = queries.PROBE
    assert r["n_turns"] == 2 and r["loss_chars"] == len(p) and r["loss_sha256"] == hashlib.sha256(p.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{p}\nassistant\n{p}\n".encode()).hexdigest()


def test_packing_answers_are_merged_and_asked_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(3, 60, rng.integers(2, 12))) for _ in range(90)]
    ids, off = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    size, df = np.diff(off), np.bincount(ids, minlength=60)
    own = docs[:20]
    q = packing.Query(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.full(20, 40), np.ones(90, bool), {0: 0}, df, 90, size.mean())

    def asked():
        return [np.concatenate(x) for x in zip(*q.ask(0, size, *packing.postings(ids, off)))]

    whole = packing.best(*asked(), q.enough)
    monkeypatch.setattr(packing, "CELLS", 7 * 1024)  # seven documents at once
    parts = asked()
    assert len(parts[0]) > len(whole[0])
    for got, want in zip(packing.best(*parts, q.enough), whole):
        assert np.allclose(got, want)
    # what reaches the driver is some windows of documents for each seed, however many tasks have answered
    monkeypatch.setattr(packing, "MERGED", packing.ANSWER)
    seed = packing._answers(*(x[parts[0] == 3] for x in parts))
    merged = packing._merger(SimpleNamespace(value=q))(seed)
    assert merged.num_rows < seed.num_rows and sum(merged.column("size").to_pylist()[:-1]) < 40
    assert merged.column("doc").to_pylist() == whole[1][whole[0] == 3].tolist()


def test_packing_indexes_in_bounded_memory():
    # pairs are counted a few documents at a time, so a shard's tokens are never sorted at once
    rng = np.random.default_rng(6)
    size = rng.integers(1, 2000, 1500)
    ids, off = rng.zipf(1.3, size.sum()).clip(max=40_000).astype(np.uint32), np.concatenate([[0], np.cumsum(size)])
    tracemalloc.start()
    term, doc, tf = packing.postings(ids, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(ids), peak  # 31 before
    pairs, counts = np.unique(ids.astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
    assert np.array_equal(term * len(size) + doc, pairs) and np.array_equal(tf, counts)


def test_packing_workers_keep_few_chunks(monkeypatch):
    texts = [" ".join(f"{a}{b}" for a in "abcdefgh" for b in range(k, k + 9)) for k in range(40)]
    table = pa.table({"doc_id": list(range(40)), "text": texts})
    monkeypatch.setattr(packing, "CHUNKS", 100)
    monkeypatch.setattr(packing, "TEXT", 600)
    got = packing._encoded(tokens.tokenizer_path(), 2, table)
    held = tokens.encoder(tokens.tokenizer_path(), 100)
    assert len(held.keys) <= 300
    plain = [np.append(held.tok.encode(t, add_special_tokens=False).ids, 2) for t in texts]
    assert np.array_equal(got[1], np.concatenate(plain)) and np.array_equal(np.diff(got[2]), [len(x) for x in plain])
