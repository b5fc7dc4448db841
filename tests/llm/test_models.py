"""Held-out accuracy and gradients of the trained models."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievework.llm import langid, quality, queries, textops

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def test_quality_on_held_out_documents(spark):
    out = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null")
    r = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("all"), F.avg(F.when(F.col("quality") == 0, (F.col("predicted") == 0).cast("int"))).alias("bad"), F.avg(F.when(F.col("quality") == 1, (F.col("predicted") == 1).cast("int"))).alias("good")).first()
    assert r["all"] > 0.97 and r["bad"] > 0.85 and r["good"] > 0.99


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "a b c", 9.0), (4, "A!! " * 50_000, 9.0), (4, "again", 9.0), (None, "x", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (99, 1), (None, 1), (1, None)], "doc_id long, quality int")
    out = quality.scored(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).collect() == []


def test_one_class():
    m = quality.fit(np.array([1, 2]), np.array([0, 1, 2]), np.array([1, 1]))
    assert (quality.score(m, np.array([1]), np.array([0, 1])) > 0.99).all()


def test_dual_solution_is_the_optimum():
    """Beside a plain projected-gradient solver of the same dual problem, and the gap to the primal one."""
    rng = np.random.default_rng(2)
    dense = rng.standard_normal((40, 12)) * (rng.random((40, 12)) < 0.5)
    dense[:, 0] = 1
    dense /= np.sqrt((dense**2).sum(axis=1))[:, None]
    sign = np.where(dense @ rng.standard_normal(12) + 0.3 * rng.standard_normal(40) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 2.0, 3.0)
    doc, idx = np.nonzero(dense)
    at = np.searchsorted(doc, np.arange(41))
    w, bias, alpha = quality.dual(idx, dense[doc, idx], at, sign, cost, 12, epochs=3000)

    z = np.hstack([dense, np.ones((40, 1))]) * sign[:, None]
    gram, plain = z @ z.T, np.zeros(40)
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        plain = np.clip(plain - rate * (gram @ plain - 1), 0, cost)
    assert np.allclose(np.append(w, bias), z.T @ plain, atol=1e-3)
    assert np.allclose(np.append(w, bias), z.T @ alpha)
    primal = 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - z @ np.append(w, bias))).sum()
    assert abs(primal - (alpha.sum() - 0.5 * alpha @ gram @ alpha)) < 1e-3 * primal


def test_quality_query_beside_a_plain_version(spark):
    """Every document's score, from features and sums made one by one."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SMALL).collect()}
    for r in docs.collect():
        idx, at = quality.features(*textops.byte_view(pa.array([r["text"] or ""])))
        weight = sum(float(model["w"][i]) for i in idx.tolist()) / (sum(float(model["r2"][i]) for i in idx.tolist()) ** 0.5 + 1e-9)
        want = 1 / (1 + np.exp(-(model["a"] * (weight + model["bias"]) + model["b"])))
        out = got[r["doc_id"]]
        assert abs(out["score"] - want) < 1e-4 and out["predicted"] == int(out["score"] >= 0.5)
        assert out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_language_of_held_out_documents(spark):
    out = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, x, "own") for i, (t, x) in enumerate([("the of and " * 30, "en"), ("le la des " * 30, "fr"), (None, "en"), ("", None), ("12 34 !?", "fr"), ("é", None), ("the " * 50_000, "en")])], "doc_id long, text string, lang string, has_letter string")
    net = langid.train(docs, F.lit(True))
    out = {r["doc_id"]: r for r in langid.predict(docs, net).collect()}
    assert all(r["has_letter"] == "own" for r in out.values())
    assert [out[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and all(out[i]["score"] == 0 for i in (2, 3, 4))
    assert out[0]["lang_pred"] == "en" and out[1]["lang_pred"] == "fr" and out[6]["lang_pred"] == "en" and out[5]["lang_pred"] in ("en", "fr")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs, F.lit(False))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.BiGRU(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, y = rng.integers(97, 101, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    mask = np.arange(7)[None, :] < np.array([7, 7, 4, 1, 6])[:, None]

    def loss():
        h = {}
        for d in "fb":
            s, states = np.zeros((5, 3)), {}
            for t in range(7) if d == "f" else range(6, -1, -1):
                s = net._step(net.p["x" + d][rows[:, t]], s, net.p["u" + d])[0]
                s = s * mask[:, t, None] if d == "b" else s
                states[t] = s
            h[d] = states
        total = 0.0
        for t in range(7):
            e = h["f"][t] @ net.p["wf"] + h["b"][t] @ net.p["wb"] + net.p["c"]
            e = e - np.log(np.exp(e).sum(axis=1, keepdims=True))
            total -= (e[np.arange(5), y] * mask[:, t]).sum()
        return total / mask.sum()

    g = net.gradients(rows, mask, y)
    for k, v in net.p.items():
        flat, got = v.reshape(-1), g[k].reshape(-1)
        for i in [*rng.integers(0, len(flat), 6), *(np.flatnonzero(got)[:4])]:
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - got[i]) < 1e-4, k


def test_training_and_inference_agree():
    rng = np.random.default_rng(1)
    net = langid.BiGRU(["a", "b"])
    rows = rng.integers(97, 122, (9, langid.WINDOW)).astype(np.uint8)
    mask = np.arange(langid.WINDOW)[None, :] < np.array([64, 64, 10, 1, 63, 64, 2, 30, 64])[:, None]
    hf, hb = np.zeros((9, 8), np.float32), np.zeros((9, 8), np.float32)
    first, want = [], np.zeros((9, 2))
    for t in range(langid.WINDOW):
        hf = net._step(net.p["xf"][rows[:, t]], hf, net.p["uf"])[0]
        first.append(hf)
    for t in range(langid.WINDOW - 1, -1, -1):
        hb = net._step(net.p["xb"][rows[:, t]], hb, net.p["ub"])[0] * mask[:, t, None]
        e = np.exp(first[t] @ net.p["wf"] + hb @ net.p["wb"] + net.p["c"])
        want += e / e.sum(axis=1, keepdims=True) * mask[:, t, None]
    assert np.allclose(net.run(rows, mask), want, atol=1e-3)
