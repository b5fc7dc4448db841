"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratio of the two classes, and
a linear hinge-loss model is fitted to them by dual coordinate descent. The
n-grams are of words, of word shapes (case, digits and punctuation with runs
collapsed) and of repetitions, hashed into 2**``BITS`` features.

The fit takes a bounded sample of labelled rows: the ``SAMPLE`` first by a hash
of their id. Every text is scored whole.

Nulls and edge cases: null and empty texts have no features and get the score of
the bias; labels that are null or of unknown documents are left out; of several
labels of a document the least counts; with labels of one class only, every
score is that class's; without labels every score is 0.5; repeated rows are
scored alike; other columns are kept, but for those whose names the result has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

BITS, SAMPLE = 18, 6000
_EPOCHS, _C, _ALPHA = 12, 0.1, 1.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("x")
_SHAPE[65:91] = ord("X")
_SHAPE[48:58] = ord("9")


def _collapsed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shapes of the bytes, runs of one shape as one byte."""
    shape = _SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[off[:-1][off[:-1] < len(shape)]] = True
    return shape[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each document, and n+1 offsets."""
    found = []
    h, _, _, at = textops.words(data, off, textops.SPACE, lower=True)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    found.append((h, doc))
    # a word that comes again after one to eight others
    for gap in (1, 2, 4, 8):
        again = np.flatnonzero((h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])) + gap
        found.append((np.full(len(again), gap, np.uint64), doc[again]))
    shape, shape_off = _collapsed(data, off)
    s, _, _, sat = textops.words(shape, shape_off, textops.SPACE, lower=False)
    for n in (1, 2, 3):
        g, _, d = textops.ngrams(s, sat, n)
        found.append((g, d))
    keys = [(d.astype(np.uint64) << np.uint64(bits)) + (textops.mix(f + np.uint64(977 * k)) >> np.uint64(64 - bits)) for k, (f, d) in enumerate(found)]
    keys = np.unique(np.concatenate(keys))
    doc = keys >> np.uint64(bits)
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(doc, np.arange(len(off), dtype=np.uint64))


def dual(idx: np.ndarray, x: np.ndarray, at: np.ndarray, sign: np.ndarray, cost: np.ndarray, dim: int, epochs: int = _EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of a linear hinge-loss model, by dual coordinate descent.

    Rows x[at[i]:at[i + 1]] at features idx have length 1; the bias is one more
    feature of value 1. Minimises (|w|^2 + bias^2) / 2 + sum of cost times hinge loss.
    """
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(sign))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(sign)):
            own, val = idx[at[i] : at[i + 1]], x[at[i] : at[i + 1]]
            grad = sign[i] * (w[own] @ val + bias) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), cost[i])  # |x|^2 + 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[own] += step * val
                bias += step
    return w, bias, alpha


def fit(idx: np.ndarray, at: np.ndarray, y: np.ndarray, bits: int = BITS) -> dict:
    """The model of documents (features idx[at[i]:at[i + 1]]) with labels y of 0 and 1.

    score = 1 / (1 + exp(-(a * margin + b))), margin = weights of a document's
    features + bias.
    """
    dim = 1 << bits
    if len(y) == 0 or y.min() == y.max():
        return {"w": np.zeros(dim, np.float32), "bias": 0.0, "a": 0.0, "b": 0.0 if len(y) == 0 else 20.0 * (2 * int(y[0]) - 1)}
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    pos = np.bincount(idx, weights=y[doc] == 1, minlength=dim) + _ALPHA
    neg = np.bincount(idx, weights=y[doc] == 0, minlength=dim) + _ALPHA
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    ratio[np.bincount(idx, minlength=dim) < 3] = 0
    # rows of unit length, so that long texts don't outweigh short ones
    x = ratio[idx]
    norm = np.sqrt(np.bincount(doc, weights=x * x, minlength=len(y))) + 1e-9
    sign, cost = np.where(y == 1, 1.0, -1.0), np.where(y == 1, _C * len(y) / (2 * (y == 1).sum()), _C * len(y) / (2 * (y == 0).sum())) * 50
    w, bias, _ = dual(idx, x / norm[doc], at, sign, cost, dim)
    margin = np.bincount(doc, weights=w[idx] * x, minlength=len(y)) / norm + bias
    a, b = _platt(margin, y)
    return {"w": (w * ratio).astype(np.float32), "r2": (ratio * ratio).astype(np.float32), "bias": bias, "a": a, "b": b}


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve through the margins, by Newton steps."""
    x = np.stack([margin, np.ones(len(y))], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    c = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c - np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * c)
    return max(float(c[0]), 1e-3), float(c[1])


def score(model: dict, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    if "r2" in model:
        doc = np.repeat(np.arange(n), np.diff(at))
        norm = np.sqrt(np.bincount(doc, weights=model["r2"][idx], minlength=n)) + 1e-9
        margin = np.bincount(doc, weights=model["w"][idx], minlength=n) / norm + model["bias"]
    else:
        margin = np.zeros(n)
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.slabs(batches, "text"):
        idx, at = features(*textops.byte_view(textops.text_column(batch, "text")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([idx[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["label", "idx"])


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fits a model on ``sample`` labelled documents at most that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("long").alias("label"))
    present = docs.select("doc_id").distinct()
    chosen = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of rows with the same id one text is learned from, so the sample is bounded whatever repeats
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("label", "text").mapInArrow(_featurised, "label long, idx binary").collect()
    parts = sorted((r["label"], bytes(r["idx"])) for r in rows)
    sets = [np.frombuffer(x, "<u4").astype(np.int64) for _, x in parts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return fit(np.concatenate([*sets, np.zeros(0, np.int64)]), at, np.array([y for y, _ in parts], dtype=np.int64))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slabs(batches, "text"):
            s = score(model.value, *features(*textops.byte_view(textops.text_column(batch, "text"))))
            names = [n for n in batch.schema.names if n != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(s)], [*names, "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with a score column: 0 to 1, higher if label 1 is likelier."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, sample))
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_scorer(model), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
