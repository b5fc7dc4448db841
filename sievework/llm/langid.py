"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, gives every
position a distribution over the languages, and a document has the mean of its
positions'. It is trained by backpropagation through time in numpy, with Adam,
on all windows of the whole texts of a bounded sample of documents (``SAMPLE``
first by a hash of their id); rows that are equal to a chosen one count once.

Nulls and edge cases: null texts and texts without a letter are ``und`` with
score 0; rows with null lang are not learned from; without any row to learn from
everything is ``und``; with one language every text with a letter is of it;
repeated rows are predicted alike; an empty table gives an empty result; other
columns are kept, but for those whose names the result has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

WINDOW, HIDDEN = 64, 8
SAMPLE = 1200
_STEPS, _BATCH, _RATE = 260, 192, 0.02
_ROWS = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class BiGRU:
    """Weights: per direction a table of byte inputs (256, 3H) and a recurrence (H, 3H); an output layer."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        self.langs, self.hidden = langs, hidden
        rng = np.random.default_rng(seed)
        k = len(langs)

        def normal(scale, *shape):
            return (scale * rng.standard_normal(shape)).astype(np.float32)

        self.p = {"xf": normal(0.5, 256, 3 * hidden), "xb": normal(0.5, 256, 3 * hidden), "uf": normal(0.35, hidden, 3 * hidden), "ub": normal(0.35, hidden, 3 * hidden), "wf": normal(0.35, hidden, k), "wb": normal(0.35, hidden, k), "c": np.zeros(k, np.float32)}

    def _step(self, x: np.ndarray, h: np.ndarray, u: np.ndarray):
        n = self.hidden
        hu = h @ u
        gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        r, z = gates[:, :n], gates[:, n:]
        un = hu[:, 2 * n :]
        c = np.tanh(x[:, 2 * n :] + r * un)
        return c + z * (h - c), r, z, c, un

    def _sweep(self, d: str, cols: np.ndarray, order):
        """States (H, windows) after each position in turn; the array is used again."""
        n, width = self.hidden, cols.shape[1]
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), n)  # sigmoid(v) = (tanh(v / 2) + 1) / 2
        table, u = np.ascontiguousarray((self.p["x" + d] * half).T), np.ascontiguousarray((self.p["u" + d] * half).T)
        h, x, hu, c = (np.zeros((k * n, width), np.float32) for k in (1, 3, 3, 1))
        for t in order:
            np.take(table, cols[t], axis=1, out=x, mode="clip")
            np.matmul(u, h, out=hu)
            gates = x[: 2 * n]
            gates += hu[: 2 * n]
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            gates *= np.float32(0.5)
            np.multiply(hu[2 * n :], x[:n], out=c)
            c += x[2 * n :]
            np.tanh(c, out=c)
            h -= c
            h *= x[n : 2 * n]
            h += c
            yield t, h

    def run(self, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum of the positions' distributions for each window (rows of bytes)."""
        n, steps = rows.shape
        p, cols, on = self.p, np.ascontiguousarray(rows.T).astype(np.intp), np.ascontiguousarray(mask.T.astype(np.float32))
        first = np.empty((steps, self.hidden, n), dtype=np.float32)
        for t, h in self._sweep("f", cols, range(steps)):
            first[t] = h
        total = np.zeros((len(self.langs), n), dtype=np.float32)
        wf, wb = np.ascontiguousarray(p["wf"].T), np.ascontiguousarray(p["wb"].T)
        for t, h in self._sweep("b", cols, range(steps - 1, -1, -1)):
            h *= on[t]  # positions behind a text's end leave no state
            e = wf @ first[t]
            e += wb @ h
            e += p["c"][:, None]
            np.clip(e, -30, 30, out=e)
            np.exp(e, out=e)
            e *= on[t] / e.sum(axis=0)
            total += e
        return total.T

    def gradients(self, rows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy of all positions."""
        p, n, steps, hid = self.p, len(rows), rows.shape[1], self.hidden
        kept, order = {}, {"f": range(steps), "b": range(steps - 1, -1, -1)}
        for d in "fb":
            h, kept[d] = np.zeros((n, hid), np.float32), [None] * steps
            for t in order[d]:
                before = h
                h, r, z, c, un = self._step(p["x" + d][rows[:, t]], h, p["u" + d])
                h = h * mask[:, t, None] if d == "b" else h
                kept[d][t] = (before, h, r, z, c, un)
        hf, hb = (np.stack([kept[d][t][1] for t in range(steps)]) for d in "fb")
        e = hf @ p["wf"] + hb @ p["wb"] + p["c"]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        e[:, np.arange(n), y] -= 1
        e *= (mask.T / mask.sum())[:, :, None].astype(np.float32)
        g = {"wf": np.einsum("tnh,tnk->hk", hf, e), "wb": np.einsum("tnh,tnk->hk", hb, e), "c": e.sum(axis=(0, 1))}
        for d in "fb":
            out = e @ p["w" + d].T
            u, dh = p["u" + d], np.zeros((n, hid), np.float32)
            gu, inputs = np.zeros_like(u), np.empty((steps, n, 3 * hid), np.float32)
            for t in reversed(order[d]):
                before, _, r, z, c, un = kept[d][t]
                dh = dh + out[t]
                if d == "b":
                    dh = dh * mask[:, t, None]
                da = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = da * un * r * (1 - r)
                into = np.concatenate([dr, dz, da * r], axis=1)
                inputs[t] = np.concatenate([dr, dz, da], axis=1)
                gu += before.T @ into
                dh = dh * z + into @ u.T
            g["u" + d] = gu
            flat, byte = inputs.reshape(-1, 3 * hid), rows.T.ravel()
            by = np.argsort(byte, kind="stable")
            cut = np.flatnonzero(np.diff(byte[by], prepend=-1))
            g["x" + d] = np.zeros_like(p["x" + d])
            g["x" + d][byte[by][cut]] = np.add.reduceat(flat[by], cut)
        return g

    def train(self, rows: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = _STEPS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for s in range(1, steps + 1):
            # as many windows of each language
            lang = rng.integers(0, len(by_lang), _BATCH)
            pick = np.array([by_lang[k][rng.integers(0, len(by_lang[k]))] for k in lang])
            g = self.gradients(rows[pick], mask[pick], y[pick])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = _RATE * min(1, 2 * (1 - s / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (size + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (rate * (first[k] / (1 - 0.9**s)) / (np.sqrt(second[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW):
    """All windows of all documents: (rows of bytes, mask, document)."""
    count = -(-np.diff(off) // size)
    doc = np.repeat(np.arange(len(count)), count)
    start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
    at = start[:, None] + np.arange(size)
    mask = at < off[1:][doc][:, None]
    return np.where(mask, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), mask, doc


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each document."""
    for batch in textops.slabs(batches, "text"):
        rows, mask, doc = windows(*textops.byte_view(textops.text_column(batch, "text")))
        at = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), flat, pa.array(mask.sum(axis=1))], ["lang", "row", "n"])


def train(docs: DataFrame, learn_from, sample: int = SAMPLE) -> BiGRU:
    """A network fitted to at most ``sample`` documents with a language where ``learn_from`` holds."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("doc_id", "lang", "text").withColumn("h", F.xxhash64("doc_id", "lang")).select("h", "doc_id", "lang").orderBy("h", "doc_id").limit(sample)
    # of rows with the same id one text is learned from, so the sample is bounded whatever repeats
    keys = chosen.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(keys), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.select("lang", "text").mapInArrow(_windows, "lang string, row binary, n long").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    net = BiGRU(langs)
    if len(langs) > 1:
        label = np.searchsorted(langs, got.column("lang").to_pylist())
        data = np.frombuffer(b"".join(got.column("row").to_pylist()), np.uint8).reshape(-1, WINDOW)
        size = got.column("n").to_numpy()
        order = np.lexsort((*data.T[::-1], size, label))
        net.train(data[order], np.arange(WINDOW)[None, :] < size[order][:, None], label[order])
    return net


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        k = len(net.langs)
        for batch in textops.slabs(batches, "text"):
            names = batch.schema.names
            has = np.asarray(batch.column(names.index("__has_letter")).to_numpy(zero_copy_only=False), dtype=bool)
            rows, mask, doc = windows(*textops.byte_view(textops.text_column(batch, "text")))
            total = np.zeros((batch.num_rows, max(k, 1)))
            if k:
                for a in range(0, len(rows), _ROWS):
                    part = net.run(rows[a : a + _ROWS], mask[a : a + _ROWS])
                    for j in range(k):
                        total[:, j] += np.bincount(doc[a : a + _ROWS], weights=part[:, j], minlength=len(total))
            has = has & (k > 0)
            p = total / np.maximum(total.sum(axis=1), 1e-9)[:, None]
            best = p.argmax(axis=1)
            label = [net.langs[b] if h else "und" for b, h in zip(best, has)]
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n not in ("__has_letter", "text")]
            more = [("lang_pred", pa.array(label, pa.string())), ("score", pa.array(np.where(has, p.max(axis=1), 0.0)))]
            yield pa.RecordBatch.from_arrays([x[1] for x in kept + more], [x[0] for x in kept + more])

    return run


def predict(docs: DataFrame, net: BiGRU) -> DataFrame:
    """docs without text, with lang_pred and score."""
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn("__has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(_predictor(model), schema)
