"""Benchmark decontamination: exact containment of item windows in documents.

A window is ``size`` consecutive words of an item (all of a shorter one). Word
counts of the whole corpus, in a sketch of fixed size, order a window's words by
rarity. Containment asks for all of them, so the necessary prefix is one word:
the rarest is joined with the documents' words, the position bound asks that the
window fit into the document around it, and the words are then compared one by
one. Words of a document inside any occurrence are hit.

Windows are sent to the tasks in blocks of at most ``BLOCK`` or so; a larger
benchmark takes more passes over the documents, each with one block.

Nulls and edge cases: null and empty texts have no words; items without words
are contained nowhere; an item with a null id hits words but is not listed;
repeated items are listed once; without items nothing is hit; empty tables give
empty results; other columns are kept, but for those whose names the result has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textops
from .jaccard_join import _SKETCH_BITS, _SKETCH_ROWS, _add

#: Windows sent to the tasks at once.
BLOCK = 200_000
_FILTER_BITS = 18


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << _SKETCH_BITS, dtype=np.int64)
    for batch in textops.slabs(batches, "text"):
        h, _, _, _ = textops.words(*textops.byte_view(textops.text_column(batch, "text")), textops.NON_ALNUM)
        total += np.bincount((h >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), minlength=len(total))
    if total.any():
        rows = total.reshape(_SKETCH_ROWS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_ROWS), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["part", "counts"])


def word_sketch(docs: DataFrame) -> np.ndarray:
    """Word counts over all documents by hash bucket."""
    out = np.zeros((_SKETCH_ROWS, (1 << _SKETCH_BITS) // _SKETCH_ROWS), dtype=np.int64)
    for r in docs.select("text").mapInArrow(_word_counts, "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _windows(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slabs(batches, "text"):
            h, _, _, at = textops.words(*textops.byte_view(textops.text_column(batch, "text")), textops.NON_ALNUM)
            items = batch.column(0)
            ids, rows = [], []
            for d in range(batch.num_rows):
                own = h[at[d] : at[d + 1]]
                for k in range(max(len(own) - size, 0) + 1 if len(own) else 0):
                    ids.append(items[d].as_py())
                    rows.append(own[k : k + size].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.binary())], ["item_id", "words"])

    return windows


class WindowIndex:
    """A block of windows by their rarest word."""

    def __init__(self, rows: list[tuple[str | None, bytes]], counts: np.ndarray, size: int):
        n = len(rows)
        self.items = [r[0] for r in rows]
        self.length = np.array([len(r[1]) // 8 for r in rows], dtype=np.int64)
        self.words = np.zeros((n, size), dtype=np.uint64)
        for i, (_, w) in enumerate(rows):
            self.words[i, : self.length[i]] = np.frombuffer(w, "<u8")
        rarity = counts[(self.words >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)]
        rarity[np.arange(size)[None, :] >= self.length[:, None]] = np.iinfo(np.int64).max
        at = np.argmin(rarity, axis=1)
        key = self.words[np.arange(n), at]
        order = np.argsort(key, kind="stable")
        self.length, self.words, self.at, key = self.length[order], self.words[order], at[order], key[order]
        self.items = [self.items[i] for i in order]
        self.keys, self.first = np.unique(key, return_index=True)
        self.first = np.append(self.first, n)
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def occurrences(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence; words are counted over the whole slab."""
        pos = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[pos])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[pos]
        pos, k = pos[same], k[same]
        found = []
        for a in range(0, len(pos), 1 << 16):
            p, q = pos[a : a + (1 << 16)], k[a : a + (1 << 16)]
            many = self.first[q + 1] - self.first[q]
            # windows of one rare word, a bounded number of candidates at a time
            for b in range(0, int(many.max(initial=0)), 64):
                more = np.clip(many - b, 0, 64)
                w = np.repeat(self.first[q] + b, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                start = np.repeat(p, more) - self.at[w]
                doc = np.searchsorted(at, np.repeat(p, more), side="right") - 1
                ok = (start >= at[doc]) & (start + self.length[w] <= at[doc + 1])
                w, start, doc = w[ok], start[ok], doc[ok]
                for j in range(self.words.shape[1]):
                    inside = j < self.length[w]
                    same = ~inside
                    same[inside] = h[start[inside] + j] == self.words[w[inside], j]
                    w, start, doc = w[same], start[same], doc[same]
                found.append((doc, start, w))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans (start, end) as one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    end = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)
    return np.stack([spans[first, 0], end[last]], axis=1)


def _mark(index, drop_text: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in textops.slabs(batches, "text"):
            h, _, _, at = textops.words(*textops.byte_view(textops.text_column(batch, "text")), textops.NON_ALNUM)
            doc, start, w = block.occurrences(h, at)
            names = batch.schema.names
            spans = batch.column(names.index("hit_spans")).to_pylist()
            items = batch.column(names.index("items")).to_pylist()
            order = np.argsort(doc, kind="stable")
            doc, start, w = doc[order], start[order], w[order]
            which, begin = np.unique(doc, return_index=True)
            for d, a, b in zip(which.tolist(), begin.tolist(), np.append(begin[1:], len(doc)).tolist()):
                own = np.stack([start[a:b] - at[d], start[a:b] - at[d] + block.length[w[a:b]]], axis=1)
                if spans[d]:
                    own = np.concatenate([own, np.array([(x["start"], x["end"]) for x in spans[d]])])
                spans[d] = [{"start": int(x), "end": int(y)} for x, y in _merged(own)]
                items[d] = sorted({*items[d], *(block.items[i] for i in np.unique(w[a:b]) if block.items[i] is not None)})
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n not in ("n_words", "hit_spans", "items") and not (drop_text and n == "text")]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            more = [("n_words", pa.array(np.diff(at))), ("hit_spans", pa.array(spans, kind)), ("items", pa.array(items, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([x[1] for x in kept + more], [x[0] for x in kept + more])

    return mark


_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def mark(docs: DataFrame, benchmark: DataFrame, size: int = 10, item_col: str = "item_id", keep_text: bool = True, block: int = BLOCK) -> DataFrame:
    """docs with n_words, hit_spans (word numbers, end exclusive) and items, the sorted ids found.

    Of several blocks of windows each has a pass over the texts, whose result is
    written before the next block is sent, so that tasks hold one block at a time.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "items").withColumn("text", F.col("text").cast("string"))
    counts = word_sketch(docs)
    every = storage.stored(benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_windows(size), "item_id string, words binary").distinct(), "windows")
    blocks = max(1, -(-every.count() // block))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(_ADDED["hit_spans"].dataType), "items": F.array().cast("array<string>")})
    held = None
    for b in range(blocks):
        part = every if blocks == 1 else every.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(WindowIndex([(r[0], bytes(r[1])) for r in part.collect()], counts, size))
        last = b == blocks - 1 and not keep_text
        schema = T.StructType([f for f in docs.schema.fields if not (last and f.name == "text")] + _ADDED.fields)
        out = out.mapInArrow(_mark(index, last), schema)
        if b < blocks - 1:
            before, held = held, storage.stored(out, "marked")
            out = held
            index.destroy()
            if before is not None:
                storage.dropped(spark, before)
    return out


def hit_words(spans: str = "hit_spans"):
    """The number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without those that hold a window of the benchmark, with the same columns."""
    return mark(docs, benchmark, size).where(F.size("hit_spans") == 0).select(*docs.columns)
