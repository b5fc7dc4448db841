"""Exact best cosines of sparse vectors, by upper bounds in blocks.

Vectors are rows of buckets and weights of length 1. They are packed into blocks,
rows of a table by (gate value, slot), and each block of queries is sent to every
slot of its gate value. A task inverts a block of documents: postings by bucket,
and the largest weight of each bucket. A query's buckets are summed in a few steps,
its largest weights first. After each step a document stays only if what the rest
can add (the sum of its products with the largest weights, or by Cauchy and
Schwarz its length times the length of the part of the document that is not yet
met) may bring it to the query's k-th best so far. The last step verifies those
that are left with all buckets, and only the best k of a block leave it, so that
pairs are neither shuffled nor written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a block of documents and of queries.
BLOCK, QUERY_BLOCK = 1 << 18, 1 << 16
#: Shares of a query's squared length after which documents are cut by their bounds.
STEPS = (0.5, 0.7, 0.85)
#: Sums in another order, and rounded ones, are never so far apart.
_SLACK = 2e-9


def gates(values: Column | None) -> Column:
    """The gate values of a document: all of its own, and one that queries without any have."""
    if values is None:
        return F.array(F.lit(""))
    named = F.transform(F.array_distinct(F.array_compact(values)), lambda x: F.concat(F.lit("="), x.cast("string")))
    return F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array(F.lit("")))


def asked_gates(values: Column | None) -> Column:
    """The gate values of a query: its own ones, or the one that all documents have."""
    listed = gates(values)
    return F.when(F.size(listed) > 1, F.slice(listed, 1, F.size(listed) - 1)).otherwise(listed)


def blocks(vectors: DataFrame, key: str, gate: Column, size: int = BLOCK) -> DataFrame:
    """gate, slot, rows (a list of doc, buckets, weights) of vectors (key, buckets, weights)."""
    rows = vectors.where(F.col(key).isNotNull() & (F.size("buckets") > 0)).select(F.col(key).alias("doc"), "buckets", "weights", F.explode(gate).alias("gate"))
    slots = rows.groupBy("gate").agg(F.sum(F.size("buckets")).alias("n")).select("gate", F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int").alias("slots"))
    dealt = rows.join(slots, "gate").withColumn("slot", F.pmod(F.xxhash64("doc"), F.col("slots")).cast("int"))
    return dealt.groupBy("gate", "slot").agg(F.collect_list(F.struct("doc", "buckets", "weights")).alias("rows"))


class _Inverted:
    """A block of documents by bucket."""

    def __init__(self, doc: np.ndarray, begin: np.ndarray, bucket: np.ndarray, weight: np.ndarray):
        self.doc, self.begin = doc, begin
        row = np.repeat(np.arange(len(doc)), np.diff(begin))
        order = np.argsort(bucket, kind="stable")
        self.row, self.weight = row[order], weight[order]
        self.bucket, first = np.unique(bucket[order], return_index=True)
        self.first = np.append(first, len(order))
        self.largest = np.maximum.reduceat(self.weight, first)
        self.verified = 0

    def _add(self, lists: np.ndarray, by: np.ndarray, score: np.ndarray, met: np.ndarray, can: np.ndarray) -> None:
        """Adds the products of some lists of postings to the scores of the documents that still count."""
        size = self.first[lists + 1] - self.first[lists]
        at = np.repeat(self.first[lists] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        keep = can[self.row[at]]
        row, weight, by = self.row[at[keep]], self.weight[at[keep]], np.repeat(by, size)[keep]
        score += np.bincount(row, weight * by, len(self.doc))
        met += np.bincount(row, weight * weight, len(self.doc))

    def best(self, bucket: np.ndarray, weight: np.ndarray, k: int, low: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k best documents that reach ``low``; ties at the k-th place are all kept."""
        at = np.searchsorted(self.bucket, bucket)
        held = self.bucket[np.minimum(at, len(self.bucket) - 1)] == bucket
        lists, by = at[held], weight[held]
        gain = by * self.largest[lists]
        if not len(lists) or gain.sum() + _SLACK < low:
            return np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-by, kind="stable")
        lists, by, gain = lists[order], by[order], gain[order]
        mass = np.cumsum(by * by)
        ends = [*(int(np.searchsorted(mass, s * mass[-1])) + 1 for s in STEPS), len(lists)]
        score, met, can = np.zeros(len(self.doc)), np.zeros(len(self.doc)), np.ones(len(self.doc), bool)
        for begin, end in zip([0, *ends], ends):
            last = int(can.sum())
            self._add(lists[begin:end], by[begin:end], score, met, can)
            if len(score) >= k:  # sums only grow, so the k-th of them is a bound
                low = max(low, np.partition(score, len(score) - k)[len(score) - k])
            rest = np.minimum(gain[end:].sum(), np.sqrt((by[end:] ** 2).sum()) * np.sqrt(np.maximum(1 - met, 0)))
            can &= score + rest + _SLACK >= low
        self.verified += last
        rows = np.flatnonzero(can & (score > 0))
        score = np.round(score[rows], 9)
        keep = score >= round(low, 9)
        return rows[keep], score[keep]


def _entries(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, buckets, weights = (rows.values.field(n) for n in ("doc", "buckets", "weights"))
    offsets = np.asarray(buckets.offsets)
    return np.asarray(doc), offsets - offsets[0], np.asarray(buckets.flatten()), np.asarray(weights.flatten())


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows: dict = {}  # best cosines of the queries this task has met, by gate value (a document may be under several) and id
        for batch in batches:
            for gate, asked, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids, begin, bucket, weight = _entries(asked)
                block = _Inverted(*_entries(rows))
                out: list[list] = [[], [], []]
                for q, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
                    known = lows.get((gate, ids[q]))
                    low = -1.0 if known is None or len(known) < k else float(known[0])
                    at, cosine = block.best(bucket[a:b], weight[a:b], k, low)
                    if len(at):
                        lows[gate, ids[q]] = np.sort(np.concatenate([known if known is not None else np.zeros(0), cosine]))[-k:]
                        out[0].append(np.repeat(ids[q], len(at)))
                        out[1].append(block.doc[at])
                        out[2].append(cosine)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query", "doc", "cosine"])

    return run


def candidates(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, doc, cosine: of each block the documents that can be among a query's k best."""
    slots = stored.groupBy("gate").agg(F.max("slot").alias("last"))
    sent = asked.select("gate", F.col("rows").alias("asked")).join(slots, "gate").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    work = stored.select("gate", "slot", "rows").join(sent.hint("shuffle_hash"), ["gate", "slot"])
    return work.select("gate", "asked", "rows").mapInArrow(_search(k), "query long, doc long, cosine double").distinct()


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, gate: Column | None = None, query_gate: Column | None = None) -> DataFrame:
    """query, doc, cosine of the k best documents of each query, ties by doc; with gates of those that share a value with it (all, for a query without any).

    Both tables have buckets and weights of vectors of length 1, without repeated buckets.
    """
    found = candidates(blocks(vectors, key, gates(gate)), blocks(queries, query_key, asked_gates(query_gate), QUERY_BLOCK), k)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "doc")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")
