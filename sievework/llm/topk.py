"""Exact top-k inner products by histogram selection.

Queries are taken in blocks. For a block, every task scores all its candidates
and sends counts by score range, from the range that holds its own k-th best on
(no global k-th value can lie below); the global histogram then locates the
range of the k-th value, which the next pass divides, until few candidates lie
at or above its lower end. These are kept, the best k of each task, and ranked
by score and id.

Nulls and edge cases: vectors that are null or have null or non-finite
components take no part, as queries or candidates; a vector of another length
is no candidate; a query's own id is no candidate, in repeated rows either;
equal scores rank by id; fewer than k candidates are all returned; rows without
id take no part; empty vectors score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries scored at once, ranges of a histogram, candidates at once.
BLOCK, BINS, ROWS = 1024, 256, 2048
#: Refined until at most so many times k candidates are left above the lower end.
SLACK = 8


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(as_double, lambda x: F.floor(x * scale).cast("long")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim) if dim else np.zeros((len(col), 0), np.int64)


def _score(cand: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, through doubles where these are exact."""
    if cand.size and float(np.abs(cand).max()) * float(np.abs(queries).max()) * cand.shape[1] >= 2.0**52:
        return cand @ queries.T
    return (cand.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], block):
    ids, queries = block["ids"], block["vectors"]
    dim = queries.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            cand = np.asarray(part.column(0))
            score = _score(_matrix(part.column(1), dim), queries)
            yield cand, score, cand[:, None] != ids[None, :]


def _bin(score: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """0 below the range, 1..BINS in it, BINS + 1 above."""
    return np.clip((score - low) // width + 1, 0, BINS + 1)


def _extremes(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        low, high = np.full(len(b["ids"]), np.iinfo(np.int64).max), np.full(len(b["ids"]), np.iinfo(np.int64).min)
        some = False
        for _, score, other in _scored(batches, b):
            some = True
            low = np.minimum(low, np.where(other, score, np.iinfo(np.int64).max).min(axis=0))
            high = np.maximum(high, np.where(other, score, np.iinfo(np.int64).min).max(axis=0))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["q", "low", "high"])

    return run


def _histogram(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        n = len(b["ids"])
        total = np.zeros((n, BINS + 2), dtype=np.int64)
        for _, score, other in _scored(batches, b):
            bins = _bin(score, b["low"], b["width"]) + np.arange(n) * (BINS + 2)
            total += np.bincount(bins[other], minlength=n * (BINS + 2)).reshape(n, -1)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        q, bin_ = np.nonzero((above - total < k) & (total > 0))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bin_), pa.array(total[q, bin_])], ["q", "bin", "n"])

    return run


def _above(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best = [np.zeros((0, 3), np.int64)]
        held = 0

        def cut() -> np.ndarray:
            rows = np.concatenate(best)
            rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
            return rows[np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0]) < k]

        for cand, score, other in _scored(batches, b):
            at, q = np.nonzero((score >= b["low"]) & other)
            best.append(np.stack([q, cand[at], score[at, q]], axis=1))
            held += len(at)
            if held > 500_000:
                best = [cut()]
                held = len(best[0])
        rows = cut()
        yield pa.RecordBatch.from_arrays([pa.array(b["ids"][rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["query_id", "vec_id", "score"])

    return run


def _selected(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """Candidates at or above a bound on each query's k-th value, the best k of each task."""
    spark = candidates.sparkSession
    block = {"ids": ids, "vectors": vectors}
    span = candidates.mapInArrow(_extremes(spark.sparkContext.broadcast(block)), "q long, low long, high long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for r in span:
        if r["low"] <= r["high"]:
            low[r["q"]], high[r["q"]] = r["low"], r["high"]
    while True:
        # 1 + (high - low) // BINS, without overflow
        width = np.array([1 + (int(h) - int(x)) // BINS for x, h in zip(low, high)], dtype=np.int64)
        sent = spark.sparkContext.broadcast(block | {"low": low, "width": width})
        rows = candidates.mapInArrow(_histogram(sent, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((len(ids), BINS + 2), dtype=np.int64)
        for r in rows:
            total[r["q"], r["bin"]] = r["n"]
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        enough = above >= k
        at = np.where(enough.any(axis=1), BINS + 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        inside = (at >= 1) & (at <= BINS)
        begin = np.where(inside, low + (at - 1) * width, low)
        open_ = inside & (width > 1) & (above[np.arange(len(ids)), at] > SLACK * k)
        high = np.where(open_, begin + width - 1, begin)
        low = begin
        if not open_.any():
            break
    return candidates.mapInArrow(_above(spark.sparkContext.broadcast(block | {"low": low}), k), "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row (both tables have the same columns)."""

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")

    spark = vectors.sparkSession
    every, asked = usable(vectors), usable(queries)
    out = None
    held: dict[int, list] = {}

    def flush(dim: int) -> None:
        nonlocal out
        rows = held.pop(dim)
        found = _selected(every.where(F.size("v") == dim), np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim), k)
        out = found if out is None else out.union(found)

    for r in asked.groupBy("id").agg(F.min("v").alias("v")).sort("id").toLocalIterator():
        rows = held.setdefault(len(r["v"]), [])
        rows.append((r["id"], r["v"]))
        if len(rows) >= block:
            flush(len(r["v"]))
    for dim in list(held):
        flush(dim)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
