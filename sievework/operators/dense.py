"""Exact dense search: normalised vectors, inner products, gates by label.

Vectors are packed into blocks, rows of a table by (length, gate value, slot);
queries are packed the same way, and each block of queries is sent to every slot
of its length and gate value. The join of both is the search's work list: a row is
two blocks, whose products are one matrix product in a task, of which the best k
of each query are kept. Nothing passes the driver, and any number of queries is
one plan. Of a gate value's queries only its own vectors are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

#: Bytes of a block of vectors and of queries.
BLOCK_BYTES, QUERY_BYTES = 2 << 20, 256 << 10
_EPS = 1.1920929e-07  # of 32-bit floats


def normalized(vector: Column) -> Column:
    """A vector of doubles of length 1; lengths below the smallest float step count as that."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)), F.lit(_EPS))
    # the length is bound to a variable: written inside the transform, it would be computed for each component
    return F.get(F.transform(F.array(F.named_struct(F.lit("v"), wide, F.lit("n"), norm)), lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))


def letter_profiles(texts: DataFrame) -> DataFrame:
    """id, v of texts (id, text) that are not null: functions.features.letter_profile, counted in bytes where the texts are read."""
    return texts.where("text is not null").select("id", "text").mapInArrow(_profiles, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.full(256, 26, np.int64)
    for first in b"aA":
        place[first : first + 26] = np.arange(26)
    for batch in batches:
        for slab in scan.slabs(batch, scan.CELLS):
            text, n = slab.column(1).cast(pa.large_binary()), slab.num_rows
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            row = np.repeat(np.arange(n), np.diff(off))
            counts = np.bincount(row * 27 + place[data], minlength=n * 27).reshape(n, 27)
            # the two characters beyond ASCII whose small letter is one from a to z: the sign of Kelvin, and I with a dot
            for letter, seen in ((10, b"\xe2\x84\xaa"), (8, b"\xc4\xb0")):
                at = np.flatnonzero(data[: len(data) - len(seen) + 1] == seen[0]) if len(data) >= len(seen) else np.zeros(0, np.int64)
                for i in range(1, len(seen)):
                    at = at[data[at + i] == seen[i]]
                np.add.at(counts, (row[at], letter), 1)
            values = pa.array(counts[:, :26].astype(float).ravel())
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 26, pa.int32()), values)], ["id", "v"])


def _gate_values(df: DataFrame, gate: str | None) -> Column:
    """A gate as a list of different texts: a list has one for each of its values, null and null values none; without a gate an empty text."""
    if gate is None:
        return F.array(F.lit(""))
    listed = F.col(gate) if df.schema[gate].dataType.typeName() == "array" else F.array(gate)
    return F.array_distinct(F.array_compact(F.transform(listed, lambda x: x.cast("string"))))


def blocks(df: DataFrame, key: str, vector: str, gate: str | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """dim, gate, slot, rows (a list of doc, v): the usable vectors in blocks of about ``size`` bytes.

    A vector with several gate values is in blocks of each. Null vectors, those
    with components that are null or not finite, and rows without key are left out.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = df.where(F.col(vector).isNotNull() & ~bad & F.col(key).isNotNull())
    rows = usable.select(F.col(key).cast("long").alias("doc"), normalized(F.col(vector)).alias("v"), F.explode(_gate_values(df, gate)).alias("gate")).withColumn("dim", F.size("v"))
    each = F.greatest(F.lit(1), F.floor(size / (8.0 * F.greatest("dim", F.lit(1)))))
    # counts decide how many slots a group has; a hot gate value has many, none of them larger than others
    slots = rows.groupBy("dim", "gate").agg(F.count("*").alias("n")).select("dim", "gate", F.ceil(F.col("n") / each).cast("int").alias("slots"))
    dealt = rows.join(slots, ["dim", "gate"]).withColumn("slot", F.pmod(F.xxhash64("doc"), F.col("slots")).cast("int"))
    return dealt.groupBy("dim", "gate", "slot").agg(F.collect_list(F.struct("doc", "v")).alias("rows"))


def _best(ids: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, score) of the k best docs of each column, ties by doc."""
    if len(doc) > k:
        low = np.partition(score, len(doc) - k, axis=0)[len(doc) - k]
        at, q = np.nonzero((score >= low) & (score > -np.inf))
    else:
        at, q = np.nonzero(score > -np.inf)
    order = np.lexsort((doc[at], -score[at, q], q))
    at, q = at[order], q[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    at, q = at[keep], q[keep]
    return ids[q], doc[at], score[at, q]


def _products(k: int, others: bool):
    def matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        doc, v = np.asarray(rows.values.field("doc")), np.asarray(rows.values.field("v").flatten())
        return doc, v.reshape(len(doc), len(v) // len(doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, rows in zip(batch.column(0), batch.column(1)):
                (ids, queries), (doc, vectors) = matrix(asked), matrix(rows)
                score = np.round(vectors @ queries.T, 9)
                if others:
                    score[doc[:, None] == ids[None, :]] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(ids, score, doc, k)], ["query", "doc", "score"])

    return run


def search_blocks(stored: DataFrame, queries: DataFrame, key: str, vector: str, k: int, gate: str | None = None, others: bool = True) -> DataFrame:
    """The search over blocks that ``blocks`` made."""
    asked = blocks(queries, key, vector, gate, QUERY_BYTES).select("dim", "gate", F.col("rows").alias("asked"))
    slots = stored.groupBy("dim", "gate").agg(F.max("slot").alias("last"))
    sent = asked.join(slots, ["dim", "gate"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    work = stored.join(sent.hint("shuffle_hash"), ["dim", "gate", "slot"])
    found = work.select("asked", "rows").mapInArrow(_products(k, others), "query long, doc long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    # a vector can share several gate values with a query
    return (found.distinct() if gate else found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, gate: str | None = None, others: bool = True) -> DataFrame:
    """query, doc, score, rank of the k nearest vectors, of other ids than the query's if ``others``; with ``gate`` of those that share a value of it.

    Gates are values of any type, or lists of them. Vectors of another length than
    the query's, null ones, and those with components that are null or not finite
    take no part, as queries or candidates.
    """
    return search_blocks(blocks(vectors, key, vector, gate), queries, key, vector, k, gate, others)
