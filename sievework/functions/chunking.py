"""Sentence-aware chunks with stable offsets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk size, overlap and the characters after which a sentence ends.
SIZE, OVERLAP, ENDS = 448, 64, "。！？；\n"

#: Characters of texts whose chunks are held at once.
SLAB = 1 << 20

_SCHEMA = "case_id string, chunk_id string, chunk_index int, start_char int, end_char int, text string"


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP, ends: str = ENDS, length: Callable[[str], int] = len) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks: the longest that fits, back to a sentence end unless less than half is left."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > overlap >= 0 is needed")
    if length(text) <= size:
        yield 0, len(text)
        return
    stops = [i + 1 for i, c in enumerate(text) if c in ends]
    start = 0
    while True:
        end = _farthest(lambda e: length(text[start:e]) <= size, start + 1, len(text))
        k = bisect_right(stops, end)
        if k and stops[k - 1] > start and length(text[start : stops[k - 1]]) >= size // 2:
            end = stops[k - 1]
        yield start, end
        if end == len(text):
            return
        again = end if not overlap else _farthest(lambda e: length(text[end - (e - start) : end]) <= overlap, start, end - 1)
        back = end if not overlap else end - (again - start)
        start = back if back > start else end


def _farthest(fits: Callable[[int], bool], low: int, high: int) -> int:
    """The largest value in low..high that fits, low if none does; what fits is an initial part."""
    while low < high:
        middle = (low + high + 1) // 2
        if fits(middle):
            low = middle
        else:
            high = middle - 1
    return low


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])


def chunks(cases: DataFrame, id_col: str = "case_id", text_col: str = "fact", size: int = SIZE, overlap: int = OVERLAP, ends: str = ENDS) -> DataFrame:
    """One row a chunk, with its offsets and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k, t in zip(batch.column(0), batch.column(1)):
                k, t = k.as_py(), t.as_py()
                rows += [(k, f"{k}:c{i}", i, a, b, t[a:b]) for i, (a, b) in enumerate(cuts(t, size, overlap, ends))]
                held += len(t)
                if held >= SLAB:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)

    keyed = cases.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return keyed.mapInArrow(run, _SCHEMA).withColumn("text_sha256", F.sha2("text", 256))
