"""Token-id shards with a minimal perfect hash index.

``write_store`` tokenises documents into raw little-endian id files, one a range
of document ids, each with an index file: a minimal perfect hash function over
the shard's distinct keys whose slots hold a fingerprint, the document's number
and the number of documents with that key. ``TokenStore.get`` finds a document
with one directory bisection, one seed, one slot and one read.

Nulls and edge cases: a null text is an empty document (the end id only); null
document ids come first and are kept under a key of their own; rows with equal
ids are kept as a run in text order; an empty table gives a store without
shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, textops, tokens

_MAGIC = b"SWTK0001"
_NULL_KEY = np.uint64(0x5BD1E9955BD1E995)
_SALT = np.uint64(0xA0761D6478BD642F)
#: Bytes of text in a shard, about.
SHARD_BYTES = 64_000_000
#: Keys a bucket on average, seeds tried at once.
_BUCKET, _TRIES = 4, 64


def key_hash(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of document ids; null ids have one of their own."""
    return np.where(null, _NULL_KEY, textops.mix(ids.astype(np.int64).view(np.uint64) + _SALT))


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (textops.mix(keys ^ textops.mix(seeds.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Seeds of a hash-and-displace minimal perfect hash of distinct keys.

    Bucket b of a key is key mod buckets. A seed >= 0 displaces the bucket's
    keys; a seed < 0 is -1 - slot of a bucket's only key.
    """
    n = len(keys)
    buckets = max(1, n // _BUCKET)
    seeds = np.zeros(buckets, dtype=np.int64)
    if not n:
        return seeds
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=buckets)
    begin = np.cumsum(size) - size
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(-size, kind="stable"):
        k = size[b]
        if k < 2:
            break
        own = keys[order[begin[b] : begin[b] + k]]
        base = 0
        while True:
            tried = np.arange(base, base + _TRIES)
            at = _slots(own[None, :], tried[:, None], n)
            free = ~taken[at].any(axis=1)
            at.sort(axis=1)
            good = np.flatnonzero(free & (at[:, 1:] != at[:, :-1]).all(axis=1))
            if len(good):
                seeds[b] = base + good[0]
                taken[at[good[0]]] = True
                break
            base += _TRIES
    single = np.flatnonzero(size == 1)
    seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return seeds


def mph_slots(seeds: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, in constant time a key."""
    s = seeds[(keys % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(s < 0, -1 - s, _slots(keys, np.maximum(s, 0), n))


class ShardIndex:
    """The index of one shard: bytes and back, and look-up."""

    def __init__(self, ids, null, offsets, seeds=None, prints=None, first=None, run=None):
        self.ids, self.null, self.offsets = ids, null, offsets
        if seeds is None:
            h = key_hash(ids, null)
            keys, at, run = np.unique(h, return_index=True, return_counts=True)
            seeds = build_mph(keys)
            slot = mph_slots(seeds, len(keys), keys)
            prints, first, runs = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            prints[slot], first[slot], runs[slot] = keys >> np.uint64(32), at, run
            run = runs
        self.seeds, self.prints, self.first, self.run = seeds, prints, first, run

    def find(self, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first document, documents) of each key; -1 and 0 if absent."""
        h = key_hash(ids, null)
        if not len(self.prints):
            return np.full(len(h), -1), np.zeros(len(h), np.int64)
        slot = mph_slots(self.seeds, len(self.prints), h)
        ok = self.prints[slot] == (h >> np.uint64(32)).astype(np.uint32)
        return np.where(ok, self.first[slot], -1), np.where(ok, self.run[slot], 0)

    def to_bytes(self) -> bytes:
        parts = [self.ids.astype("<i8"), self.null.astype("u1"), self.offsets.astype("<i8"), self.seeds.astype("<i8"), self.prints.astype("<u4"), self.first.astype("<i8"), self.run.astype("<i8")]
        return _MAGIC + struct.pack("<3q", len(self.ids), len(self.seeds), len(self.prints)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "ShardIndex":
        if raw[:8] != _MAGIC:
            raise ValueError("not a shard index")
        docs, seeds, slots = struct.unpack_from("<3q", raw, 8)
        out, at = [], 32
        for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs + 1), ("<i8", seeds), ("<u4", slots), ("<i8", slots), ("<i8", slots)):
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes
        return cls(out[0], out[1].astype(bool), *out[2:])


_SHARD = "shard long, file string, width int, n_docs long, n_tokens long, first_id long, last_id long, nulls long"


def _shard_writer(uri: str, path: str, id_col: str, text_col: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = tokens.encoder(path)
        width = 2 if len(encoder.ends) <= 1 << 16 else 4
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids, null, sizes, out = [], [], [], None
        for batch in textops.slabs(batches, text_col):
            if out is None:
                fs, folder = storage.arrow_fs(uri)
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}.ids")
            flat, off = encoder.encode(*textops.byte_view(textops.text_column(batch, text_col)), end_id)
            out.write(flat.astype(f"<u{width}").tobytes())
            col = batch.column(batch.schema.get_field_index(id_col))
            null.append(np.asarray(col.is_null()))
            ids.append(np.asarray(col.fill_null(0)).astype(np.int64))
            sizes.append(np.diff(off))
        if out is None:
            return
        out.close()
        ids, null, sizes = np.concatenate(ids), np.concatenate(null), np.concatenate(sizes)
        index = ShardIndex(ids, null, np.concatenate([[0], np.cumsum(sizes)]))
        with fs.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(index.to_bytes())
        real = ids[~null]
        row = [task.partitionId(), name, width, len(ids), int(sizes.sum()), int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None, int(null.sum())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5])],
            ["shard", "file", "width", "n_docs", "n_tokens", "first_id", "last_id", "nulls"],
        )

    return write


class TokenStore:
    """A written store: where its shards are and which ids each one holds.

    The manifest has a row for each shard, never for each document.
    """

    def __init__(self, uri: str, shards: list[dict]):
        self.uri, self.shards = uri, sorted(shards, key=lambda r: r["shard"])
        at = 0
        for r in self.shards:
            r["start"] = at
            at += r["n_tokens"]
        self._open: dict[str, ShardIndex] = {}
        # ranges of ids are in the order of the shards; equal ids are in one shard
        self._ranged = [r for r in self.shards if r["last_id"] is not None]
        self._ends = [r["last_id"] for r in self._ranged]

    def _index(self, file: str) -> ShardIndex:
        if file not in self._open:
            fs, folder = storage.arrow_fs(self.uri)
            with fs.open_input_file(f"{folder}/{file}.idx") as f:
                self._open[file] = ShardIndex.from_bytes(f.read())
        return self._open[file]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that key; empty if there is none."""
        found = []
        fs, folder = storage.arrow_fs(self.uri)
        if doc_id is None:
            shards = [r for r in self.shards if r["nulls"] > 0]
        else:
            at = bisect_left(self._ends, doc_id)
            shards = self._ranged[at : at + 1]
        for r in shards:
            index = self._index(r["file"])
            first, run = index.find(np.array([doc_id or 0], np.int64), np.array([doc_id is None]))
            with fs.open_input_file(f"{folder}/{r['file']}.ids") as f:
                for d in range(first[0], first[0] + run[0]):
                    a, b = int(index.offsets[d]), int(index.offsets[d + 1])
                    found.append(np.frombuffer(f.read_at((b - a) * r["width"], a * r["width"]), f"<u{r['width']}").astype(np.uint32))
        return found


def write_store(docs: DataFrame, uri: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, end_id: int = tokens.END_ID) -> TokenStore:
    """Tokenises docs into shards under uri, in ascending order of ids.

    A lost task writes its shard again under another name; the manifest names
    the files of the tasks that counted.
    """
    spark = docs.sparkSession
    if not shards:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    path = tokenizer or tokens.tokenizer_path()
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_shard_writer(uri, path, "doc_id", "text", end_id), _SHARD)
        .collect()
    )
    return TokenStore(uri, [r.asDict() for r in rows])


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, store: TokenStore) -> DataFrame:
    """One row a document, from the files: where its ids start, how many they are, their crc32.

    Each document is found by its key through the shard's hash index.
    """
    uri, block = store.uri, 1 << 21

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = storage.arrow_fs(uri)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{r['file']}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                n, off, width = len(index.ids), index.offsets, r["width"]
                new = np.ones(n, bool)
                new[1:] = (index.ids[1:] != index.ids[:-1]) | (index.null[1:] != index.null[:-1])
                first, run = index.find(index.ids[new], index.null[new])
                # the documents that the look-up of each key names, and where their ids are
                doc = np.repeat(first - (np.cumsum(run) - run), run) + np.arange(run.sum())
                if (first < 0).any() or len(doc) != n:
                    raise ValueError(f"the index of {r['file']} misses keys that it holds")
                crc = np.zeros(n, np.int64)
                with fs.open_input_file(f"{folder}/{r['file']}.ids") as f:
                    at = 0
                    while at < n:
                        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + block, side="right")) - 1))
                        ids = np.frombuffer(f.read_at(int(off[end] - off[at]) * width, int(off[at]) * width), f"<u{width}").astype("<u4")
                        for d in range(at, end):
                            crc[d] = zlib.crc32(ids[off[d] - off[at] : off[d + 1] - off[at]].tobytes())
                        at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(index.ids[new], run), mask=np.repeat(index.null[new], run)), pa.array(r["start"] + off[doc]), pa.array(off[doc + 1] - off[doc]), pa.array(crc[doc])],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    listed = spark.createDataFrame([(r["shard"], r["file"], r["width"], r["start"]) for r in store.shards], "shard long, file string, width int, start long")
    return listed.mapInArrow(read, _READ)
