"""Lexical retrieval packing into fixed windows.

BM25 over token ids with the document frequencies, number and average length of
all documents. The next unused document seeds a window, its best unused
neighbours of the whole corpus are found with all its distinct terms, and they
fill the window greedily; the one that no longer fits is cut, and its rest seeds
the next window.

A corpus of one shard is packed in one task. In a larger one the inverted index
lies in shards by a hash, and many lanes fill a window each. A round asks every
shard for the lanes' neighbours; the shards' answers are merged for each seed
before the driver gives documents to the lanes in turn, so what it gets a round is
bounded by the lanes, of which there are LANES at most.
A shard names its best ones only until they would fill the window a few times, so
a lane takes no document that is worse than what a shard may have kept back, and
asks again in the next round instead. Lanes decide who takes a document first,
never which documents can be found. What a lane has open at the end is cut into
sequences whose lengths are powers of two, so no sequence needs padding.

Nulls and edge cases: a null text is an empty document, which has the end id
only; null and repeated ids are documents like any other; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textops, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW = 4096
#: Bytes of text and rows in a shard, about.
SHARD_BYTES, SHARD_ROWS = 8_000_000, 50_000
#: Windows a lane fills, about; most lanes; how often a shard's answer, and that of all shards, would fill the room of a window.
LANE_WINDOWS, LANES, ANSWER, MERGED = 32, 1024, 8, 64
#: Bytes of text encoded at once, tokens whose pairs are sorted at once, and chunks whose ids a worker keeps, about.
TEXT, TOKENS, CHUNKS = 1 << 19, 1 << 18, 400_000
#: Cells of the matrix of a shard's scores or weights, at most; pieces that the driver holds before they are written, about.
CELLS, HELD = 1 << 25, 50_000
#: Terms whose weights are multiplied as a matrix, at most, and the share of documents they are in, at least.
DENSE, DENSE_SHARE = 4096, 0.05
_K1, _B = 1.2, 0.75


def postings(ids: np.ndarray, off: np.ndarray):
    """Term, document and count of each pair that occurs, by term and document."""
    parts, a = [(np.zeros(0, np.int64),) * 3], 0
    while a < len(off) - 1:  # a pair lies in one document, so documents are counted a few at a time
        b = max(a + 1, int(np.searchsorted(off, off[a] + TOKENS, "right")) - 1)
        n = np.uint64(b - a)
        doc = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(off[a : b + 1]))
        pairs, tf = np.unique(ids[off[a] : off[b]].astype(np.uint64) * n + doc, return_counts=True)
        parts.append(((pairs // n).astype(np.int64), (pairs % n).astype(np.int64) + a, tf))
        a = b
    term, doc, tf = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(term, kind="stable")
    return term[order], doc[order], tf[order]


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def weights(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """What postings add to a score; ``idf`` and ``size`` are those of the posting's term and document."""
    return idf * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * size / max(mean, 1e-9)))


class ShardIndex:
    """BM25 postings over the documents of a corpus of one shard; terms are token ids."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        self.n = len(off) - 1
        size = np.diff(off)
        term, self.doc, tf = postings(ids, off)
        self.at = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1))
        self.weight = weights(idf_of(np.diff(self.at), self.n)[term], tf, size[self.doc], size.mean())
        order = np.argsort(self.doc, kind="stable")
        self.terms, self.first = term[order], np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        own = self.terms[self.first[seed] : self.first[seed + 1]]
        parts = [slice(self.at[t], self.at[t + 1]) for t in own]
        return np.bincount(np.concatenate([self.doc[p] for p in parts]), weights=np.concatenate([self.weight[p] for p in parts]), minlength=self.n)


def pack_shard(ids: np.ndarray, off: np.ndarray, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) of one shard."""
    n = len(off) - 1
    size, done = np.diff(off), np.zeros(n, dtype=np.int64)
    left = size.copy()
    index = ShardIndex(ids, off)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = at = 0
    carried, cursor = -1, 0

    def put(d: int) -> int:
        """As much of document d as fits; its rest is returned."""
        nonlocal at, seq
        take = min(int(left[d]), window - at)
        pieces.append((d, int(done[d]), take, seq, at))
        done[d] += take
        left[d] -= take
        at += take
        if at == window:
            seq, at = seq + 1, 0
        return int(left[d])

    while True:
        if carried >= 0 and left[carried]:
            seed = carried
        else:
            while cursor < n and not left[cursor]:
                cursor += 1
            if cursor == n:
                break
            seed = cursor
        carried = -1
        if put(seed):
            carried = seed
            continue
        if not at:
            continue
        score = index.scores(seed)
        score[left == 0] = 0
        near = np.flatnonzero(score)
        for d in near[np.lexsort((near, -score[near]))]:
            if put(int(d)):
                carried = int(d)
                break
            if not at:
                break
    if at:
        first = next(i for i in range(len(pieces) - 1, -1, -1) if pieces[i][4] == 0 and pieces[i][3] == seq)
        pieces[first:] = powers_of_two(pieces[first:], at, lambda k: seq + k)
    return pieces


def powers_of_two(tail: list, at: int, name) -> list:
    """The pieces of a window that ends at ``at``, laid into sequences name(0), name(1) and so on."""
    out, k, place, room = [], 0, 0, 1 << (at.bit_length() - 1)
    for d, start, length, _, _ in tail:
        while length:
            take = min(length, room - place)
            out.append((d, start, take, name(k), place))
            start, length, place, at = start + take, length - take, place + take, at - take
            if place == room and at:
                k, place, room = k + 1, 0, 1 << (at.bit_length() - 1)
    return out


class Lane:
    def __init__(self):
        self.seed, self.at, self.open = -1, 0, []


def pack_lanes(size: np.ndarray, lanes: int, window: int, neighbours):
    """Batches of pieces (document, start, length, sequence, offset), one batch a round.

    ``neighbours(seeds, rooms, free)`` returns arrays (place of the seed, document,
    score, whether more was kept back); of one answer the last row may have the mark.
    """
    left, done, free = size.astype(np.int64), np.zeros(len(size), np.int64), np.ones(len(size), bool)
    cursor = seq = 0
    out: list[tuple[int, int, int, int, int]] = []

    def put(lane: Lane, d: int) -> None:
        nonlocal seq
        free[d] = False
        take = min(int(left[d]), window - lane.at)
        lane.open.append((d, int(done[d]), take, 0, lane.at))
        done[d] += take
        left[d] -= take
        lane.at += take
        if lane.at == window:
            out.extend((*p[:3], seq, p[4]) for p in lane.open)
            seq, lane.at, lane.open = seq + 1, 0, []

    def wants(lane: Lane) -> bool:
        """Lays seeds until one ends within a window; false once there are none."""
        nonlocal cursor, seq
        while True:
            if lane.seed < 0:
                while cursor < len(free) and not free[cursor]:
                    cursor += 1
                if cursor == len(free):
                    if lane.at:
                        tail = powers_of_two(lane.open, lane.at, lambda k: seq + k)
                        out.extend(tail)
                        seq = tail[-1][3] + 1
                    return False
                lane.seed = cursor
            while left[lane.seed]:
                put(lane, lane.seed)
            if lane.at:
                return True
            lane.seed = -1

    active = [Lane() for _ in range(lanes)]
    while active := [x for x in active if wants(x)]:
        k, doc, score, more = neighbours(np.array([x.seed for x in active]), np.array([window - x.at for x in active]), free)
        order = np.lexsort((doc, -score, k))
        k, doc, more = k[order], doc[order].tolist(), more[order].tolist()
        ends = np.searchsorted(k, np.arange(len(active) + 1)).tolist()
        for lane, a, b in zip(active, ends, ends[1:]):
            seed, lane.seed = lane.seed, -1
            for i in range(a, b):
                if free[d := doc[i]]:
                    put(lane, d)
                    if left[d]:
                        lane.seed = d
                        break
                    if not lane.at:
                        break
                if more[i]:  # what a shard kept back may be better than the rest
                    lane.seed = seed
                    break
        yield out
        out = []
    yield out


def best(k: np.ndarray, doc: np.ndarray, score: np.ndarray, size: np.ndarray, more: np.ndarray, enough: np.ndarray):
    """Of each seed's rows the best, until their sizes make ``enough`` or a mark is met; the last one is then marked."""
    order = np.lexsort((doc, -score, k))
    k, doc, score, size, more = k[order], doc[order], score[order], size[order], more[order]
    first = np.searchsorted(k, k)
    total = np.cumsum(size)
    before = total - size - (total[first] - size[first])
    marks = np.cumsum(more)
    marked = marks - more - (marks[first] - more[first])
    kept = (before < enough[k]) & (marked == 0)
    last = kept & ~np.append(kept[1:] & (k[1:] == k[:-1]), False)
    cut = last & np.append((k[1:] == k[:-1]) & ~kept[1:], False)
    return k[kept], doc[kept], score[kept], size[kept], (more | cut)[kept]


class Query:
    """Seeds' term sets and the corpus's figures, as every task gets them."""

    def __init__(self, terms: np.ndarray, off: np.ndarray, enough: np.ndarray, free: np.ndarray, base: dict, df: np.ndarray, n: int, mean: float):
        self.terms, self.off, self.enough, self.base, self.mean = terms, off, enough, base, mean
        self.free = np.packbits(free)
        self.idf = idf_of(df, n)
        common = np.flatnonzero(df >= max(1, DENSE_SHARE * n))
        self.dense = np.sort(common[np.argsort(-df[common], kind="stable")[:DENSE]])

    def ask(self, shard: int, size: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, block: int = 1024):
        """Answers of one shard: (place of the seed, document, score, size, mark)."""
        base = self.base[shard]
        bits = np.unpackbits(self.free[base // 8 : (base + len(size) + 7) // 8])[base % 8 :][: len(size)].astype(bool)
        free = np.flatnonzero(bits)
        most = max(1, CELLS // max(len(self.dense), block))
        for at in range(0, len(free), most):
            yield from self._ask(base, free[at : at + most], size, term, doc, tf, block)

    def _ask(self, base: int, here: np.ndarray, size: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, block: int):
        """Answers of the documents ``here`` of a shard, as if they were a shard of their own."""
        bits = np.zeros(len(size), bool)
        bits[here] = True
        spot = np.cumsum(bits) - 1
        held = bits[doc]
        term, doc, tf = term[held], doc[held], tf[held]
        w = weights(self.idf[term], tf, size[doc], self.mean).astype(np.float32)
        doc = spot[doc]
        col = np.full(len(self.idf), -1, np.int64)
        col[self.dense] = np.arange(len(self.dense))
        packed = col[term] >= 0
        matrix = np.zeros((len(self.dense), len(here)), np.float32)
        matrix[col[term[packed]], doc[packed]] = w[packed]
        term, doc, w = term[~packed], doc[~packed], w[~packed]
        for a in range(0, len(self.off) - 1, block):
            b = min(a + block, len(self.off) - 1)
            own = self.terms[self.off[a] : self.off[b]]
            row = np.repeat(np.arange(b - a), np.diff(self.off[a : b + 1]))
            inside = col[own] >= 0
            seeds = np.zeros((b - a, len(self.dense)), np.float32)
            seeds[row[inside], col[own[inside]]] = 1
            score = seeds @ matrix
            own, row = own[~inside], row[~inside]
            low, high = np.searchsorted(term, own), np.searchsorted(term, own, "right")
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            np.add.at(score.reshape(-1), np.repeat(row * len(here), many) + doc[at], w[at])
            yield from self._top(score, here, size[here], base, a)

    def _top(self, score: np.ndarray, here: np.ndarray, size: np.ndarray, base: int, a: int):
        """The best documents of every row of scores, in whole classes of equal scores."""
        enough, n, rows = self.enough, len(here), np.arange(len(score))
        some = 64
        while len(rows):
            part = score[rows]
            if some < n:
                floor = np.partition(part, n - some, axis=1)[:, n - some]
                picked = part >= np.maximum(floor, np.finfo(np.float32).tiny)[:, None]
            else:
                picked = part > 0
            r, c = np.nonzero(picked)
            full = (np.bincount(r, weights=size[c], minlength=len(rows)) >= enough[a + rows]) | (picked.sum(1) == (part > 0).sum(1))
            fine = full[r]
            r, c = r[fine], c[fine]
            if len(r):
                order = np.lexsort((c, -part[r, c], r))
                r, c = r[order], c[order]
                # rows whose documents are not all picked are marked at their last one
                short = (picked.sum(1) < (part > 0).sum(1))[r] & np.append(r[1:] != r[:-1], True)
                yield best(a + rows[r], base + here[c], part[r, c], size[c], short, enough)
            rows, some = rows[~full], some * 8


def _rows(batch: pa.RecordBatch):
    """The batch's rows one by one; bytes stay where they are."""
    for i in range(batch.num_rows):
        yield {name: x.as_buffer() if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type) else x.as_py() for name, x in zip(batch.schema.names, (c[i] for c in batch.columns))}


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    """size, term, doc and tf of a row of the index."""
    terms, counts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["counts"], np.int32)
    size, doc, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("sizes", "docs", "tfs"))
    return size, np.repeat(terms, counts).astype(np.int64), doc, tf


def _asker(query):
    def ask(batches):
        found = []

        def merged():
            return list(best(*(np.concatenate(x) for x in zip(*found)), query.value.enough))

        for batch in batches:
            for row in _rows(batch):
                for answer in query.value.ask(row["shard"], *_arrays(row)):
                    found.append(answer)
                if sum(len(x[0]) for x in found) > 2_000_000:
                    found = [tuple(merged())]
        if found:
            yield from _answers(*merged()).to_batches()

    return ask


ANSWERS = "k long, doc long, score float, size long, more boolean"


def _answers(k: np.ndarray, doc: np.ndarray, score: np.ndarray, size: np.ndarray, more: np.ndarray) -> pa.Table:
    columns = [pa.array(x.astype(kind)) for x, kind in ((k, np.int64), (doc, np.int64), (score, np.float32), (size, np.int64), (more, bool))]
    return pa.table(columns, names=["k", "doc", "score", "size", "more"])


def _merger(query):
    """The best of all tasks' answers to a seed."""

    def merge(table: pa.Table) -> pa.Table:
        return _answers(*best(*(table.column(c).to_numpy() for c in ("k", "doc", "score", "size", "more")), MERGED // ANSWER * query.value.enough))

    return merge


def _encoded(path: str, end_id: int, table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A shard's documents in order, their ids and offsets."""
    encoder = tokens.encoder(path, CHUNKS)
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    flat, sizes = [], []
    for part in textops.slabs(iter(table.to_batches()), "text", TEXT):
        ids, off = encoder.encode(*textops.byte_view(textops.text_column(part, "text")), end_id)
        flat.append(ids)
        sizes.append(np.diff(off))
    return table, np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


INDEX = "shard long, doc_ids array<long>, ids binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"


def _indexer(path: str, end_id: int):
    def index(key: tuple, table: pa.Table) -> pa.Table:
        table, ids, off = _encoded(path, end_id, table)
        term, doc, tf = postings(ids, off)
        terms, counts = np.unique(term, return_counts=True)
        ids = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids.astype(np.uint32)
        small = [pa.array([x.astype(np.int32).tobytes()]) for x in (np.diff(off), terms, counts, doc, tf)]
        columns = [pa.array([key[0].as_py()]), pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([ids.tobytes()]), *small]
        return pa.table(columns, names=["shard", "doc_ids", "ids", "sizes", "terms", "counts", "docs", "tfs"])

    return index


def _term_counts(batches):
    for batch in batches:
        for row in _rows(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], np.int32).astype(np.int64)) for c in ("terms", "counts")], names=["term", "df"])


def _term_sets(batches):
    for batch in batches:
        for row in _rows(batch):
            size, term, doc, _ = _arrays(row)
            order = np.argsort(doc, kind="stable")
            term, cut = term[order].astype(np.int32), np.searchsorted(doc[order], np.arange(len(size) + 1))
            sets = [term[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), row["shard"])), pa.array(np.arange(len(size))), pa.array(sets, pa.binary())], names=["shard", "place", "own"])


def _piece_table(doc_ids, ids: np.ndarray, off: np.ndarray, pieces: np.ndarray) -> pa.Table:
    """Rows of SCHEMA; pieces: document, start, length, sequence, offset in columns."""
    doc, start, length, seq, place = pieces
    begin = off[doc] + start
    crc = np.fromiter((tokens.crc(ids[a : a + n]) for a, n in zip(begin, length)), np.int64, len(doc))
    columns = [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.diff(off)[doc]), pa.array(seq), pa.array(place)]
    return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    row = left.to_pylist()[0]
    size = np.frombuffer(row["sizes"], np.int32)
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ids = np.frombuffer(row["ids"], np.uint16 if len(row["ids"]) == 2 * off[-1] else np.uint32)
    pieces = [right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("place", "start", "length", "seq", "offset")]
    return _piece_table(pa.array(row["doc_ids"], pa.int64()), ids, off, pieces)


def _packer(path: str, window: int, end_id: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table, ids, off = _encoded(path, end_id, table)
        pieces = [np.array(x, dtype=np.int64) for x in zip(*pack_shard(ids, off, window))]
        return _piece_table(table.column("doc_id").combine_chunks(), ids, off, pieces)

    return pack


def _pack_shards(dealt: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    spark = dealt.sparkSession
    index = storage.stored(dealt.groupBy("shard").applyInArrow(_indexer(path, end_id), INDEX), "packing-index")
    sets = storage.stored(index.select("shard", "sizes", "terms", "counts", "docs", "tfs").mapInArrow(_term_sets, "shard long, place long, own binary"), "packing-sets")
    counted = index.select("terms", "counts").mapInArrow(_term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max(counted.column("term").to_pylist()) + 1, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    shards = index.select("shard", "sizes").orderBy("shard").toArrow()
    sizes = [np.frombuffer(x.as_py(), np.int32) for x in shards.column("sizes")]
    names, starts = shards.column("shard").to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
    size = np.concatenate(sizes)
    base = dict(zip(names.tolist(), starts.tolist()))
    known: dict[int, np.ndarray] = {}

    def neighbours(seeds: np.ndarray, rooms: np.ndarray, free: np.ndarray):
        nonlocal known
        new = np.array([s for s in seeds.tolist() if s not in known], dtype=np.int64)
        known = {s: known[s] for s in seeds.tolist() if s in known}
        if len(new):
            at = np.searchsorted(starts, new, "right") - 1
            wanted = spark.createDataFrame(pa.table({"shard": names[at], "place": new - starts[at]}))
            got = sets.join(F.broadcast(wanted), ["shard", "place"]).toArrow().to_pylist()
            known |= {base[r["shard"]] + r["place"]: np.frombuffer(r["own"], np.int32) for r in got}
        own = [known[s] for s in seeds.tolist()]
        query = spark.sparkContext.broadcast(Query(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), ANSWER * rooms, free, base, df, len(size), size.mean()))
        told = index.select("shard", "sizes", "terms", "counts", "docs", "tfs").mapInArrow(_asker(query), ANSWERS)
        found = told.groupBy("k").applyInArrow(_merger(query), ANSWERS).select("k", "doc", "score", "more").toArrow()
        query.destroy()
        return tuple(found.column(c).to_numpy(zero_copy_only=False) for c in ("k", "doc", "score", "more"))

    lanes = min(LANES, max(1, int(size.sum(dtype=np.int64)) // window // LANE_WINDOWS))
    laid = storage.fresh_uri(spark, "packing-pieces")
    batch: list[tuple[int, int, int, int, int]] = []

    def write() -> None:
        doc, start, length, seq, place = np.array(batch, dtype=np.int64).T
        at = np.searchsorted(starts, doc, "right") - 1
        spark.createDataFrame(pa.table({"shard": names[at], "place": doc - starts[at], "start": start, "length": length, "seq": seq, "offset": place})).write.mode("append").parquet(laid)
        batch.clear()

    for pieces in pack_lanes(size, lanes, window, neighbours):
        batch += pieces
        if len(batch) > HELD:
            write()
    if batch:
        write()
    pieces = spark.read.schema("shard long, place long, start long, length long, seq long, offset long").parquet(laid)
    return index.select("shard", "doc_ids", "ids", "sizes").groupBy("shard").cogroup(pieces.groupBy("shard")).applyInArrow(_finish, SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, end_id: int = tokens.END_ID) -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // shard_bytes), -(-n // SHARD_ROWS))
    path = tokenizer or tokens.tokenizer_path()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    if shards > 1:
        return _pack_shards(dealt, path, window, end_id)
    return dealt.groupBy("shard").applyInArrow(_packer(path, window, end_id), SCHEMA)
