"""Exact n-gram Jaccard join of documents and its link components.

A document is the set of its word shingles (64-bit hashes). The Jaccard distance
is a metric, but most documents are at distance 1 from every other, where no
pivot tells them apart. So pivots are found by necessary prefix tokens: all sets
are ordered by one approximate rarity order, and two linked sets share one of
their first n - ceil(t n) + 1 tokens. The documents of a token's cell take the
cell's smallest hash as pivot, and a pivot's region is the union of its cells; a
linked pair meets in one region at least. Inside a region, sub-pivots create
Voronoi cells, documents within the triangle-inequality window of another cell
are replicated to it, documents far from all sub-pivots make a cell of their own,
and cells join recursively; cells that no longer shrink are joined by exact
intersection counts. Regions beyond ``REGION`` documents are
joined as pairs of blocks in separate tasks. A first round over regions looks
only at bucketed shingle counts, whose L1 distance never exceeds the symmetric
difference, and leaves out documents without possible partner.

Nulls and edge cases: null, empty and blank texts have the empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle;
equal sets are joined once, as a class; null ids and repeated ids are rows like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, storage, textops

#: Buckets of the corpus-wide count sketch, and rows in which tasks send it.
_SKETCH_BITS, _SKETCH_ROWS = 18, 64
#: Buckets of a set's signature: about one for eight items, 2**6 to 2**13.
_SIG_BITS, _SIG_MOST, _SIG_ITEMS = 6, 13, 8
#: Documents of a region in one task; larger ones are cut into blocks of half that size.
REGION = 1500
#: Documents of a cell that has no more cells; sub-pivots at most; distance from all of them beyond which a document is in no cell of theirs.
_CELL, _PIVOTS, _FAR = 3, 6, 0.5
#: Share of its documents that a cell of a larger one may hold; up to _PEEL documents, one less is enough.
_SHRINK, _PEEL = 0.7, 16
#: Keys of texts to compare that are still sent to every task; more are joined by shuffling.
SENT = 500_000


def _sketch(n: int, text_col: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SKETCH_BITS, dtype=np.int64)
        for batch in textops.slabs(batches, text_col):
            h, _, _, at = textops.words(*textops.byte_view(textops.text_column(batch, text_col)), textops.SPACE)
            g, _, _ = textops.ngrams(h, at, n)
            total += np.bincount((g >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            rows = total.reshape(_SKETCH_ROWS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_ROWS), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["part", "counts"])

    return count


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Shingle counts of the whole corpus by hash bucket: 2**18 numbers at any size of the corpus."""
    parts = docs.select("text").mapInArrow(_sketch(n, "text"), "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    out = np.zeros((_SKETCH_ROWS, (1 << _SKETCH_BITS) // _SKETCH_ROWS), dtype=np.int64)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _set_hash(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(g) + 1, dtype=np.uint64)
    np.cumsum(textops.mix(g + np.uint64(0x632BE59BD9B4E019)), out=c[1:])
    return textops.mix((c[at[1:]] - c[at[:-1]]) ^ np.diff(at).astype(np.uint64))


def _describe(n: int, t: Fraction, sketch):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value
        for batch in textops.slabs(batches, "text"):
            g, at = textops.shingle_sets(*textops.byte_view(textops.text_column(batch, "text")), n)
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            need = size + (size > 0) - -(-size * t.numerator // t.denominator)
            order = np.lexsort((g, rank[(g >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)], doc))
            first = g[order][np.arange(len(g)) - at[:-1][doc] < need[doc]]
            bits = np.clip(np.ceil(np.log2(np.maximum(size, 1) / _SIG_ITEMS)), _SIG_BITS, _SIG_MOST).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(1 << bits)])
            sig = np.bincount(begin[doc] + (g >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64), minlength=begin[-1])
            sig = np.minimum(sig, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(size, pa.int64()),
                    pa.array(_set_hash(g, at).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need)]).astype(np.int32)), pa.array(first.view(np.int64))),
                    pa.array([sig[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "h", "prefix", "sig"],
            )

    return describe


_DESCRIBED = "doc_id long, text_key long, n_shingles long, h long, prefix array<long>, sig binary"


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slabs(batches, "text"):
            g, at = textops.shingle_sets(*textops.byte_view(textops.text_column(batch, "text")), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_set_hash(g, at).view(np.int64)), pa.array([g[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["h", "items"]
            )

    return sets


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by the keys, some groups at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        cols = [np.asarray(rest.column(k)) for k in keys]
        last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    cols = [np.asarray(table.column(k)) for k in keys]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, [table.num_rows]])


_KEYS = ["pivot", "i", "j"]


class _Signatures:
    """Bucketed counts of some sets; sets of neighbouring sizes are compared at the coarser of their scales.

    Counts end at 255. A bucket of a coarser scale is the sum of some of a finer
    one, so the L1 distance is at most the symmetric difference at every scale.
    """

    def __init__(self, raw: list[bytes]):
        sig = [np.frombuffer(x, np.uint8) for x in raw]
        self.level = np.array([len(x) for x in sig])
        self.place = np.zeros((2, len(sig)), dtype=np.int64)
        self.rows = {}
        for width in np.unique(self.level).tolist():
            own, finer = np.flatnonzero(self.level == width), np.flatnonzero(self.level == 2 * width)
            self.place[0, own] = np.arange(len(own))
            self.place[1, finer] = np.arange(len(finer)) + len(own)
            rows = [sig[i].astype(np.int32) for i in own] + [np.minimum(sig[i].reshape(width, 2).sum(axis=1, dtype=np.int32), 255) for i in finer]
            self.rows[width] = np.stack(rows)

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        """L1 distances of x to sets that are as large or larger, by less than two scales (else 0)."""
        width = self.level[x]
        rows, out = self.rows[width], np.zeros(len(others), dtype=np.int64)
        for step in (0, 1):
            there = self.level[others] == width << step
            out[there] = np.abs(rows[self.place[step, others[there]]] - rows[self.place[0, x]]).sum(axis=1)
        return out


def _possible(t: Fraction):
    """Leaves the documents of a region that can have a partner there, by size and signature."""
    num, den = t.numerator, t.denominator

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEYS):
            at = _bounds(table, _KEYS)
            size = np.asarray(table.column("n_shingles"))
            sigs = table.column("sig")
            block, i, j = (np.asarray(table.column(c)) for c in ("block", "i", "j"))
            keep = np.zeros(len(size), dtype=bool)
            n = np.diff(at)
            # pairs whose sizes are too far apart need no further look
            low, high = np.minimum(size[at[:-1]], size[at[1:] - 1]), np.maximum(size[at[:-1]], size[at[1:] - 1])
            for k in np.flatnonzero((n > 2) | ((n == 2) & (low * den >= num * high))):
                own = np.arange(at[k], at[k + 1])
                order = np.argsort(size[own], kind="stable")
                sig = _Signatures([bytes(x) for x in sigs.slice(at[k], n[k]).to_pylist()])
                own_size, across, own_block = size[own], i[at[k]] != j[at[k]], block[own]
                ends = np.searchsorted(own_size[order], own_size[order] * den // num, side="right")
                for x in range(len(order)):
                    me, others = order[x], order[x + 1 : ends[x]]
                    if across:
                        others = others[own_block[others] != own_block[me]]
                    if len(others) and not (keep[own[me]] and keep[own[others]].all()):
                        ok = sig.distances(me, others) * (den + num) <= (den - num) * (own_size[me] + own_size[others])
                        if ok.any():
                            keep[own[me]] = True
                            keep[own[others[ok]]] = True
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(pa.array(keep)) for c in (*_KEYS, "block", "h")], [*_KEYS, "block", "h"])

    return survive


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class RegionJoin:
    """Links of the sets of one region, as the edges of a spanning forest."""

    def __init__(self, items: list[np.ndarray], t: Fraction, block: np.ndarray, across: bool):
        self.size = np.array([len(x) for x in items], dtype=np.int64)
        flat = np.concatenate(items)
        _, self.tok = np.unique(flat, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.doc = np.repeat(np.arange(len(items)), self.size)
        self.t, self.eps = t, 1 - t
        self.block, self.across = block, across
        self.forest, self.edges = _Forest(len(items)), []
        #: Rows that windows added, and levels of cells within cells.
        self.replicas = self.deepest = 0

    def _linked(self, inter, a, b):
        union = self.size[a] + self.size[b] - inter
        return self.t.denominator * inter >= self.t.numerator * union

    def distances(self, pivots: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances and intersections of each pivot and each of own."""
        size = self.size[own]
        begin = np.cumsum(size) - size
        flat = self.tok[np.repeat(self.at[own] - begin, size) + np.arange(size.sum())]
        inter = np.zeros((len(pivots), len(own)), dtype=np.int64)
        mark = np.zeros(self.tok.max() + 1, dtype=np.int64)
        for k, p in enumerate(pivots):
            items = self.tok[self.at[p] : self.at[p + 1]]
            mark[items] = 1
            inter[k] = np.add.reduceat(mark[flat], begin)
            mark[items] = 0
        return 1 - inter / (size[None, :] + self.size[pivots][:, None] - inter), inter

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.across:
            good = self.block[a] != self.block[b]
            a, b = a[good], b[good]
        for x, y in zip(a.tolist(), b.tolist()):
            if self.forest.link(x, y):
                self.edges.append((x, y))

    def direct(self, own: np.ndarray) -> None:
        """All links among own, by intersection counts: frequent tokens as a dense product, the rest by their lists."""
        m = len(own)
        if m < 2:
            return
        where = np.concatenate([np.arange(self.at[d], self.at[d + 1]) for d in own])
        tok, inv, df = np.unique(self.tok[where], return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), self.size[own])
        inter = np.zeros((m, m), dtype=np.float32)
        often = df > max(8, m // 24)
        number = np.cumsum(often) - 1
        hot = often[inv]
        cols, rows = number[inv[hot]], row[hot]
        for k in range(0, int(often.sum()), 2048):
            part = (cols >= k) & (cols < k + 2048)
            dense = np.zeros((m, 2048), dtype=np.float32)
            dense[rows[part], cols[part] - k] = 1
            inter += dense @ dense.T
        cold = np.flatnonzero(~hot & (df[inv] > 1))
        order = cold[np.argsort(inv[cold], kind="stable")]
        lists = np.flatnonzero(np.diff(inv[order], prepend=-1))
        ends = np.append(lists[1:], len(order))
        for width in np.unique(ends - lists):
            block = row[order[lists[ends - lists == width][:, None] + np.arange(width)]]
            for x in range(width):
                for y in range(x + 1, width):
                    np.add.at(inter, (block[:, x], block[:, y]), 1)
                    np.add.at(inter, (block[:, y], block[:, x]), 1)
        a, b = np.nonzero(np.triu(inter, 1))
        good = self._linked(inter[a, b].astype(np.int64), own[a], own[b])
        self._add(own[a[good]], own[b[good]])

    def join(self, own: np.ndarray, depth: int = 0) -> None:
        """Links of own by cells of sub-pivots.

        Let near(x) be x's distance from its nearest sub-pivot p. If near(x) is at
        most _FAR, all y within eps of x have d(y, p) <= _FAR + eps and
        d(y, p) <= near(y) + 2 eps; so both are in p's cell. Pairs of documents that
        are farther from all sub-pivots meet in the cell of these.
        """
        if len(own) <= _CELL:
            return self.direct(own)
        pivots = own[np.unique(np.linspace(0, len(own) - 1, min(_PIVOTS, max(2, len(own) // 4))).astype(int))]
        d, inter = self.distances(pivots, own)
        eps, near = float(self.eps), d.min(axis=0)
        for k, p in enumerate(pivots):  # a link with a pivot is known at once
            linked = own[self._linked(inter[k], own, np.full(len(own), p)) & (own != p)]
            self._add(linked, np.full(len(linked), p))
        cells = [own[c] for c in (*(d <= np.minimum(near + 2 * eps, _FAR + eps) + 1e-9), near > _FAR)]
        largest = max(map(len, cells))
        if largest > max(_SHRINK * len(own), min(len(own) - 1, _PEEL)):
            return self.direct(own)
        self.replicas += sum(map(len, cells)) - len(own)
        self.deepest = max(self.deepest, depth + 1)
        for cell in cells:
            self.join(cell, depth + 1)


def _links(t: Fraction):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEYS):
            at = _bounds(table, _KEYS)
            h = np.asarray(table.column("h"))
            block = np.asarray(table.column("block"))
            i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
            items = table.column("items")
            us, vs = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, "<u8") for x in items.slice(a, b - a).to_pylist()]
                if b - a == 2:
                    if i[a] != j[a] and block[a] == block[a + 1]:
                        continue
                    inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                    if t.denominator * inter >= t.numerator * (len(sets[0]) + len(sets[1]) - inter):
                        us.append(h[a])
                        vs.append(h[a + 1])
                    continue
                region = RegionJoin(sets, t, block[a:b], bool(i[a] != j[a]))
                region.join(np.arange(b - a))
                us += [h[a + x] for x, _ in region.edges]
                vs += [h[a + y] for _, y in region.edges]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return links


def _with_blocks(regions: DataFrame, limit: int) -> DataFrame:
    """Regions of at most ``limit`` documents as they are, others as pairs of blocks of half that size."""
    wide = regions.groupBy("pivot").agg(F.count("*").alias("members")).withColumn("blocks", F.when(F.col("members") <= limit, 1).otherwise(F.ceil(F.col("members") / (limit // 2))).cast("int"))
    b = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, b).cast("int").alias("i"), F.greatest(x, b).cast("int").alias("j")))
    dealt = regions.join(wide, "pivot").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    return dealt.withColumn("ij", F.explode(pairs)).where((F.col("blocks") == 1) | (F.col("ij.i") != F.col("ij.j")) | (F.col("ij.i") == b)).select("pivot", "ij.i", "ij.j", "block", "h")


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, h) for the documents of each token, of rows sorted by token and h; the first is the pivot.

    Only the last token and its pivot are carried from batch to batch. A token of
    one document has no row, and with each other document's row there is one of
    the pivot itself (distinct() follows).
    """
    token = pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        begin = np.concatenate([[token is None or t[0] != token], t[1:] != t[:-1]])
        own = h[begin] if begin[0] else np.append(np.array([pivot], h.dtype), h[begin])
        p = own[np.cumsum(begin) - int(begin[0])]
        other = p != h
        both = np.unique(np.stack([np.concatenate([p[other], p[other]]), np.concatenate([h[other], p[other]])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["pivot", "h"])
        token, pivot = t[-1], p[-1]


def join_classes(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """(documents, links' components).

    The first has doc_id, n_shingles and h, the hash of the shingle set, for
    every row; the second has (node, root) for sets with links to other sets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(count_sketch(rows, n))
    described = storage.stored(rows.mapInArrow(_describe(n, threshold, sketch), _DESCRIBED), "described")
    one = described.where("n_shingles > 0").groupBy("h").agg(F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"))
    classes = storage.stored(one, "classes")
    documents = storage.stored(described.select("doc_id", "n_shingles", "h"), "documents")
    storage.dropped(spark, described)
    cells = classes.select(F.explode("prefix").alias("token"), "h").repartition("token").sortWithinPartitions("token", "h")
    regions = storage.stored(cells.mapInArrow(_starred, "pivot long, h long").distinct(), "regions")
    small = classes.select("h", "n_shingles", "sig")
    dealt = _with_blocks(regions, region)
    grouped = dealt.join(small, "h").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "h")
    possible = storage.stored(grouped.mapInArrow(_possible(threshold), "pivot long, i int, j int, block int, h long"), "possible")
    wanted = storage.stored(classes.join(possible.select("h").distinct(), "h", "left_semi").select("text_key").distinct(), "wanted")
    storage.dropped(spark, classes, regions)
    few = wanted.count() <= SENT
    texts = rows.join(F.broadcast(wanted) if few else wanted, "text_key", "left_semi")
    items = texts.select("text").mapInArrow(_sets(n), "h long, items binary").groupBy("h").agg(F.first("items").alias("items"))
    filled = possible.join(items, "h").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "h")
    links = filled.mapInArrow(_links(threshold), "u long, v long")
    return documents, components.components(links)


def near_classes(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), region: int = REGION) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id that links of at least ``threshold``
    Jaccard similarity reach, the row's own included.
    """
    rows, comps = join_classes(docs, n, threshold, region)
    full, empty = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    classes = full.groupBy("h").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(comps.withColumnRenamed("node", "h"), "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(named, "root").select("h", "component_id")
    return full.join(ids, "h").select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
