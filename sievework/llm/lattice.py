"""Near-duplicate vectors by lattice hashing.

Vectors are compared with those of their label only. Equal vectors are one class,
collapsed before anything else. In each of several tables a class's unit vector
is projected to two blocks of eight dimensions by Gaussian directions, and each block
is decoded to the nearest point of the E8 lattice; both points make the class's
home cell. Each class also probes the cells to which the least distance leads: one
step in one block along a minimal vector of the lattice. Two classes meet if one
probes the other's home. Cells with one class, or without a home, are counted
away before any vector moves; the others get the vectors of their classes, and
cosines in double precision decide. A pair that meets in several cells counts in
the first of them (by table and cell), so links are counted without a list of
pairs, and each task reports sums for its classes and a forest of the links it
saw, which the components need.

A cell of more than ``BLOCK`` classes is cut into blocks of that size, and pairs
of blocks are tasks of their own. That is for distinct vectors that are all close
to each other: their links grow with the square, and so do the products, but the
rows only with m^2 / BLOCK.

Recall: with the defaults, two random vectors of 64 dimensions at cosine 0.98
meet with a probability over 0.999 (closer ones more likely), whatever the size
of the table; nothing is sampled or capped. Finer cells for larger tables are a
matter of ``scale``, and more ``tables`` make up for them.

Nulls and edge cases: vectors that are null, empty, zero or hold null or
non-finite components, and vectors without label, link with nothing; vectors of
different lengths don't link; -0.0 equals 0.0; rows of one id are vectors of their
own, and count as other vectors; rows without id take part, and have the smallest
id they reach, or none; other columns of the input are left aside, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, storage
from .textops import mix

TABLES, BLOCKS, PROBES, SCALE, SEED = 6, 2, 4, 0.6, 20
#: Classes of a cell that are compared at once.
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minuses."""
    signs = np.array(list(itertools.product((1.0, -1.0), repeat=8)))
    halves = signs[np.prod(signs, axis=1) > 0] / 2
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for x, y in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = x, y
            pairs.append(v)
    return np.concatenate([np.array(pairs), halves])


_MINIMAL = minimal_vectors()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with an even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 of each row."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component first becomes 1, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Lattice:
    """Home cells and probes of unit vectors, as 64-bit keys."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.probes = blocks, probes
        self.ways = rng.normal(size=(tables, dim, 8 * blocks)) * scale
        self.shift = rng.random((tables, 8 * blocks))
        self.odd = rng.integers(0, 2**64, 8 * blocks, dtype=np.uint64) | np.uint64(1)

    def _key(self, table: int, points: np.ndarray, salt: np.ndarray) -> np.ndarray:
        h = salt + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for j in range(points.shape[1]):
            h = mix(h ^ ((2 * points[:, j]).astype(np.int64).view(np.uint64) * self.odd[j]))
        return h.view(np.int64)

    def cells(self, v: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): each row's home and the cells it probes. Rows of different salts share no cell."""
        out = np.zeros((len(v), len(self.ways), 1 + self.probes), np.int64)
        rows = np.arange(len(v))
        for t, (way, shift) in enumerate(zip(self.ways, self.shift)):
            x = v @ way + shift
            home, gain = np.zeros_like(x), []
            for b in range(self.blocks):
                part = slice(8 * b, 8 * b + 8)
                home[:, part] = nearest_point(x[:, part])
                gain.append((x[:, part] - home[:, part]) @ _MINIMAL.T)  # the nearer a neighbouring cell, the greater
            out[:, t, 0] = self._key(t, home, salt)
            order = np.argsort(-np.concatenate(gain, axis=1), axis=1, kind="stable")[:, : self.probes]
            for p in range(self.probes):
                moved = home.copy()
                block, which = np.divmod(order[:, p], len(_MINIMAL))
                moved[rows[:, None], 8 * block[:, None] + np.arange(8)] += _MINIMAL[which]
                out[:, t, 1 + p] = self._key(t, moved, salt)
        return out


def _usable(vector: Column) -> Column:
    """The vector without negative zeros; null if it links with nothing."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.transform(vector, lambda x: x + F.lit(0).cast("float")))


def _celled(classes: DataFrame, **shape) -> DataFrame:
    """classes with their cells, table by table: 1 + probes keys each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Lattice] = {}
        for batch in batches:
            of = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            size = np.diff(np.asarray(of["v"].offsets))
            cells: list = [None] * batch.num_rows
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                v = np.asarray(of["v"].take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
                lattice = known.setdefault(int(dim), Lattice(int(dim), **shape))
                salt = mix(np.asarray(of["label"])[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(dim))
                for i, own in zip(at, lattice.cells(unit(v), salt).reshape(len(at), -1)):
                    cells[i] = own
            flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            each = len(flat) // max(batch.num_rows, 1)
            yield pa.RecordBatch.from_arrays([*of.values(), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * each, pa.int32()), pa.array(flat))], [*of, "cells"])

    return classes.mapInArrow(run, f"{_ddl(classes)}, cells array<long>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, by label spreading and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


class _Cell:
    """The classes of one cell, or of two blocks of one."""

    def __init__(self, key: int, same: bool, rows: dict[str, np.ndarray], tables: int):
        self.key, self.same, self.rows = key, same, rows
        self.cells = rows["cells"].reshape(len(rows["id"]), tables, -1)
        self.home = self.cells[:, :, 0]
        at = np.argwhere(self.cells == key)
        self.table = int(at[0, 1])
        self.at_home = self.home[:, self.table] == key

    def _meet(self, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.home[i, table, None] == self.cells[j, table]).any(axis=1) | (self.home[j, table, None] == self.cells[i, table]).any(axis=1)

    def links(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that link, and meet here first."""
        v, block = unit(self.rows["v"].astype(np.float64)), self.rows["block"]
        near = v @ v.T >= threshold
        here = self.at_home[:, None] | self.at_home[None, :]
        i, j = np.nonzero(np.triu(near & here, 1))
        if not self.same:
            across = block[i] != block[j]
            i, j = i[across], j[across]
        t = self.table
        # with one home here, the two may also meet in the other one's
        other = np.where(self.at_home[i], self.home[j, t], self.home[i, t])
        guest = np.where(self.at_home[i], i, j)
        also = (other != self.key) & (self.cells[guest, t] == other[:, None]).any(axis=1)
        first = ~also | (self.key < other)
        for earlier in range(t):
            first &= ~self._meet(earlier, i, j)
        return i[first], j[first]


def _compared(members: DataFrame, threshold: float, tables: int) -> DataFrame:
    """u, v, n: links counted for a class u (v null), and a forest of the links (u, v)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        """Rows of one pair of blocks, which may come in several batches."""
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, a, b = (np.asarray(batch.column(c)) for c in range(3))
            new = np.flatnonzero((np.diff(k) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for begin, end in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
                own = (int(k[begin]), int(a[begin]), int(b[begin]))
                if own != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = own
                held.append(batch.slice(begin, end - begin))
        if held:
            yield key, pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64(), mask=m) for x, m in ((out[0], None), (out[1], np.concatenate(out[1]) < 0), (out[2], None))], ["u", "v", "n"])
            for x in out:
                x.clear()
            return batch

        for (key, a, b), table in groups(batches):
            rows = {n: np.asarray(table.column(n).combine_chunks()) for n in ("id", "n", "block")}
            for n in ("v", "cells"):
                rows[n] = np.asarray(table.column(n).combine_chunks().flatten()).reshape(len(rows["id"]), -1)
            cell = _Cell(key, a == b, rows, tables)
            i, j = cell.links(threshold)
            if not len(i):
                continue
            ids, weight = rows["id"], rows["n"].astype(np.float64)
            links = (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
            root = _roots(len(ids), i, j)
            some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
            out[0] += [ids[some], ids[tied]]
            out[1] += [np.full(len(some), -1), ids[root[tied]]]
            out[2] += [links[some], np.zeros(len(tied), np.int64)]
            if sum(map(len, out[0])) > 20_000:
                yield flush()
        if out[0]:
            yield flush()

    return members.mapInArrow(run, "u long, v long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (the smallest id reached) and kept (it is its own)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(label_col).isNotNull(), _usable(F.col(vector_col))).alias("v"), F.col(label_col).cast("long").alias("label"))
    # two hashes stand for a vector where its rows are looked up again
    keyed = [F.xxhash64(F.lit(k), "label", "v") for k in (1, 2)]
    counted = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    numbered = counted.select(F.monotonically_increasing_id().alias("id"), "n", "least", *(k.alias(f"h{i}") for i, k in enumerate(keyed)), "label", "v")
    classes = storage.stored(_celled(numbered, tables=tables, blocks=blocks, probes=probes, scale=scale), "vectors")

    keys = classes.select("id", F.posexplode("cells").alias("at", "key")).select("id", "key", (F.col("at") % (1 + probes) == 0).alias("home"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.max("home").alias("some")).where("members > 1 and some")
    pieces = F.ceil(F.col("members") / block).cast("int")
    held = keys.join(shared, "key").select("id", "key", F.pmod(F.xxhash64("id", "key"), pieces).cast("int").alias("block"), pieces.alias("pieces"))
    spread = held.select("id", "key", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("with"))
    paired = spread.select("id", "key", "block", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"))
    members = paired.join(classes.select("id", "n", "v", "cells"), "id").select("key", "a", "b", "block", "id", "n", "v", "cells")
    found = storage.stored(_compared(members.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b"), threshold, tables), "links")

    tree = components.components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    # a class is of interest if it has a link or several rows
    linked = classes.select("id", "n", "least", "h0", "h1").join(links.withColumnRenamed("u", "id"), "id", "left").join(tree.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or links > 0")
    linked = linked.select("h0", "h1", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "id").alias("root"))
    told = storage.stored(linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("h0", "h1", "n_links", "component"), "linked")
    storage.dropped(spark, classes, found)

    out = rows.select("vec_id", *(F.when(F.col("v").isNotNull(), k).alias(f"h{i}") for i, k in enumerate(keyed))).join(told, ["h0", "h1"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
