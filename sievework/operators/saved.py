"""Search indexes on disk: bucketed tables, so that a search shuffles its queries and never the index.

An index is one published version (sources/publish.py) of a few tables. Tables that
a search joins are bucketed and sorted by the join's keys, and the commit lists
each one's schema, buckets and number of rows (of postings: their number); opening
an index compares these with what is there. A sparse index has its postings by
(part, term), a row for each term of a slab of documents with its postings in
lists, and those of terms with more than ``HOT`` postings in a table of their own
by (part, term, salt), so no bucket holds a whole hot term; the table of terms
lists the number of salts. A dense index has blocks of vectors by (dim, gate, slot).
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.publish import Publication

from . import bm25, dense, scan

#: Postings of a term under one salt.
HOT = 1_000_000


def buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that a join deals its other side like the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


class Tables:
    """The tables of one version, written one after the other and then committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.publication = spark, Publication(spark, root)
        self.folder, self.tables = self.publication.stage(), {}

    def add(self, name: str, df: DataFrame, by: list[str] | None = None, dealt: bool = False, lists: str | None = None) -> DataFrame:
        """Writes a table, bucketed by columns if some are given (``dealt``: df is already), and gives it back as it can be read; ``lists``: whose entries are its rows."""
        path, count = f"{self.folder}/{name}", buckets(self.spark)
        if by:
            table = f"saved_{uuid.uuid4().hex}"
            (df if dealt else df.repartition(count, *by)).write.format("parquet").option("compression", "zstd").bucketBy(count, *by).sortBy(*by).option("path", path).saveAsTable(table)
            self.spark.sql(f"drop table {table}")  # the catalog's entry; the files stay
        else:
            df.write.parquet(path)
        self.tables[name] = {"schema": df.schema.toDDL(), "by": by or [], "buckets": count if by else 0, "lists": lists}
        back = opened(self.spark, path, self.tables[name])
        self.tables[name]["rows"] = rows(back, lists)
        del df
        gc.collect()  # shuffle files that only served the writing go with the driver's garbage
        self.spark.sparkContext._jvm.System.gc()
        return back

    def drop(self, name: str) -> None:
        """Deletes a table that only served others."""
        self.publication.files.delete(f"{self.folder}/{name}")
        del self.tables[name]

    def commit(self, **info) -> dict:
        return self.publication.commit(self.folder, tables=self.tables, **info)


def opened(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """A table by its path, with the buckets it was written in."""
    if not spec["by"]:
        return spark.read.schema(spec["schema"]).parquet(path)
    table, by = f"saved_{uuid.uuid4().hex}", ", ".join(spec["by"])
    spark.sql(f"create table {table} ({spec['schema']}) using parquet options (path '{path}') clustered by ({by}) sorted by ({by}) into {spec['buckets']} buckets")
    df = spark.table(table)
    spark.sql(f"drop table {table}")  # df knows its files by now
    return df


def rows(table: DataFrame, lists: str | None) -> int:
    """The rows of a table, or the entries of its lists."""
    return table.agg(F.sum(F.size(lists))).first()[0] or 0 if lists else table.count()


def load(spark: SparkSession, root: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the current version and its commit; a wrong kind or number of rows is an error."""
    publication = Publication(spark, root)
    commit = publication.current()
    if commit.get("kind") != kind:
        raise ValueError(f"{root} holds {commit.get('kind')}, not {kind}")
    folder, tables = publication.folder(commit), {}
    for name, spec in commit["tables"].items():
        table = tables[spec.get("serves", name)] = opened(spark, f"{folder}/{name}", spec)
        found = rows(table, spec.get("lists"))
        if found != spec["rows"]:
            raise ValueError(f"{folder}/{name} has {found} rows instead of {spec['rows']}")
    return tables, commit


class SparseIndex(bm25.Index):
    """A saved index in the place of one that is built from texts."""

    def __init__(self, tables: dict[str, DataFrame], commit: dict):
        self.cold, self.hot = tables["postings"], tables.get("hot")
        every = self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("salt"))
        super().__init__(tables["docs"], _listed(every), tables["sizes"], slabs=every)
        self.vocabulary, self.n = tables["terms"], commit["n"]

    def idf(self, wanted: DataFrame) -> DataFrame:
        return bm25.with_idf(self.vocabulary.join(wanted.select("term").distinct(), "term", "left_semi").select("part", "term", "df"), self.sizes)

    def hits(self, kept: DataFrame, few: bool) -> DataFrame:
        # the query's side is hashed, so that the index is neither shuffled nor sorted
        if self.hot is None:
            return _listed(self.cold.join(kept.hint("shuffle_hash"), ["part", "term"]))
        salted = kept.join(self.vocabulary.select("part", "term", "salts"), ["part", "term"])
        cold = self.cold.join(salted.where("salts = 1").drop("salts").hint("shuffle_hash"), ["part", "term"])
        each = salted.where("salts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return _listed(cold.unionByName(self.hot.join(each.hint("shuffle_hash"), ["part", "term", "salt"]).drop("salt")))


def _listed(slabs: DataFrame) -> DataFrame:
    """doc, dl, tf of each posting, with the other columns."""
    others = [c for c in slabs.columns if c not in ("slab", "docs", "dls", "tfs")]
    each = slabs.select(*others, F.explode(F.arrays_zip("docs", "dls", "tfs")).alias("x"))
    return each.select(*others, F.col("x.docs").alias("doc"), F.col("x.dls").alias("dl"), F.col("x.tfs").cast("long").alias("tf"))


def _slabs(index: bm25.Index, n: int) -> DataFrame:
    if index.texts is not None and n <= scan.LONGEST:
        return scan.inverted(index.texts, n)
    slab = F.xxhash64("doc") % max(1, index.docs.count() // 1024)
    rows = index.terms.groupBy("part", slab.alias("slab"), "term").agg(F.collect_list(F.struct("doc", "dl", "tf")).alias("x"))
    return rows.select("part", "slab", "term", F.col("x.doc").alias("docs"), F.col("x.dl").alias("dls"), F.col("x.tf").cast("array<int>").alias("tfs"))


def save_sparse(index: bm25.Index, root: str, n: int = 2, hot: int = HOT, **info) -> dict:
    """Writes an index that ``bm25.build`` made of n-grams of size n; returns its commit."""
    out = Tables(index.docs.sparkSession, root)
    docs = out.add("docs", index.docs)
    out.add("sizes", docs.groupBy("part").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    postings = out.add("postings", _slabs(index, n), ["part", "term"], lists="docs")
    salts = F.greatest(F.lit(1), F.ceil(F.col("df") / hot)).cast("int").alias("salts")
    terms = out.add("terms", postings.groupBy("part", "term").agg(F.sum(F.size("docs")).alias("df")).select("part", "term", "df", salts), ["term"])
    many = terms.where("salts > 1").select("part", "term", "salts")
    if not many.isEmpty():
        salted = postings.join(many.hint("shuffle_hash"), ["part", "term"]).withColumn("salt", F.pmod(F.xxhash64("slab"), F.col("salts")).cast("int"))
        out.add("hot", salted.select("part", "term", "salt", "slab", "docs", "dls", "tfs"), ["part", "term", "salt"], lists="docs")
        out.add("cold", postings.join(many.hint("shuffle_hash"), ["part", "term"], "left_anti"), ["part", "term"], dealt=True, lists="docs")
        out.drop("postings")
        out.tables["cold"]["serves"] = "postings"
    return out.commit(kind="sparse", n=n, hot=hot, **info)


def load_sparse(spark: SparkSession, root: str) -> SparseIndex:
    return SparseIndex(*load(spark, root, "sparse"))


def save_dense(vectors: DataFrame, root: str, key: str, vector: str, gate: str | None = None, **info) -> dict:
    """Writes the blocks of a dense index; searches with a gate need one that was saved with it."""
    out = Tables(vectors.sparkSession, root)
    out.add("blocks", dense.blocks(vectors, key, vector, gate), ["dim", "gate", "slot"])
    return out.commit(kind="dense", gated=gate is not None, **info)


def search_dense(spark: SparkSession, root: str, queries: DataFrame, key: str, vector: str, k: int, gate: str | None = None, others: bool = True) -> DataFrame:
    """``dense.search`` over a saved index."""
    tables, commit = load(spark, root, "dense")
    if commit["gated"] != (gate is not None):
        raise ValueError(f"{root} was saved {'with' if commit['gated'] else 'without'} a gate")
    return dense.search_blocks(tables["blocks"], queries, key, vector, k, gate, others)
