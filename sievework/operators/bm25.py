"""Sparse BM25 as joins of term tables.

An index is two tables: terms (doc, term, tf, dl) and, from it, statistics by
partition: a partition column may be a constant (one corpus) or a label. A saved
index (operators/saved.py) answers the same questions from tables on disk.
best() and okapi_top() of an index that is not saved make no such tables: they
pass over the texts twice (operators/scan.py), once for statistics and once for
scores. Only queries that don't fit a task go by the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import character_ngrams, ngram_count
from sievework.session import spread
from sievework.sources.files import stored

from . import scan

K1, B = 1.5, 0.75
#: Unless all terms are asked for: query terms below this idf are noise, unless a query has no others; terms that a query keeps.
MIN_IDF, MAX_TERMS = 0.2, 64
#: Cap of a term's query frequency.
MAX_QTF = 3
#: Kept query terms that are still sent to every task; more are joined by shuffling.
SENT = 500_000


@dataclass
class Index:
    """docs: doc, part, dl; terms: doc, part, dl, term, tf, dealt by doc; sizes: part, n, avgdl; texts, unless saved: doc, part, text and the other columns; slabs, if saved: postings in lists."""

    docs: DataFrame
    terms: DataFrame
    sizes: DataFrame
    texts: DataFrame | None = None
    slabs: DataFrame | None = None

    def idf(self, wanted: DataFrame) -> DataFrame:
        """part, term, idf of the wanted terms."""
        df = self.terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("part", "term").agg(F.count("*").alias("df"))
        return with_idf(df, self.sizes)

    def hits(self, kept: DataFrame, few: bool) -> DataFrame:
        """kept (query, part, term and more) with doc, dl, tf of each posting."""
        return self.terms.join(F.broadcast(kept) if few else kept, ["part", "term"])


def build(docs: DataFrame, key: str, text: str, part: str | None = None, n: int = 2) -> Index:
    """The index of the n-grams of a text column; with ``part`` one for each of its values."""
    named = docs.select(F.col(key).alias("doc"), (F.col(part) if part else F.lit("")).alias("part"), F.col(text).alias("text"))
    lengths = spread(named).select("doc", "part", ngram_count(F.col("text"), n).alias("dl"))
    # texts are dealt by document once, so that their grams are counted where they are made
    # (with a number, because texts grow when they are cut and few bytes would be few tasks)
    rows = named.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism), "doc")
    counted = rows.select("doc", "part", ngram_count(F.col("text"), n).alias("dl"), character_ngrams(F.col("text"), n).alias("grams"))
    grams = counted.select("doc", "part", "dl", F.explode("grams").alias("term"))
    terms = grams.groupBy("doc", "part", "dl", "term").agg(F.count("*").alias("tf"))
    sizes = lengths.groupBy("part").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    others = [c for c in docs.columns if c not in (key, text, "doc", "part", "text")]
    texts = docs.select(F.col(key).alias("doc"), (F.col(part) if part else F.lit("")).alias("part"), F.col(text).alias("text"), *others)
    return Index(lengths, terms, sizes, spread(texts))


def query_terms(queries: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """query, term, qtf."""
    return queries.select(F.col(key).alias("query"), F.explode(character_ngrams(F.col(text), n)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def with_idf(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """part, term, idf of terms with their number of documents (part, term, df)."""
    return df.join(sizes, "part").select("part", "term", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def informative(terms: DataFrame, weights: DataFrame, every: bool = False) -> DataFrame:
    """query, part, term, weight (idf times capped query frequency): the strongest terms of each query in a part, or with ``every`` all of them."""
    met = terms.join(weights, "term").withColumn("weight", F.round(F.col("idf") * F.least("qtf", F.lit(MAX_QTF)), 12))
    if every:
        return met.select("query", "part", "term", "weight")
    by = Window.partitionBy("query", "part")
    some = met.withColumn("good", F.col("idf") >= MIN_IDF).withColumn("any_good", F.max("good").over(by)).where("good or not any_good")
    return some.withColumn("k", F.row_number().over(by.orderBy(F.desc("weight"), "term"))).where(F.col("k") <= MAX_TERMS).select("query", "part", "term", "weight")


def scores(index: Index, queries: DataFrame, key: str, text: str, n: int = 2, parts: DataFrame | None = None, every: bool = False) -> DataFrame:
    """query, doc, part, score of all documents that share a kept term (``every``: any term); ``parts`` (query, part) restricts the search."""
    asked = query_terms(queries, key, text, n)
    weights = index.idf(asked)
    kept = informative(asked, weights, every)
    if parts is not None:
        kept = kept.join(parts, ["query", "part"], "left_semi")
    kept = kept.join(index.sizes.select("part", "avgdl"), "part")
    # a query keeps MAX_TERMS terms at most in each part, or all of its own
    few = parts is None and (asked.count() if every else queries.select(key).distinct().count() * MAX_TERMS) * index.sizes.count() <= SENT
    hits = index.hits(kept, few)
    norm = K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("query", "doc", "part").agg(F.round(F.sum(gain), 9).alias("score"))


def okapi_scores(index: Index, queries: DataFrame, key: str, text: str, n: int = 2, epsilon: float = 0.25) -> DataFrame:
    """The variant that scores every document (0 without shared terms), counts repeated query terms and floors negative idf.

    All pairs of queries and documents: for small tables. okapi_top() makes no such pairs.
    """
    found = _okapi_found(index, queries, key, text, n, epsilon)
    every = queries.select(F.col(key).alias("query")).distinct().crossJoin(index.docs.select("doc", "part"))
    return every.join(found, ["query", "doc", "part"], "left").select("query", "doc", "part", F.coalesce("score", F.lit(0.0)).alias("score"))


def best(index: Index, queries: DataFrame, key: str, text: str, k: int, n: int = 2, parts: DataFrame | None = None, where: Column | None = None, by_root: bool = False, every: bool = False) -> DataFrame:
    """query, doc, part, score of scores(), where only the k best of each query and part have to be among them.

    ``where`` is over the columns of index.texts and restricts the hits, not the
    statistics. With ``by_root`` scores are over the root of the document's length.
    """
    if index.texts is None and where is not None:
        raise ValueError("a saved index has no columns to restrict hits by")
    if index.texts is not None and n <= scan.LONGEST:
        asked = query_terms(queries, key, text, n)
        wanted = asked.select("term", scan.code(F.col("term"), n).alias("code")).distinct()
        codes = wanted.select("code").limit(SENT + 1).toArrow()
        if codes.num_rows <= SENT:
            sent = queries.sparkSession.sparkContext.broadcast(np.sort(codes.column(0).to_numpy()))
            found = stored(scan.statistics(index.texts, n, sent), "bm25-statistics")
            sizes = _sizes(found)
            weights = with_idf(found.join(wanted, "code").select("part", "term", "df"), sizes)
            kept = informative(asked, weights, every)
            if parts is not None:
                kept = kept.join(parts, ["query", "part"], "left_semi")
            kept = kept.join(sizes, "part").select("query", "part", scan.code(F.col("term"), n).alias("code"), "weight", F.greatest("avgdl", F.lit(1.0)).alias("avgdl")).limit(SENT + 1).toArrow()
            if kept.num_rows <= SENT:
                ids = kept.column("query").combine_chunks().unique()
                texts = index.texts if where is None else index.texts.where(where)
                return _scanned(texts, kept, ids, queries.schema[key].dataType.simpleString(), n, k, by_root=by_root)
    if index.slabs is not None:
        asked = query_terms(queries, key, text, n)
        kept = informative(asked, index.idf(asked), every)
        if parts is not None:
            kept = kept.join(parts, ["query", "part"], "left_semi")
        kept = kept.join(index.sizes, "part").select("query", "part", F.col("term").alias("code"), "weight", F.greatest("avgdl", F.lit(1.0)).alias("avgdl")).limit(SENT + 1).toArrow()
        if kept.num_rows <= SENT:
            ids, spark = kept.column("query").combine_chunks().unique(), queries.sparkSession
            wanted = spark.createDataFrame(kept.select(["part", "code"]).rename_columns(["part", "term"]).group_by(["part", "term"]).aggregate([]), f"part {index.sizes.schema['part'].dataType.simpleString()}, term string")
            found = index.slabs.join(F.broadcast(wanted), ["part", "term"])
            return scan.best_of_slabs(found, spark.sparkContext.broadcast(_asked(kept, ids)), ids, queries.schema[key].dataType.simpleString(), k, K1, B, by_root)
    scored = scores(index, queries, key, text, n, parts, every)
    if where is not None:
        scored = scored.join(index.texts.where(where).select("doc", "part"), ["doc", "part"], "left_semi")
    if by_root:
        scored = scored.join(index.docs.select("doc", "part", "dl"), ["doc", "part"]).withColumn("score", F.round(F.col("score") / F.sqrt(F.greatest("dl", F.lit(1))), 9)).drop("dl")
    return scored


def _sizes(found: DataFrame) -> DataFrame:
    return found.where("code is null").select("part", F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))


def _scanned(texts: DataFrame, kept: pa.Table, ids: pa.Array, kind: str, n: int, k: int, every: bool = False, by_root: bool = False) -> DataFrame:
    """scan.best of weights (query, part, code, weight, avgdl)."""
    return scan.best(texts, texts.sparkSession.sparkContext.broadcast(_asked(kept, ids)), ids, kind, n, k, K1, B, every, by_root)


def _asked(kept: pa.Table, ids: pa.Array) -> dict:
    """Weights (query, part, code, weight, avgdl) by part; queries are places in ``ids``."""
    place = pc.index_in(kept.column("query"), ids).to_numpy()
    code, weight, avgdl = (kept.column(c).to_numpy() for c in ("code", "weight", "avgdl"))
    part, asked = kept.column("part").combine_chunks(), {}
    for value in part.unique():
        at = np.flatnonzero(pc.equal(part, value).to_numpy(zero_copy_only=False))
        at = at[np.argsort(place[at], kind="stable")]
        codes, gram = np.unique(code[at], return_inverse=True)
        asked[value.as_py()] = scan.Asked(codes, gram, place[at], weight[at], float(avgdl[at[0]]))
    return asked


def okapi_top(index: Index, queries: DataFrame, key: str, text: str, k: int, n: int = 2, epsilon: float = 0.25) -> DataFrame:
    """query, doc, part, score, rank: the k best of okapi_scores(), ties by document.

    Documents without shared terms have 0. Only queries with fewer than k positive
    scores need some, and theirs are among the first documents by id: k, and as
    many as such a query has scores.
    """
    if index.texts is not None and n <= scan.LONGEST:
        ids = queries.select(F.col(key).alias("query")).distinct().limit(SENT + 1).toArrow().column(0).combine_chunks()
        found = stored(scan.statistics(index.texts, n), "bm25-statistics")
        sizes = _sizes(found)
        weights = _floored(found.where("code is not null").join(sizes, "part"), "code", epsilon)
        asked = query_terms(queries, key, text, n).withColumn("code", scan.code(F.col("term"), n))
        kept = asked.join(weights, "code").join(sizes, "part").select("query", "part", "code", (F.col("idf") * F.col("qtf")).alias("weight"), "avgdl").limit(SENT + 1).toArrow()
        if max(len(ids), kept.num_rows) <= SENT and kept.num_rows:
            return top(_scanned(index.texts, kept, ids, queries.schema[key].dataType.simpleString(), n, k, every=True), k)
    found = _okapi_found(index, queries, key, text, n, epsilon)
    asked = queries.select(F.col(key).alias("query")).distinct()
    counts = found.groupBy("query").agg(F.count("*").alias("f"), F.count_if(F.col("score") > 0).alias("pos"))
    short = asked.join(counts, "query", "left").where(F.coalesce("pos", F.lit(0)) < k).select("query", F.coalesce("f", F.lit(0)).alias("f"))
    most = short.agg(F.max("f")).first()[0]
    if most is None:
        return top(found, k)
    first = index.docs.select("doc", "part").orderBy("doc", "part").limit(int(most) + k)
    pairs = short.select("query", F.lit(0).alias("__o")).join(first.withColumn("__o", F.lit(0)), "__o").drop("__o")
    zeros = pairs.join(found.select("query", "doc", "part"), ["query", "doc", "part"], "left_anti").withColumn("score", F.lit(0.0))
    return top(found.unionByName(zeros), k)


def _okapi_found(index: Index, queries: DataFrame, key: str, text: str, n: int, epsilon: float) -> DataFrame:
    """query, doc, part, score of the documents that share a term."""
    asked = query_terms(queries, key, text, n)
    df = index.terms.groupBy("part", "term").agg(F.count("*").alias("df")).join(index.sizes, "part")
    weights = _floored(df, "term", epsilon)
    hits = index.terms.join(asked.join(weights, "term").join(index.sizes.select("part", "avgdl"), "part"), ["part", "term"])
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    gain = F.col("idf") * F.col("qtf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("query", "doc", "part").agg(F.round(F.sum(gain), 9).alias("score"))


def _floored(df: DataFrame, term: str, epsilon: float) -> DataFrame:
    """part, term, idf; negative ones are a share of the mean."""
    raw = df.select("part", term, (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.groupBy("part").agg(F.avg("idf").alias("mean"))
    return raw.join(mean, "part").select("part", term, F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def top(scored: DataFrame, k: int, by: list[str] = ("query",)) -> DataFrame:
    """The k best of each query with their rank; ties by document."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


