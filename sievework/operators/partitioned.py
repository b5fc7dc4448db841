"""Search in one index for each label, with quotas and structured reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bm25


def quotas(predicted: DataFrame, k: int) -> DataFrame:
    """query, part, probability, quota of predicted labels (query, label, probability): how many of k places each gets.

    Whole shares first, one place at least for a positive probability. Places
    that are left go to the largest remainders. Places too many are taken from
    labels that have several, by what each would still lack, and then from the
    least likely ones. The more likely label, then its name, breaks ties; a query
    without a positive probability gives all places to its first label.
    """
    each = Window.partitionBy("query")
    p = F.col("probability")
    total = F.sum(F.greatest(p, F.lit(0.0))).over(each)
    ranked = predicted.withColumn("__i", F.row_number().over(each.orderBy(F.desc("probability"), "label"))).withColumn("__t", total)
    share = F.when(F.col("__t") > 0, k * p / F.col("__t")).otherwise(F.when(F.col("__i") == 1, float(k)).otherwise(0.0))
    whole = ranked.withColumn("__s", share).withColumn("__n", F.greatest(F.col("__s").cast("int"), (p > 0).cast("int")))
    rest = F.col("__s") - F.col("__n")
    open_places = k - F.sum("__n").over(each)
    dealt = whole.withColumn("__o", open_places).withColumn("__r", F.row_number().over(each.orderBy(rest.desc(), "__i")))
    # every place beyond a label's first is a row; at most k of them for a query
    spare = dealt.where("__o < 0 and __n > 1").select("query", "label", "__i", "__o", F.posexplode(F.sequence(F.lit(2), F.col("__n"))).alias("__u", "__place"), rest.alias("__rest"))
    first = F.row_number().over(each.orderBy(F.col("__rest") + F.col("__u"), "__i"))
    taken = spare.withColumn("__k", first).where("__k <= -__o").groupBy("query", "label").agg(F.count("*").cast("int").alias("__less"))
    met = dealt.join(taken, ["query", "label"], "left").withColumn("__less", F.coalesce("__less", F.lit(0)))
    still = F.greatest(-F.col("__o") - F.sum("__less").over(each), F.lit(0))
    least = F.row_number().over(each.orderBy((F.col("__n") == 0), "probability", "__i"))
    out = met.withColumn("__still", still).withColumn("__l", least)
    more = F.when((F.col("__o") > 0) & (F.col("__r") <= F.col("__o")), 1).otherwise(0)
    quota = F.when(F.col("__l") <= F.col("__still"), 0).otherwise(F.col("__n") - F.col("__less") + more)
    return out.select("query", F.col("label").alias("part"), quota.cast("int").alias("quota"), "probability").where("quota > 0")


def distinct_texts(docs: DataFrame, key: str, text: str, labels: str) -> DataFrame:
    """One row a normalised text, with the labels of all its copies."""
    clean = docs.withColumn("__f", F.regexp_replace(text, r"(?U)[\W_]+", "")).where("__f <> ''")
    merged = clean.groupBy(F.sha2("__f", 256).alias("__f")).agg(F.min_by(text, key).alias(text), F.min(key).alias(key), F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels))
    return merged.select(key, text, labels)


def rescored(hits: DataFrame, min_score: float = 0.45) -> DataFrame:
    """Adds score of hits with bm25, probability, structured (0 to 1) and cardinality_match (0 or 1), by query and part."""
    best = F.max("bm25").over(Window.partitionBy("query", "part"))
    likely = F.max("probability").over(Window.partitionBy("query"))
    relative = F.greatest(F.lit(0.0), F.col("bm25") / F.when(best == 0, 1.0).otherwise(best))
    charge = F.col("probability") / F.when(likely == 0, 1.0).otherwise(likely)
    score = 0.55 * relative + 0.25 * charge + 0.15 * F.col("structured") + 0.05 * F.col("cardinality_match")
    return hits.withColumn("score", F.round(F.least(F.lit(1.0), score), 9)).where(F.col("score") >= min_score)


def selected(hits: DataFrame, k: int = 3) -> DataFrame:
    """Each document under its best part, at most its quota of each part and k of each query."""
    one = F.row_number().over(Window.partitionBy("query", "doc").orderBy(F.desc("score"), "part"))
    quota = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("score"), "doc"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    single = hits.withColumn("__n", one).where("__n = 1").withColumn("__n", quota).where("__n <= quota")
    return single.withColumn("rank", rank).where(F.col("rank") <= k).drop("__n")


def search(index: bm25.Index, queries: DataFrame, key: str, text: str, given: DataFrame, k: int, multiplier: int = 20) -> DataFrame:
    """query, part, doc, bm25, probability, quota: candidates of each part that has a quota."""
    most = max((given.agg(F.max("quota")).first()[0] or 0) * multiplier, k)
    scored = bm25.best(index, queries, key, text, most, parts=given.select("query", "part"))
    ranked = scored.join(given, ["query", "part"])
    order = Window.partitionBy("query", "part").orderBy(F.desc("score"), "doc")
    return ranked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= F.greatest(F.col("quota") * multiplier, F.lit(k))).select("query", "part", "doc", F.col("score").alias("bm25"), "probability", "quota")
