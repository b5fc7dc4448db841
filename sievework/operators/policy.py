"""Selections that walk down a short ranked list: statutes of a case, diverse queries, labels to search with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The order in which tags take turns.
TAG_ORDER = ["extreme_tail", "tail", "head", "multi_label", "long_text", "amount", "injury_result", "joint_crime", "attempted", "intentional", "negligent"]


def narrowed_labels(predicted: DataFrame, k: int = 3) -> DataFrame:
    """All labels of a calibrated prediction, the k likeliest of a fallback (query, label, probability, used_fallback)."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("probability"), "label"))
    return predicted.withColumn("__k", place).where(~F.col("used_fallback") | (F.col("__k") <= max(1, k))).drop("__k")


def statutes(label_hits: DataFrame, fact_hits: DataFrame, k: int) -> DataFrame:
    """query, clause_id, article, place: for each label its first clause of an article that is not yet taken, then one for the fact.

    label_hits: query, label_rank, rank, clause_id, article, and fact_hits the
    same without label_rank; both accepted clauses only, a few for each query.
    """
    both = label_hits.select("query", "label_rank", "rank", "clause_id", "article").unionByName(fact_hits.select("query", F.lit(1 << 20).alias("label_rank"), "rank", "clause_id", "article"))
    best = F.row_number().over(Window.partitionBy("query", "label_rank").orderBy("rank", "clause_id"))
    short = both.withColumn("__n", best).where(F.col("__n") <= max(5, k)).drop("__n")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, own in frame.sort_values(["label_rank", "rank", "clause_id"]).groupby("label_rank", sort=True):
            new = own[~own["article"].isin(taken)]
            if len(new) and len(out) < k:
                row = new.iloc[0]
                taken.add(row["article"])
                out.append((row["query"], row["clause_id"], row["article"], len(out) + 1))
        return pd.DataFrame(out, columns=["query", "clause_id", "article", "place"])

    kind = {f.name: f.dataType.simpleString() for f in short.schema.fields}
    return short.groupBy("query").applyInPandas(choose, f"query {kind['query']}, clause_id {kind['clause_id']}, article {kind['article']}, place int")


def diverse_queries(rows: DataFrame, key: str, tags: str, size: int = 200, seed: int = 42, order: list[str] = TAG_ORDER) -> list:
    """Keys of ``size`` rows: tags take turns, each with its next row in a seeded order; then any rows.

    No tag can need more than ``size`` rows, so as many of each are gathered.
    """
    dealt = rows.select(F.col(key).alias("key"), F.col(tags).alias("tags"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    each = dealt.select("key", "h", F.explode("tags").alias("tag")).where(F.col("tag").isin(order))
    first = F.row_number().over(Window.partitionBy("tag").orderBy("h", "key"))
    heads = each.withColumn("n", first).where(F.col("n") <= size).orderBy("tag", "n").collect()
    waiting = {t: [r["key"] for r in heads if r["tag"] == t] for t in order}
    chosen: dict = {}
    while len(chosen) < size and any(waiting.values()):
        for t in order:
            while waiting[t] and waiting[t][0] in chosen:
                waiting[t].pop(0)
            if waiting[t] and len(chosen) < size:
                chosen[waiting[t].pop(0)] = t
    if len(chosen) < size:
        for r in dealt.orderBy("h", "key").limit(size + len(chosen)).collect():
            if len(chosen) < size:
                chosen.setdefault(r["key"], None)
    return list(chosen)
