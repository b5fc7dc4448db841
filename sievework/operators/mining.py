"""Silver judgments and hard negatives from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.features import negative_type


def silver_judgments(hits: DataFrame, shared: Column, same_dimension: Column, positives: int = 3, negatives: int = 3) -> DataFrame:
    """The best ranked positives (a shared label) and negatives of each query, as relevance 2, 1 or 0."""
    marked = hits.withColumn("positive", shared).withColumn("relevance", F.when(shared & same_dimension, 2).when(shared, 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("query", "positive").orderBy("rank"))
    return marked.withColumn("__n", place).where((F.col("positive") & (F.col("__n") <= positives)) | (~F.col("positive") & (F.col("__n") <= negatives))).drop("__n")


def hard_negatives(hits: DataFrame, shared: Column, q_dims: Column, d_dims: Column, limit: int = 3) -> DataFrame:
    """query, positive_id, negative_id, negative_type, score: the best hit with a shared label, and contrasting ones."""
    marked = hits.withColumn("shared", shared).withColumn("negative_type", negative_type(q_dims, d_dims, shared))
    positive = marked.where("shared").groupBy("query").agg(F.min_by("doc", "rank").alias("positive_id"))
    rest = marked.join(positive, "query").where(F.col("doc") != F.col("positive_id")).where(~F.col("shared") | (F.col("negative_type") == "same_charge_different_behavior"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rest.withColumn("__n", place).where(F.col("__n") <= limit).select("query", "positive_id", F.col("doc").alias("negative_id"), "negative_type", "score")


def triplets(mined: DataFrame, queries: DataFrame, chunks: DataFrame, case: str, text: str, order: str) -> DataFrame:
    """Texts of mined triples: the query's, and the first chunk of the positive and the negative case."""
    first = chunks.groupBy(case).agg(F.min_by(text, order).alias("t"))
    out = mined.join(queries.select(F.col("query"), F.col(text).alias("query_text")), "query")
    for side in ("positive", "negative"):
        out = out.join(first.select(F.col(case).alias(f"{side}_id"), F.col("t").alias(f"{side}_text")), f"{side}_id")
    return out


def dangling(qrels: DataFrame, queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Judgments whose query or case is unknown, and which of them."""
    q = queries.select("query_id").distinct().withColumn("q", F.lit(True))
    c = cases.select("case_id").distinct().withColumn("c", F.lit(True))
    met = qrels.join(q, "query_id", "left").join(c, "case_id", "left")
    return met.where("q is null or c is null").select("query_id", "case_id", F.col("q").isNull().alias("query_missing"), F.col("c").isNull().alias("case_missing"))
