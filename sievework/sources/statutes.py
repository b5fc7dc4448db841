"""Articles of statute texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.money import chinese_integer

_NUMBER = "[一二三四五六七八九十百千零〇0-9]+"


def articles(texts: DataFrame, column: str, law: str = "PRC-CRIMINAL-LAW", order: Column | None = None, **provenance: str) -> DataFrame:
    """One row an article: number, ids, title and body; of several bodies of a number the longest, then the first.

    ``order``: a number by which texts come first; for a long text whose articles lie in rows.
    """
    parts = F.split(column, f"(?=第{_NUMBER}条)", -1)
    found = texts.select((F.lit(0) if order is None else order).alias("place"), F.posexplode(F.filter(parts, lambda p: p.rlike(f"^第{_NUMBER}条"))).alias("at", "part"))
    body = F.trim(F.regexp_replace(F.regexp_replace("part", f"^第{_NUMBER}条", ""), r"(?U)\s+", " "))
    rows = found.select("place", "at", chinese_integer(F.regexp_extract("part", f"^第({_NUMBER})条", 1), strict=False).alias("number"), body.alias("body")).where("body <> ''")
    best = rows.groupBy("number").agg(F.max_by("body", F.struct(F.length("body"), -F.col("place"), -F.col("at"))).alias("body"))
    number = F.col("number").cast("string")
    return best.select("number", F.concat(F.lit(f"{law}-"), number).alias("statute_id"), F.concat(F.lit(f"{law}#"), number).alias("clause_id"), F.concat(F.lit("第"), number, F.lit("条")).alias("title"), "body", *[F.lit(v).alias(k) for k, v in provenance.items()])
