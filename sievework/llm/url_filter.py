"""Rule lists for URLs: host-suffix and path-prefix expressions by hash prefix.

A URL expands into every (host suffix, path prefix) expression that a rule could
have: for each pair of a label count and a path length that some rule has, the
suffix of so many labels and the prefix of so many characters. Expressions are joined with the rules
on the first 32 bits of their SHA-256, then the full digests are compared, and
the longest rule wins; between an allow and a block rule of the same expression,
block does.

Nulls and edge cases: a null URL, or one without ``://``, has an empty host and
path and the default verdict; user names and ports are part of the host;
repeated rows each get their verdict; without rules every URL gets the default;
an empty table gives an empty result; of other columns only the key is kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, host/path) as a table with expression, digest and hash prefix."""
    rows = spark.createDataFrame(rules, "verdict string, rule string")
    return with_digests(rows)


def with_digests(rules: DataFrame) -> DataFrame:
    """Adds host, path, digest and prefix; of equal rules one stays, block first."""
    at = F.instr("rule", "/")
    split = rules.where("rule is not null and verdict is not null").select(
        "verdict", "rule", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("host"), F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("/")).alias("path")
    )
    one = split.groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return one.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The host suffixes and path prefixes of the given label counts and path lengths, joined to strings.

    The shapes are one constant that a lambda goes through, so the plan is the same
    for any number of them.
    """
    given = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>")
    fits = F.filter(given, lambda s: (F.size(F.split(host, r"\.")) >= s["n"]) & (F.length(path) >= s["m"]))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]), F.substring(path, F.lit(1), s["m"])))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """key, host, path, rule and verdict of every row.

    The rule table comes from with_digests(). Which pairs of label count and path
    length occur in it is collected (numbers, bounded by the labels of a host
    times the characters of a path); the table itself is joined as Catalyst sees
    fit, broadcast only while it is small.
    """
    met = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().collect()
    shapes = sorted((r["n"], r["m"]) for r in met)
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumn("start", F.substring("path", 1, max(m for _, m in shapes)))
    asked = rows.select("host", "start").distinct()
    exploded = asked.withColumn("expression", F.explode(expressions(F.col("host"), F.col("start"), shapes)))
    hashed = exploded.withColumn("asked", F.sha2("expression", 256)).withColumn("prefix", F.substring("asked", 1, 8))
    hits = hashed.join(rules.select("prefix", "digest", "rule", "verdict", F.length(F.concat("host", "path")).alias("size")), "prefix").where("asked = digest")
    best = hits.groupBy("host", "start").agg(F.max(F.struct("size", F.col("verdict"), F.col("rule"))).alias("best"))
    judged = rows.join(best, ["host", "start"], "left")
    return judged.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
