"""Audits of data sets and of generated answers, in as few passes as their groups allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.redaction import leakage_hits, redaction_counts
from sievework.sources.files import stored

from .quality import violations
from .stats import duplicate_count, floor_percentiles


def _total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)


def external(df: DataFrame, text: str, labels: Column, fine_status: Column, year: Column, privacy=rules.ZH_PRIVACY, leakage=rules.ZH_SENTENCE_LEAKAGE, boundary: str | None = rules.ZH_BOUNDARY, groups: list[str] = ()) -> dict[str, DataFrame]:
    """Counters, year and fine histograms, duplicates and length percentiles of an external data set, or of each of its groups."""
    t = F.col(text)
    row = df.select(*groups, F.length(t).alias("n"), F.size(labels).alias("labels"), _total(redaction_counts(t, privacy)).alias("private"), _total(leakage_hits(t, leakage, boundary)).alias("leaks"), (F.coalesce(F.trim(t), F.lit("")) == "").alias("empty"))
    counters = row.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.count_if("empty").alias("empty_texts"),
        F.count_if(F.col("labels") > 1).alias("multi_label"),
        F.count_if(F.col("labels") <= 0).alias("unlabelled"),
        F.sum("private").alias("private_hits"),
        F.count_if(F.col("private") > 0).alias("private_rows"),
        F.sum("leaks").alias("leakage_hits"),
        F.count_if(F.col("leaks") > 0).alias("leaking_rows"),
    )
    return {
        "counters": counters,
        "years": df.groupBy(*groups, year.alias("year")).agg(F.count("*").alias("n")),
        "fines": df.groupBy(*groups, fine_status.alias("status")).agg(F.count("*").alias("n")),
        "duplicates": duplicate_count(df, F.sha2(t, 256), list(groups)),
        "lengths": floor_percentiles(row, list(groups), "n", [0.5, 0.9, 0.95, 0.99]),
    }


def external_report(df: DataFrame, text: str, year: str, fine_status: str, fine: str, groups: list[str] = (), privacy=rules.ZH_PRIVACY, leakage=rules.ZH_SENTENCE_LEAKAGE, boundary: str | None = rules.ZH_BOUNDARY) -> DataFrame:
    """groups, section, key, value: counters, years, states of fines, and floor percentiles of lengths and of positive fines.

    Rows without a text count as such and are left out of all else. Texts are read
    once, into a narrow table of the shared folder that all sections read. Numbers
    of 0 duplicates and percentiles of nothing have no row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(*groups, F.length(t).alias("n"), F.sha2(t, 256).alias("fp"), _total(redaction_counts(t, privacy)).alias("private"), _total(leakage_hits(t, leakage, boundary)).alias("leaks"), F.col(year).cast("string").alias("year"), F.col(fine_status).alias("status"), F.col(fine).cast("long").alias("fine"))
    rows = stored(narrow, "audit")
    told = rows.where("n > 0")
    parts = {"rows": F.count("*"), "empty_texts": F.count_if(F.col("n") == 0), "private_hits": F.sum("private"), "private_rows": F.count_if(F.col("private") > 0), "leakage_hits": F.sum("leaks"), "leaking_rows": F.count_if(F.col("leaks") > 0)}
    counted = rows.groupBy(*groups).agg(*[c.cast("double").alias(k) for k, c in parts.items()]).unpivot(list(groups), list(parts), "key", "value")
    copies = duplicate_count(told, F.col("fp"), list(groups)).where("duplicates > 0").select(*groups, F.lit("duplicates").alias("key"), F.col("duplicates").cast("double").alias("value"))
    points = [0.5, 0.9, 0.99, 1.0]

    def counts(column: str) -> DataFrame:
        return told.groupBy(*groups, F.coalesce(column, F.lit("missing")).alias("key")).agg(F.count("*").cast("double").alias("value"))

    def percentiles(of: DataFrame, value: str) -> DataFrame:
        key = F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int"))
        return floor_percentiles(of, list(groups), value, points).select(*groups, key.alias("key"), F.col("value").cast("double").alias("value"))

    sections = {"counters": counted.unionByName(copies), "years": counts("year"), "fines": counts("status"), "lengths": percentiles(told, "n"), "positive_fines": percentiles(told.where("fine > 0"), "fine")}
    every = None
    for name, part in sections.items():
        part = part.select(*groups, F.lit(name).alias("section"), "key", "value")
        every = part if every is None else every.unionByName(part)
    return every


def amounts(df: DataFrame, amount: str, limit: int = 100_000_000) -> DataFrame:
    """Missing, negative and outlying amounts."""
    a = F.col(amount)
    return df.agg(F.count("*").alias("rows"), F.count_if(a.isNull()).alias("missing"), F.count_if(a < 0).alias("invalid"), F.count_if(a >= limit).alias("outliers"), F.max(a).alias("largest"))


def error_histogram(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """error, n: rows that break each rule."""
    return df.select(F.explode(violations(checks)).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def unknown_labels(df: DataFrame, ids: str, known: int) -> DataFrame:
    """Rows with label ids outside of 0 .. known - 1, and rows that claim a review without one."""
    bad = F.exists(ids, lambda x: (x < 0) | (x >= known))
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("invalid_label_rows"))


def generation(df: DataFrame, parsed: Column, valid: Column, grounded: Column, groups: list[str] = ()) -> DataFrame:
    """Shares of outputs that are JSON, keep the schema, and cite only what was retrieved."""
    share = {"json_rate": parsed, "schema_rate": parsed & valid, "grounded_rate": parsed & valid & grounded}
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(k) for k, c in share.items()])


def threshold_gate(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Adds failed (names of metrics below their least or above their most value; missing ones fail) and passed."""
    failed = [(k, ~F.coalesce(F.col(k) >= v, F.lit(False))) for k, v in least.items()] + [(k, ~F.coalesce(F.col(k) <= v, F.lit(False))) for k, v in most.items()]
    return metrics.withColumn("failed", violations(failed)).withColumn("passed", F.size("failed") == 0)
