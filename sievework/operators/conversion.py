"""Conversion of case records into cleaned, masked and group-identified ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.redaction import drop_leaking_sentences, leakage_total, redact, redaction_total
from sievework.functions.text import duplicate_text
from sievework.sources.files import stored

SPLITS = ["train", "validation", "test"]


def _id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 20))


def sentence(death: Column, life: Column, months: Column) -> Column:
    """STRUCT<sentence_type, months, conflict>: death and life at once are unknown; months are of fixed terms and exemptions only."""
    d, l = F.coalesce(death, F.lit(False)), F.coalesce(life, F.lit(False))
    kind = F.when(d & l, "unknown").when(d, "death").when(l, "life").when(months > 0, "fixed_term").when(months == 0, "exempt").otherwise("unknown")
    return F.struct(kind.alias("sentence_type"), F.when(kind.isin("fixed_term", "exempt"), months).alias("months"), (d & l).alias("conflict"))


def fine(amount: Column) -> Column:
    """STRUCT<status, amount> of a number: zero, positive, or else missing."""
    status = F.when(amount == 0, "zero").when(amount > 0, "positive").otherwise("missing")
    return F.struct(status.alias("status"), F.when(status != "missing", amount).alias("amount"))


def converted(cases: DataFrame, source: str, schema_version: str, privacy=rules.ZH_PRIVACY, leakage=rules.ZH_SENTENCE_LEAKAGE, boundary: str | None = rules.ZH_BOUNDARY, ends: str = rules.ZH_SENTENCE_ENDS, article: str = "刑法第{}条", composed: bool = True) -> DataFrame:
    """All cases with their cleaned fields, and ``excluded``: why a case doesn't count, else null.

    cases: case_id, split, fact, accusations, relevant_articles, months, fine, death,
    life. A case goes if its fact is empty once leaking sentences are dropped, if any
    leak is left, or if its text belongs to an earlier split. ``composed`` asks for
    Unicode NFKC.
    """
    clean = drop_leaking_sentences(F.col("fact"), leakage, boundary, ends)
    first = cases.withColumns({"__clean": clean, "__dropped": leakage_total(F.col("fact"), leakage, boundary), "__s": sentence(F.col("death"), F.col("life"), F.col("months")), "__f": fine(F.col("fine"))})
    masked = first.withColumns({"__fact": redact(F.col("__clean"), privacy), "__private": redaction_total(F.col("__clean"), privacy)})
    left = masked.withColumns({"__left": leakage_total(F.col("__fact"), leakage, boundary), "__norm": F.sha2(duplicate_text(F.col("__fact"), composed), 256)})
    why = F.when(F.coalesce("__clean", F.lit("")) == "", "empty_after_leakage_clean").when(F.col("__left") > 0, "residual_leakage_rows_excluded")
    order = reduce(lambda w, s: w.when(F.col("split") == s[1], s[0]), enumerate(SPLITS), F.when(F.lit(False), -1)).otherwise(len(SPLITS))
    # written once, because it is read twice
    judged = stored(left.withColumns({"excluded": why, "__order": order}).drop("fact", "__clean"), "cases")
    earliest = judged.where("excluded is null").groupBy("__norm").agg(F.min("__order").alias("__first"))
    met = judged.join(earliest, "__norm", "left").withColumn("excluded", F.when(F.col("excluded").isNull() & (F.col("__order") > F.col("__first")), "cross_split_duplicates_excluded").otherwise(F.col("excluded")))
    kind, status = F.col("__s.sentence_type"), F.col("__f.status")
    ok = F.coalesce("__left", F.lit(0)) == 0
    labels = F.coalesce("accusations", F.array().cast("array<string>"))
    masks = {
        "sentencing_train": (kind != "unknown") & ok,
        "fine_binary": status.isin("zero", "positive") & ok,
        "fine_amount": (status == "positive") & ok,
        "accusation_train": (F.size(labels) > 0) & ok,
        "retrieval_corpus": ok,
        "retrieval_eval": F.lit(False),
        "robustness_eval": F.lit(False),
    }
    flags = {
        "date_available": F.lit(False),
        "fine_available": status.isin("zero", "positive"),
        "sentence_type_reliable": ~kind.isin("fixed_term", "unknown"),
        "target_leakage_detected": ~ok,
    }
    raw_id = F.col("case_id").cast("string")
    return met.select(
        _id("V3-", F.concat(F.lit(f"{source}:"), raw_id)).alias("case_id"),
        F.lit(source).alias("source"),
        raw_id.alias("source_case_id"),
        F.lit(schema_version).alias("source_schema_version"),
        F.col("split").alias("original_split"),
        F.lit("missing").alias("date_quality"),
        F.col("__fact").alias("fact"),
        labels.alias("accusations"),
        F.transform(F.coalesce("relevant_articles", F.array().cast("array<int>")), lambda x: F.format_string(article.replace("{}", "%s"), x.cast("string"))).alias("relevant_articles"),
        kind.alias("sentence_type"),
        F.col("__s.months").alias("imprisonment_months"),
        F.col("__f").alias("fine"),
        (F.coalesce("death", F.lit(False)) & ~F.col("__s.conflict")).alias("death_penalty"),
        (F.coalesce("life", F.lit(False)) & ~F.col("__s.conflict")).alias("life_imprisonment"),
        F.when(F.col("__s.conflict"), "invalid_conflicting_special_penalty").otherwise("legacy_structured").alias("label_quality"),
        F.when(status == "missing", "missing").otherwise("legacy_structured").alias("fine_quality"),
        F.when(kind == "fixed_term", "coarse_legacy").otherwise("reliable_special").alias("sentence_type_quality"),
        F.when(F.col("__private") > 0, "redacted").otherwise("clear").alias("privacy_status"),
        F.when(~ok, "blocked").when(F.col("__dropped") > 0, "cleaned").otherwise("clean").alias("leakage_status"),
        F.concat(F.lit("DG-"), F.substring("__norm", 1, 20)).alias("duplicate_group_id"),
        _id("CASE-", raw_id).alias("source_case_group_id"),
        F.struct(*[c.alias(n) for n, c in masks.items()]).alias("task_masks"),
        F.struct(*[c.alias(n) for n, c in flags.items()]).alias("data_quality"),
        "excluded",
        F.coalesce("__private", F.lit(0)).alias("privacy_hits"),
        F.coalesce("__dropped", F.lit(0)).alias("leakage_hits"),
    )


def kept(cases: DataFrame) -> DataFrame:
    """The cases that count, without the working columns."""
    return cases.where("excluded is null").drop("excluded", "privacy_hits", "leakage_hits")


def conversion_report(cases: DataFrame, groups: list[str] = ("original_split",)) -> DataFrame:
    """Counters of converted cases by split: kept, excluded by reason, conflicts, hits, tasks and fines."""
    is_kept = F.col("excluded").isNull()
    reasons = ["empty_after_leakage_clean", "residual_leakage_rows_excluded", "cross_split_duplicates_excluded"]
    return cases.groupBy(*groups).agg(
        F.count_if(is_kept).alias("rows"),
        *[F.count_if(F.col("excluded") == r).alias(r) for r in reasons],
        F.count_if(F.col("label_quality") != "legacy_structured").alias("conflicting_death_and_life"),
        F.coalesce(F.sum("privacy_hits"), F.lit(0)).alias("privacy_hits"),
        F.coalesce(F.sum("leakage_hits"), F.lit(0)).alias("leakage_rules_removed"),
        *[F.count_if(is_kept & F.col(f"task_masks.{t}")).alias(f"task_{t}") for t in ("sentencing_train", "fine_binary", "fine_amount", "accusation_train")],
        *[F.count_if(is_kept & (F.col("fine.status") == s)).alias(f"fine_{s}") for s in ("zero", "positive", "missing")],
    )
