"""Ordered quality filters, contracts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def violations(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def filter_with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that no rule rejects, rejected rows by their first reason)."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def fine_contract(status: Column, amount: Column) -> list[tuple[str, Column]]:
    """A positive fine has a positive amount, a zero fine 0, others none."""
    return [
        ("positive_fine_without_amount", (status == "positive") & (F.coalesce(amount, F.lit(0)) <= 0)),
        ("zero_fine_with_amount", (status == "zero") & (F.coalesce(amount, F.lit(-1)) != 0)),
        ("amount_without_fine", ~status.isin("positive", "zero") & amount.isNotNull()),
    ]


def term_contract(kind: Column, months: Column) -> list[tuple[str, Column]]:
    return [
        ("months_with_death_or_life", kind.isin("death", "life") & months.isNotNull()),
        ("negative_months", months < 0),
    ]


def probation_contract(imposed: Column, months: Column) -> list[tuple[str, Column]]:
    return [
        ("probation_months_without_probation", (~F.coalesce(imposed, F.lit(False))) & months.isNotNull()),
        ("probation_without_months", F.coalesce(imposed, F.lit(False)) & (F.coalesce(months, F.lit(0)) <= 0)),
    ]


def gate(checks: Column, names: list[str]) -> Column:
    """STRUCT<passed, failed>: a check that is missing from the map has failed."""
    failed = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.coalesce(F.element_at(checks, n), F.lit(False)))
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def firewall(checks: list[tuple[str, Column]]) -> Column:
    """STRUCT<passed, blocking_reasons, requires_manual_review> of named conditions."""
    blocking = violations([(name, ~F.coalesce(ok, F.lit(False))) for name, ok in checks])
    return F.struct((F.size(blocking) == 0).alias("passed"), blocking.alias("blocking_reasons"), (F.size(blocking) > 0).alias("requires_manual_review"))


def apply_overrides(cases: DataFrame, overrides: DataFrame, key: str = "case_id", labels: str = "accusations") -> DataFrame:
    """Replaces the labels of cases that have an approved override and the labels it expects.

    An override whose original labels differ from the case's raises an error.
    """
    approved = overrides.where("status = 'approved'").select(key, F.array_sort("original_accusations").alias("__old"), F.array_sort("corrected_accusations").alias("__new"))
    met = cases.join(approved, key, "left")
    agree = F.col("__old").isNull() | (F.array_sort(labels) == F.col("__old"))
    checked = F.when(agree, F.coalesce("__new", labels)).otherwise(F.raise_error(F.concat(F.lit("override of other labels: "), F.col(key).cast("string"))))
    return met.withColumn(labels, checked).drop("__old", "__new")


def override_audit(cases: DataFrame, overrides: DataFrame, key: str = "case_id") -> DataFrame:
    """Overrides by status, and how many of them have no case."""
    known = cases.select(key, F.lit(1).alias("__known")).distinct()
    return overrides.join(known, key, "left").groupBy("status").agg(F.count("*").alias("overrides"), F.count_if(F.col("__known").isNull()).alias("missing_cases"))
