"""Structured features of case texts and their similarity."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .money import parse_rmb
from .redaction import tags


def reduced_query(text: Column, generic: str = rules.ZH_GENERIC_TERMS) -> Column:
    """The query without generic terms, or as it was if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, generic, "")), F.lit("")), F.trim(text))


def amount(text: Column, pattern: str = rules.ZH_AMOUNT) -> Column:
    return parse_rmb(F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))["amount"]


def year(text: Column, pattern: str = rules.ZH_YEAR) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0.5 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.5).otherwise(F.size(F.array_intersect(a, b)) / union)


def closeness(a: Column, b: Column, scale: float = 1.0) -> Column:
    """exp(-|a - b| / scale); 0.5 if one is missing."""
    return F.coalesce(F.exp(-F.abs(a - b) / F.lit(scale)), F.lit(0.5))


def letter_profile(text: Column) -> Column:
    """How often each letter from a to z is in a text, in either case: a vector for which no model is needed."""
    low = F.lower(text)
    size = F.length(low)
    return F.array(*[(size - F.length(F.replace(low, F.lit(c)))).cast("double") for c in ascii_lowercase])


def structured_similarity(q_factors: Column, d_factors: Column, q_amount: Column, d_amount: Column, q_year: Column, d_year: Column) -> Column:
    return 0.45 * jaccard(q_factors, d_factors) + 0.45 * closeness(F.log1p(q_amount), F.log1p(d_amount)) + 0.10 * closeness(q_year, d_year, 5.0)


def evidence_similarity(q_factors: Column, d_factors: Column, q_amount: Column, d_amount: Column) -> Column:
    """The variant of sentencing evidence, without years."""
    return 0.6 * closeness(F.log1p(q_amount), F.log1p(d_amount)) + 0.4 * jaccard(q_factors, d_factors)


def frequency_band(least_support: Column) -> Column:
    return F.when(least_support.isNull(), "unknown").when(least_support <= 72, "extreme_tail").when(least_support <= 1891, "tail").otherwise("head")


def query_tags(labels: Column, least_support: Column, text: Column, pack=rules.ZH_DIMENSIONS, long_text: int = 1120) -> Column:
    more = F.array_compact(F.array(frequency_band(least_support), F.when(F.size(labels) > 1, "multi_label"), F.when(F.length(text) >= long_text, "long_text")))
    return F.array_sort(F.array_union(more, tags(text, pack)))


def negative_type(q: Column, d: Column, shared_label: Column) -> Column:
    """How a negative differs from its query: the first rule that holds of their dimensions (arrays of names)."""

    def differs(name: str) -> Column:
        return F.array_contains(q, name) != F.array_contains(d, name)

    return (
        F.when(shared_label & (F.size(F.array_intersect(q, d)) == 0), "same_charge_different_behavior")
        .when(differs("intentional"), "different_intent")
        .when(differs("negligent"), "intentional_vs_negligent")
        .when(differs("attempted"), "completed_vs_attempted")
        .when(differs("joint_crime"), "joint_vs_individual")
        .when(differs("injury_result"), "different_result")
        .when(F.array_contains(q, "amount") & F.array_contains(d, "amount"), "different_amount_band")
        .otherwise("similar_fact_different_charge")
    )


def summary(text: Column, limit: int = 120) -> Column:
    """A short text without personal names."""
    from .redaction import redact
    from .text import truncated

    plain = F.regexp_replace(redact(text, rules.ZH_PRIVACY), r"\[NAME_REDACTED\]", "某")
    return truncated(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), limit)
