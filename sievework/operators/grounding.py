"""Evidence packets, citations, grounded analyses and tuning records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.redaction import redact, redaction_counts
from sievework.functions.text import key_sentences, truncated

from .quality import violations


def request_id(as_of: Column, fact: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over the date, a NUL and the fact."""
    nul = F.decode(F.unhex(F.lit("00")), "utf-8")
    return F.substring(F.sha2(F.concat(F.coalesce(as_of, F.lit("")), nul, fact), 256), 1, 16)


def safe_evidence(kind: Column, text: Column, limit: int = 360, pack=rules.ZH_PRIVACY) -> Column:
    """STRUCT<text, redactions, presentation>: case texts redacted and shortened, statutes as they are."""
    plain = truncated(F.trim(F.regexp_replace(redact(text, pack), r"(?U)\s+", " ")), limit)
    case = kind == "case"
    return F.struct(
        F.when(case, plain).otherwise(text).alias("text"),
        F.when(case, redaction_counts(text, pack)).alias("redactions"),
        F.when(case, "deidentified_summary").otherwise("official_statute_text").alias("presentation"),
    )


def citation_check(cited: Column, known: Column) -> Column:
    """STRUCT<valid, unknown>: valid if something is cited and all of it is known."""
    unknown = F.array_sort(F.array_except(cited, known))
    return F.struct(((F.size(cited) > 0) & (F.size(unknown) == 0)).alias("valid"), unknown.alias("unknown"))


# Fixed value: marks of cited cases and chunks in a text.
CITATION = r"\[(case-[^\]]+|[^:\]]+:c\d+)\]"


def citation_report(text: Column, evidence: Column, pattern: str = CITATION) -> Column:
    """STRUCT<valid, cited, unknown, uncited>: the distinct citations that a text makes beside the ids of its evidence, all sorted.

    Valid if something is cited and all of it is evidence. A null text cites nothing.
    """
    known = F.array_distinct(F.coalesce(evidence, F.array().cast("array<string>")))
    cited = F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))))
    unknown = F.array_except(cited, known)
    valid = (F.size(cited) > 0) & (F.size(unknown) == 0)
    return F.struct(valid.alias("valid"), cited.alias("cited"), F.array_sort(unknown).alias("unknown"), F.array_sort(F.array_except(known, cited)).alias("uncited"))


def grounding_report(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per request: unknown evidence, evidence of a wrong kind, and statutes that must not be cited.

    claims: request, section (legal_basis, analogous_cases or others), evidence_id;
    catalog: request, evidence_id, kind, reasons (of operators.validity).
    """
    met = claims.join(catalog, ["request", "evidence_id"], "left")
    wrong = ((F.col("section") == "legal_basis") & (F.col("kind") != "statute")) | ((F.col("section") == "analogous_cases") & (F.col("kind") != "case"))
    invalid = (F.col("section") == "legal_basis") & (F.col("kind") == "statute") & (F.size("reasons") > 0)
    out = met.groupBy("request").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind").isNull(), F.col("evidence_id")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(wrong, F.col("evidence_id")))).alias("wrong_type"),
        F.array_sort(F.collect_set(F.when(invalid, F.col("evidence_id")))).alias("not_applicable"),
        F.max((F.col("section") == "legal_basis").cast("int")).alias("legal_basis"),
    )
    return out.select("request", "unknown", "wrong_type", "not_applicable", (F.col("legal_basis") == 0).alias("missing_legal_basis"), ((F.size("unknown") + F.size("wrong_type") + F.size("not_applicable") == 0) & (F.col("legal_basis") == 1)).alias("valid"))


def response_violations(cited: Column, retrieved: Column, articles: Column, statutes: Column, case_text: Column, passed: Column, as_of: Column, review: Column, needs_review: Column, pack=rules.ZH_PRIVACY) -> Column:
    """Cross-field rules of a response that it breaks."""
    leaks = F.aggregate(F.map_values(redaction_counts(F.coalesce(case_text, F.lit("")), pack)), F.lit(0), lambda a, x: a + x) > 0
    return violations(
        [
            ("citation_outside_retrieval", F.size(F.array_except(cited, retrieved)) > 0),
            ("article_outside_statutes", F.size(F.array_except(articles, statutes)) > 0),
            ("private_data_in_case_text", leaks),
            ("passed_without_date", passed & as_of.isNull()),
            ("passed_without_statutes", passed & (F.size(statutes) == 0)),
            ("hidden_review", needs_review & ~review),
        ]
    )


def grounded_analysis(fact: Column, labels: Column, articles: Column, cases: Column, ends: str = "。！？；") -> Column:
    """A cautious analysis from retrieval alone: key facts, what is missing, and a confidence."""
    missing = violations([("missing_statutes", F.size(articles) == 0), ("missing_similar_cases", F.size(cases) == 0)])
    sure = (F.size(missing) == 0) & (F.size(labels) > 0)
    return F.struct(
        labels.alias("predicted_labels"),
        F.array_sort(F.array_distinct(articles)).alias("articles"),
        key_sentences(fact, ends, 4).alias("key_facts"),
        missing.alias("missing_information"),
        F.slice(cases, 1, 5).alias("similar_cases"),
        F.when(sure, "medium").otherwise("low").alias("confidence"),
        F.lit(True).alias("requires_manual_review"),
    )


def tuning_record(case_id: Column, fact: Column, labels: Column, system: str, long_text: int = 1120, ends: str = "。！？；") -> Column:
    """A chat record with its target; several labels or long facts ask for review."""
    review = (F.size(labels) > 1) | (F.length(fact) >= long_text)
    target = F.struct(labels.alias("candidate_labels"), key_sentences(fact, ends, 3).alias("key_facts"), F.when(review, "medium").otherwise("high").alias("confidence"), review.alias("requires_manual_review"))
    messages = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit(system)), ("user", fact), ("assistant", F.to_json(target)))])
    return F.struct(F.concat(F.lit("sft-"), case_id.cast("string")).alias("record_id"), messages.alias("messages"), F.sha2(fact, 256).alias("fact_sha256"), review.alias("requires_manual_review"))


def failure_reasons(rows: DataFrame, reasons: str) -> DataFrame:
    """How many rows each reason fails, counted once a row."""
    return rows.select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def evidence_packet(facts: DataFrame, hits: DataFrame, as_of: Column, pack=rules.ZH_PRIVACY, limit: int = 360) -> DataFrame:
    """request, request_id, fact, as_of_date, predicted_labels, evidence: what an analysis may rely on.

    facts: request, fact, predicted_labels; hits: request, evidence_id, kind (case or
    statute), rank, text, labels, articles. Facts and case texts are redacted; cases
    come first, each kind by rank. A request without hits has no evidence.
    """
    shown = safe_evidence(F.col("kind"), F.col("text"), limit, pack)["text"]
    title = F.when(F.col("kind") == "case", F.col("evidence_id").cast("string")).otherwise(F.concat(F.lit("法条 "), F.col("evidence_id").cast("string")))
    order = F.when(F.col("kind") == "case", 0).otherwise(1)
    item = F.struct(order.alias("o"), "rank", F.col("evidence_id").cast("string").alias("evidence_id"), F.when(F.col("kind") == "statute", "statute").otherwise("case").alias("evidence_type"), title.alias("title"), shown.alias("summary"), "labels", "articles")
    items = hits.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("o", "rank")).alias("evidence"))
    safe = facts.withColumn("fact", redact(F.col("fact"), pack))
    none = F.array().cast(items.schema["evidence"].dataType)
    met = safe.join(items, "request", "left")
    return met.select("request", F.concat(F.lit("req-"), request_id(as_of, F.col("fact"))).alias("request_id"), "fact", as_of.alias("as_of_date"), "predicted_labels", F.coalesce("evidence", none).alias("evidence"))


def grounded_prompt(question: Column, evidence: Column, instruction: str, unknown: str = "unknown") -> Column:
    """Instruction, question and one block for each piece of evidence (evidence_id, labels, articles, summary) in its order."""

    def listed(values: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit("")), F.lit(unknown))

    blocks = F.transform(evidence, lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("]\nlabels: "), listed(e["labels"]), F.lit("\narticles: "), listed(e["articles"]), F.lit("\ntext: "), F.coalesce(e["summary"], F.lit(""))))
    return F.concat(F.lit(instruction + "\n\nQuestion:\n"), question, F.lit("\n\nEvidence:\n"), F.array_join(blocks, "\n\n"))
