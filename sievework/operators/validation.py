"""Validation of training, retrieval and split data sets: counted errors, findings by row, and reports that can fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import SIMPLIFIED, faults
from .dedup import split_overlap
from .quality import violations


def _counted(rows: DataFrame, errors: Column) -> DataFrame:
    return rows.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def _number(df: DataFrame, n: Column, error: str) -> DataFrame:
    """One row with a number, if it is not 0."""
    return df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).where("n > 0").select(F.lit(error).alias("error"), "n")


def training_errors(rows: DataFrame, review: str = "unreviewed", insufficient: str = "deterministic_insufficient_information") -> DataFrame:
    """error, n of chat training rows; no rows if all is well.

    rows: split, case_id, sft_id, source_split, review_status, construction_type,
    target and answer (JSON texts). Of the faults of target, answer and their
    agreement a row has the first one; a row whose texts are sound is also held
    to the rules of its construction. An id that is null or empty counts each time, one that
    occurs n times in a split n - 1 times, a case in several splits once.
    """
    read = rows.withColumn("__t", F.try_parse_json("target")).withColumn("__a", F.try_parse_json("answer"))
    ok = {name: F.size(faults(F.col(text), F.col(value), SIMPLIFIED)) == 0 for name, text, value in (("t", "target", "__t"), ("a", "answer", "__a"))}
    fields = {f"__{name}_{f.name}": f.read(F.col(f"__{name}")) for name in ok for f in SIMPLIFIED}
    told = read.withColumns({"__t_ok": ok["t"], "__a_ok": ok["a"]}).withColumns(fields)
    both = F.col("__t_ok") & F.col("__a_ok")
    differs = F.lit(False)
    for f in SIMPLIFIED:
        differs = differs | ~F.col(f"__t_{f.name}").eqNullSafe(F.col(f"__a_{f.name}"))
    short = both & F.col("construction_type").eqNullSafe(insufficient)
    errors = violations(
        [
            ("source_split_mismatch", ~F.col("source_split").eqNullSafe(F.col("split"))),
            ("invalid_review_status", ~F.col("review_status").eqNullSafe(review)),
            ("target_schema_invalid", ~F.col("__t_ok")),
            ("assistant_json_invalid", F.col("__t_ok") & ~F.col("__a_ok")),
            ("assistant_target_mismatch", both & differs),
            ("insufficient_information_has_accusation", short & (F.size("__t_candidate_accusations") > 0)),
            ("insufficient_information_not_escalated", short & ((F.col("__t_confidence") != "low") | ~F.col("__t_requires_manual_review"))),
        ]
    )
    ids = rows.select("split", F.nullif("sft_id", F.lit("")).alias("id")).groupBy("split", "id").agg(F.count("*").alias("n"))
    repeated = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.col("n") - 1))
    cases = rows.select("split", "case_id").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    return _counted(told, errors).unionByName(_number(ids, repeated, "missing_or_duplicate_sft_id")).unionByName(_number(cases, F.count_if(F.col("n") > 1), "source_case_cross_split_overlap"))


def retrieval_errors(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, reviewed: DataFrame, review: str = "unreviewed", source: str = "silver_proxy") -> DataFrame:
    """error, n of a retrieval set; no rows if all is well.

    queries: query_id, source_split, review_status; candidates: candidate_id,
    source_split; qrels: query_id, candidate_id, judgment_source, review_status.
    Reviewed judgments must not exist before people have made them.
    """
    asked = _counted(queries, violations([("query_not_validation", ~F.col("source_split").eqNullSafe("validation")), ("query_review_status_invalid", ~F.col("review_status").eqNullSafe(review))]))
    offered = _counted(candidates, violations([("candidate_not_train", ~F.col("source_split").eqNullSafe("train"))]))
    met = qrels.join(queries.select("query_id").distinct().withColumn("__q", F.lit(True)), "query_id", "left").join(candidates.select("candidate_id").distinct().withColumn("__c", F.lit(True)), "candidate_id", "left")
    judged = _counted(
        met,
        violations(
            [
                ("dangling_qrel", F.col("__q").isNull() | F.col("__c").isNull()),
                ("qrel_claims_non_proxy_judgment", ~F.col("judgment_source").eqNullSafe(source)),
                ("qrel_review_status_invalid", ~F.col("review_status").eqNullSafe(review)),
            ]
        ),
    )
    early = _number(reviewed, F.count(F.lit(1)), "reviewed_qrels_must_be_empty_before_human_review")
    return asked.unionByName(offered).unionByName(judged).unionByName(early)


def dataset_report(rows: DataFrame, known: Column, split: str = "split", labels: str = "label_ids", status: str = "review_status", fact: str = "fact_sha256", group: str = "group_id", claimed: str = "manually_reviewed") -> DataFrame:
    """check, splits, n: rows of each split, rows with unknown label ids, rows that claim a review, and facts and groups that pairs of splits share.

    All but the sizes must be 0, which is_valid() tells; pairs that share nothing have no row.
    """
    each = rows.groupBy(F.col(split).alias("splits")).agg(F.count("*").alias("size"), F.count_if(F.size(F.array_except(labels, known)) > 0).alias("invalid_label_rows"), F.count_if(F.col(status) == claimed).alias("manually_reviewed_rows"))
    long = each.unpivot(["splits"], ["size", "invalid_label_rows", "manually_reviewed_rows"], "check", "n").select("check", "splits", "n")
    for key, name in ((fact, "shared_facts"), (group, "shared_groups")):
        pairs = split_overlap(rows.where(F.col(key).isNotNull()), split, key)
        long = long.unionByName(pairs.select(F.lit(name).alias("check"), F.concat_ws("|", "split_a", "split_b").alias("splits"), F.col("shared").alias("n")))
    return long


def is_valid(report: DataFrame) -> bool:
    """Whether a dataset_report() has nothing but sizes."""
    return report.where("check <> 'size' and n > 0").isEmpty()


def sentencing_findings(rows: DataFrame, amount: str, text: str, markers: str, outlier: int = 100_000_000) -> DataFrame:
    """rows, once for each finding: invalid_fine (null or negative), fine_outlier, residual_marker (the text still tells the sentence)."""
    fine = F.col(amount)
    found = violations([("invalid_fine", fine.isNull() | (fine < 0)), ("fine_outlier", fine >= outlier), ("residual_marker", F.coalesce(F.col(text).rlike(markers), F.lit(False)))])
    return rows.withColumn("finding", F.explode(found))
