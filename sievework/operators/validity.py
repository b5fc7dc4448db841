"""Which sources may be cited, and when they apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules

from .quality import violations


def iso_date(value: Column) -> Column:
    """A date written YYYY-MM-DD; null for null, an error for anything else."""
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull()
    return F.when(value.isNull(), F.lit(None).cast("date")).when(ok, value.try_cast("date")).otherwise(F.raise_error(F.concat(F.lit("not YYYY-MM-DD: "), value)).cast("date"))


def authoritative(url: Column, suffixes: list[str] = rules.AUTHORITATIVE_SUFFIXES) -> Column:
    """https and a host that is, or is below, one of the suffixes."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    ends = [(host == s) | host.endswith("." + s) for s in suffixes]
    any_ = ends[0]
    for e in ends[1:]:
        any_ = any_ | e
    return F.coalesce(any_, F.lit(False))


def reasons(kind: Column, url: Column, source_status: Column, legal_status: Column, effective: Column, expiry: Column, as_of: Column, suffixes=rules.AUTHORITATIVE_SUFFIXES, verified=rules.VERIFIED_STATUSES, in_force=rules.EFFECTIVE_STATUSES) -> Column:
    """Why a statute must not be presented as applicable law on a date; an empty array if it may.

    The day of effect is in force, the day of expiry no more.
    """
    dated = as_of.isNotNull()
    return violations(
        [
            ("not_statute_evidence", ~F.coalesce(kind == "statute", F.lit(False))),
            ("non_authoritative_source_url", ~authoritative(url, suffixes)),
            ("source_not_human_verified", ~F.coalesce(source_status.isin(verified), F.lit(False))),
            ("legal_status_not_effective", ~F.coalesce(legal_status.isin(in_force), F.lit(False))),
            ("missing_as_of_date", ~dated),
            ("missing_effective_date", dated & effective.isNull()),
            ("not_yet_effective", dated & (as_of < effective)),
            ("expired", dated & (as_of >= expiry)),
        ]
    )


def accepted(hits: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    return hits.where(F.size(column) == 0), hits.where(F.size(column) > 0)


def in_force(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, days: int = 1) -> DataFrame:
    """Points joined with the intervals of their key that hold them: start <= point < end; without end an interval is open.

    Intervals are cut into buckets, so the join is on (key, bucket) and a hot key
    is spread over its buckets. A bucket is as long as the mean interval, ``days``
    at least, so an interval is cut into two on average.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    last = points.agg(F.max(seconds(F.col(at)))).first()[0] or 0
    ends = F.coalesce(seconds(F.col(end)), F.greatest(F.lit(last), seconds(F.col(start))))
    mean = intervals.agg(F.avg(ends - seconds(F.col(start)))).first()[0] or 0
    unit = int(max(86400 * days, mean))
    bucket = lambda c: F.floor(c / unit)
    cut = F.sequence(bucket(seconds(F.col(start))), F.greatest(bucket(ends), bucket(seconds(F.col(start)))))
    i = intervals.where(F.col(start).isNotNull()).withColumn("__b", F.explode(cut))
    p = points.withColumn("__b", bucket(seconds(F.col(at))))
    return p.join(i, [key, "__b"]).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("__b")
