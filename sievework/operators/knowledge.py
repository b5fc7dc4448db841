"""An incremental knowledge base of cases and their chunks.

A build compares the cases' content hashes with those of the published version and
chunks only cases that are new or changed. Their chunks are a segment of their
own; the table of documents tells for each case its hash and the segment that
holds its chunks, so chunks of changed and removed cases are simply not referred
to any more. A build that changes nothing writes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import chunking
from sievework.sources.publish import Publication


def _cases(cases: DataFrame, key: str, text: str) -> DataFrame:
    """case_id, fact, content_sha256; of several rows of an id the one with the least hash, rows without id are left out."""
    fact = F.coalesce(F.col(text), F.lit(""))
    rows = cases.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("case_id"), fact.alias("fact"), F.sha2(fact, 256).alias("content_sha256"))
    return rows.groupBy("case_id").agg(F.min(F.struct("content_sha256", "fact")).alias("r")).select("case_id", "r.fact", "r.content_sha256")


def _part(p: Publication, version: str, name: str) -> DataFrame:
    return p.spark.read.parquet(f"{p.root}/data/{version}/{name}")


def build(cases: DataFrame, root: str, key: str = "case_id", text: str = "fact", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, ends: str = chunking.ENDS, full: bool = False) -> dict:
    """Brings the knowledge base at ``root`` up to these cases and returns its commit; other chunk settings, or ``full``, chunk all anew."""
    p = Publication(cases.sparkSession, root)
    settings = {"size": size, "overlap": overlap, "ends": ends}
    history = p.history()
    last = history[-1] if history and history[-1].get("settings") == settings and not full else None
    now = _cases(cases, key, text)
    known = _part(p, last["version"], "documents") if last else None
    changed = now if known is None else now.join(known.select("case_id", "content_sha256"), ["case_id", "content_sha256"], "left_anti")
    staged = p.stage()
    version = staged.rsplit("/", 1)[-1]
    if known is not None:
        gone = known.join(now.select("case_id"), "case_id", "left_anti").count()
        if not gone and changed.isEmpty():
            return last
        kept = known.join(now.select("case_id", "content_sha256"), ["case_id", "content_sha256"], "left_semi")
    chunking.chunks(changed, "case_id", "fact", size, overlap, ends).write.parquet(f"{staged}/chunks")
    fresh = changed.select("case_id", "content_sha256", F.lit(version).alias("segment"))
    (fresh if known is None else kept.unionByName(fresh)).write.parquet(f"{staged}/documents")
    documents = p.spark.read.parquet(f"{staged}/documents")
    by_segment = {r["segment"]: r["n"] for r in documents.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    totals = documents.agg(F.count("*").alias("cases"), F.sum(F.conv(F.substring("content_sha256", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("content_sum")).first().asDict()
    return p.commit(staged, expected=history[-1]["number"] if history else 0, kind="knowledge", settings=settings, segments=sorted(by_segment), changed=by_segment.get(version, 0), removed=gone if known is not None else 0, **totals)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """case_id, content_sha256, segment of the current version; a wrong number of them is an error."""
    p = Publication(spark, root)
    commit = p.current()
    found = _part(p, commit["version"], "documents")
    if (n := found.count()) != commit["cases"]:
        raise ValueError(f"{root} has {n} cases instead of {commit['cases']}")
    return found


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the current version's cases."""
    p = Publication(spark, root)
    live = documents(spark, root).select("case_id", "segment")
    segments = p.current()["segments"]
    if not segments:
        return p.spark.read.parquet(f"{p.folder()}/chunks").limit(0)
    parts = [_part(p, s, "chunks").withColumn("segment", F.lit(s)) for s in segments]
    return reduce(DataFrame.unionByName, parts).join(live, ["case_id", "segment"], "left_semi").drop("segment")
