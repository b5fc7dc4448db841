"""Stages of a retrieval that are written in turn, with their counts, times and ranks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievework.sources.files import fresh_path


class Stages:
    """Writes the ranked list (query, doc, rank, score, ...) of each stage once, and observes it in the same job.

    A later stage reads what an earlier one wrote, so no stage is computed twice and
    its time is its own. Lists are tables in the shared folder of the session, by stage.
    """

    def __init__(self, spark, name: str = "stages"):
        self.spark = spark
        self.root = fresh_path(spark, name)
        self.seen: list[tuple[str, int, int | None, float | None, float | None, float]] = []

    def keep(self, stage: str, ranked: DataFrame) -> DataFrame:
        """ranked, written and read back."""
        if any(stage == s for s, *_ in self.seen):
            raise ValueError(f"stage {stage} was kept before")
        path, told, start = f"{self.root}/stage={stage}", Observation(), time.perf_counter()
        figures = [F.count(F.lit(1)).alias("rows"), F.max("rank").alias("deepest"), F.min("score").alias("least"), F.max("score").alias("most")]
        ranked.observe(told, *figures).write.parquet(path)
        got = told.get
        self.seen.append((stage, got["rows"], got["deepest"], got["least"], got["most"], round((time.perf_counter() - start) * 1000, 2)))
        return self.spark.read.schema(ranked.schema).parquet(path)

    def report(self) -> DataFrame:
        """stage, place, rows, deepest rank, least and most score, ms of each stage, in the order they ran."""
        rows = [(s[0], i, *s[1:]) for i, s in enumerate(self.seen)]
        return self.spark.createDataFrame(rows, "stage string, place int, rows long, deepest int, least double, most double, ms double")

    def ranks(self) -> DataFrame:
        """stage, query, doc, rank, score of every stage."""
        every = None
        for stage, *_ in self.seen:
            part = self.spark.read.parquet(f"{self.root}/stage={stage}").select(F.lit(stage).alias("stage"), "query", "doc", "rank", "score")
            every = part if every is None else every.unionByName(part)
        if every is None:
            raise ValueError("no stage was kept")
        return every
