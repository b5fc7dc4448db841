"""Injected models: encoders, rerankers and generators called by batch, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A stand-in encoder: hashed character trigrams, length 1."""
    v = np.zeros(dim)
    for i in range(max(1, len(text) - 2)):
        h = int.from_bytes(hashlib.md5(text[i : i + 3].encode()).digest()[:8], "little")
        v[h % dim] += 1 if h >> 63 else -1
    return (v / max(float(np.linalg.norm(v)), 1e-7)).tolist()


def checked(vectors: list[list[float]], expected: int, dim: int | None) -> list[list[float]]:
    """An encoder's answer, if it has one finite vector other than 0 of the right size for each text."""
    if len(vectors) != expected:
        raise ValueError(f"{expected} texts, {len(vectors)} vectors")
    for v in vectors:
        if dim and len(v) != dim or not all(map(math.isfinite, v)) or not any(v):
            raise ValueError("a vector of wrong size, not finite or 0")
    return vectors


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 10, dim: int | None = None) -> DataFrame:
    """key, embedding; ``encode`` gets at most ``batch`` texts at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = frame[text].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                out += checked(encode(part) if encode else [hashed_vector(t) for t in part], len(part), dim)
            yield pd.DataFrame({key: frame[key], "embedding": out})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """hits (query, doc, score, sources) with new scores; the old one stays in sources as ``rrf``."""
    met = hits.join(queries.select("query", F.col("text").alias("q")), "query").join(docs.select("doc", F.col("text").alias("d")), "doc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = score(list(zip(frame["q"], frame["d"])))
            if len(got) != len(frame):
                raise ValueError("a score for each pair is needed")
            yield frame.drop(columns=["q", "d"]).assign(new=got)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.drop("q", "d").schema.fields)
    scored = met.mapInPandas(run, f"{fields}, new double")
    sources = F.map_concat("sources", F.create_map(F.lit("rrf"), F.col("score"), F.lit("reranker"), F.col("new")))
    return scored.withColumn("sources", sources).withColumn("score", F.col("new")).drop("new")


def repair_prompt(prompt: str, error: str) -> str:
    """The prompt again, with what was wrong with the answer to it."""
    return f"{prompt}\nThe last answer was not valid: {error}. Answer again, in full."


def generate(df: DataFrame, key: str, prompt: str, generator: Callable[[str], str], check: Callable[[str], str | bool | None], fallback: Callable[[str], str], repairs: int = 1, repair: Callable[[str, str], str] = repair_prompt) -> DataFrame:
    """key, output, attempts, error: repairs that name the fault, then the deterministic fallback.

    ``check`` gives null or true for a valid answer, else the fault. A generator
    that fails is not asked again; ``error`` then is generation_provider_unavailable,
    and generation_validation_failed where no answer was valid.
    """

    def one(text: str) -> tuple[str, int, str | None]:
        asked = text
        for attempt in range(1, repairs + 2):
            try:
                out = generator(asked)
            except Exception:  # whatever a provider raises
                return fallback(text), attempt, "generation_provider_unavailable"
            fault = check(out)
            if fault is None or fault is True:
                return out, attempt, None
            asked = repair(text, str(fault or "not valid"))
        return fallback(text), repairs + 1, "generation_validation_failed"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [one(t) for t in frame[prompt]]
            yield pd.DataFrame({key: frame[key], **{n: [g[i] for g in got] for i, n in enumerate(("output", "attempts", "error"))}})

    return df.select(key, prompt).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, output string, attempts int, error string")


def predicted_labels(scored: DataFrame, key: str, thresholds: DataFrame, k: int = 5, default: float = 0.5) -> DataFrame:
    """key, label, probability, used_fallback: labels over their threshold, k at most; the k likeliest if none is."""
    from pyspark.sql import Window

    met = scored.join(thresholds, "label", "left").withColumn("over", F.col("probability") >= F.coalesce("threshold", F.lit(default)))
    any_over = F.max("over").over(Window.partitionBy(key))
    kept = met.withColumn("used_fallback", ~any_over).where("over or used_fallback")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("probability"), "label"))
    return kept.withColumn("k", place).where(F.col("k") <= k).select(key, "label", "probability", "used_fallback")
