"""Streaming forms of row-wise operators: an extension beyond the batch queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions.text import exact_fingerprint, normalize_text


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def deduplicated(stream: DataFrame, text: str, time: str, watermark: str = "1 day") -> DataFrame:
    """Rows whose normalised text was not seen within the watermark; state is bounded by it."""
    keyed = stream.withColumn("fingerprint", exact_fingerprint(normalize_text(F.col(text))))
    return keyed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "10 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, watermark).groupBy(window, *keys).agg(F.count("*").alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends transformed batches as Parquet; a batch that is written again replaces itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
