"""The shared folder in which operators cut lineage and keep files."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
        spark.sparkContext.setCheckpointDir(found)
    return re.sub(r"^file:/(?!/)", "file:///", found).rstrip("/")


def fresh_uri(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read back.

    Shuffle files that only served the writing are no longer needed then; Spark
    removes them once the driver has collected its garbage, so it is asked to.
    """
    spark = df.sparkSession
    uri = fresh_uri(spark, name)
    df.write.parquet(uri)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(uri)
    back.stored_uri = uri
    return back


def dropped(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for f in frames:
        path = jvm.org.apache.hadoop.fs.Path(f if isinstance(f, str) else f.stored_uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_fs(uri: str):
    """(file system, path) by which Python tasks reach a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
