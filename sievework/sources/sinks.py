"""Writers, manifests and digests. Versions of a folder are in publish.py, search indexes in operators/saved.py."""

from __future__ import annotations

import json
import os
import platform
import shutil
import subprocess
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys; null fields are kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, **counters) -> str:
    """A JSON manifest of a written folder: its files' digests by their paths below the folder, and given counters."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    rows = file_digests(spark, path).orderBy("path").collect()
    return json.dumps({"files": {unquote(urlsplit(r["path"]).path).split(root, 1)[-1]: r["sha256"] for r in rows}, **counters}, sort_keys=True, ensure_ascii=False)


def environment(spark: SparkSession) -> dict:
    """Versions and settings that a run depends on."""
    sc = spark.sparkContext
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": sc.master, "default_parallelism": sc.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


def revision(root: str = ".") -> str:
    """The commit of a checkout, else what its ``.source-commit`` file says, else ``unversioned``."""
    if os.path.exists(os.path.join(root, ".git")) and shutil.which("git"):
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    marker = os.path.join(root, ".source-commit")
    if not os.path.exists(marker):
        return "unversioned"
    with open(marker, encoding="utf-8") as f:
        return f.read().strip()


def run_manifest(spark: SparkSession, path: str, root: str = ".", **values) -> str:
    """Writes and returns a JSON manifest of a run: status, revision, environment and given values.

    The folder must be new: a manifest is not replaced.
    """
    text = json.dumps({"status": "created", "source_revision": revision(root), "environment": environment(spark), **values}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return text
