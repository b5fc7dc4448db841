from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def one(spark):
    """Evaluates a column expression over one row of values."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_kind(v)}" for k, v in values.items())) if values else spark.range(1)
        return df.select(expression.alias("x") if hasattr(expression, "alias") else F.expr(expression).alias("x")).first()["x"]

    return run


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "double"
    if isinstance(value, list):
        return f"array<{_kind(value[0]) if value else 'string'}>"
    return "string"
