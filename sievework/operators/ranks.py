"""Places of rows in an order, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task sorts, about.
ROWS = 10_000


def seeded_order(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def placed(df: DataFrame, group: list[str], order: str, tie: list[str], rows: int = ROWS) -> DataFrame:
    """df with ``place`` (from 0) of each row in its group and ``members``, the group's size.

    ``order`` is a column of evenly spread longs, such as a hash; its range is cut
    into as many slices as the group needs to have about ``rows`` in each. The
    slices' counts, summed up in order, tell where each begins, and rows are only
    sorted inside their slice. Equal values of ``order`` are in order of ``tie``.
    """
    groups = [F.col(c) for c in group]
    sizes = df.groupBy(*groups).agg(F.count("*").alias("members")).withColumn("__slices", F.ceil(F.col("members") / rows))
    cut = F.least(F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * F.col("__slices")), F.col("__slices") - 1)

    def same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        """a with b's other columns, where nulls are equal too."""
        right = b.select(*[F.col(n).alias(f"__r_{n}") for n in names], *[c for c in b.columns if c not in names])
        on = [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names] or [F.lit(True)]
        return a.join(right if names else F.broadcast(right), on).drop(*[f"__r_{n}" for n in names])

    sliced = same(df, sizes, group).withColumn("__slice", cut)
    counts = sliced.groupBy(*groups, "__slice").agg(F.count("*").alias("__n"))
    before = counts.select(*group, "__slice", (F.sum("__n").over(Window.partitionBy(*groups).orderBy("__slice")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__slice").orderBy(order, *tie))
    return same(sliced, before, [*group, "__slice"]).withColumn("place", F.col("__before") + inside - 1).drop("__slices", "__slice", "__before")
