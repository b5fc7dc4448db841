"""Corpus statistics and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_percentiles(df: DataFrame, groups: list[str], value: str, points: list[float]) -> DataFrame:
    """groups, p, value: the element at floor((n - 1) p) of the sorted values, missing ones left out.

    Equal values are counted first, so a group's distinct values, not its rows,
    are sorted by one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*groups)
    upto = counts.withColumn("__upto", F.sum("__n").over(by.orderBy("__v"))).withColumn("__total", F.sum("__n").over(by))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")
    spread = upto.select("*", wanted).withColumn("__at", F.floor((F.col("__total") - 1) * F.col("p")))
    hit = spread.where((F.col("__upto") - F.col("__n") <= F.col("__at")) & (F.col("__at") < F.col("__upto")))
    return hit.select(*groups, "p", F.col("__v").alias("value"))


def floor_percentile(values: Column, p: float) -> Column:
    """The same of an array column."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(p)).cast("int"))


def exceedance(df: DataFrame, value: str, thresholds: list[int], groups: list[str] = ()) -> DataFrame:
    """Rows over each threshold and their fraction."""
    counted = df.groupBy(*groups).agg(F.count(value).alias("rows"), *[F.count_if(F.col(value) > t).alias(f"over_{t}") for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"over_{t}").alias("over")) for t in thresholds])).alias("x")
    return counted.select(*groups, "rows", rows).select(*groups, "rows", "x.threshold", "x.over", (F.col("x.over") / F.col("rows")).alias("fraction"))


def label_support(df: DataFrame, labels: str) -> DataFrame:
    """Rows that have each label, counted once a row."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("support"))


def label_ids(support: DataFrame) -> DataFrame:
    """Dense ids from 0 in label order; a dimension table, whose size is the number of labels."""
    return support.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))


def frequency_band_edges(support: DataFrame) -> DataFrame:
    """Quartile cut points of the sorted supports: index max(0, floor(n q) - 1)."""
    ordered = F.sort_array(F.collect_list("support"))
    rows = support.agg(ordered.alias("s"))
    points = F.explode(F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("q")
    at = F.greatest(F.lit(0), F.floor(F.size("s") * F.col("q")) - 1).cast("int")
    return rows.select("s", points).select("q", F.get("s", at).alias("cut"))


def modal_value(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """The most frequent combination of values in each group (ties: the smallest as text) and whether there are several."""
    counts = df.groupBy(*groups, *values).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("None")) for v in values]))
    kinds = F.count("*").over(Window.partitionBy(*groups))
    ranked = counts.withColumn("__k", F.row_number().over(order)).withColumn("conflict", kinds > 1)
    return ranked.where("__k = 1").select(*groups, *values, "n", "conflict")


def merge_duplicates(df: DataFrame, key: str, order: str, text: str, labels: str) -> DataFrame:
    """One row a key: the first row's text, all labels, the rows merged, and whether their labels differed."""
    return df.groupBy(key).agg(
        F.min_by(text, order).alias(text),
        F.min(order).alias(order),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels),
        F.count("*").alias("merged"),
        (F.count_distinct(labels) > 1).alias("label_conflict"),
    )


def duplicate_count(df: DataFrame, fingerprint: Column, groups: list[str] = ()) -> DataFrame:
    """Rows, distinct fingerprints, and rows beyond the first of each."""
    per = df.withColumn("__f", fingerprint).groupBy(*groups, "__f").agg(F.count("*").alias("n"))
    return per.groupBy(*groups).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_texts"), (F.sum("n") - F.count("*")).alias("duplicates"), F.max("n").alias("largest_group"))


def subset_report(df: DataFrame, key: str, labels: str, universe: list[str], size: int = 65536) -> DataFrame:
    """How a subset supports a label set, with a digest of its ids.

    The ids (integers) of each range of ``size`` have a digest in their order, and
    the digest of the whole is that of these, in the order of the ranges.
    """
    everything = F.array(*[F.lit(x) for x in universe])
    listed = lambda x, order: F.array_join(F.transform(F.array_sort(F.collect_list(order)), x), ",")
    ranges = df.groupBy(F.floor(F.col(key) / size).alias("r")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.size(labels) > 1).alias("several"),
        F.array_distinct(F.flatten(F.collect_set(labels))).alias("present"),
        F.sha2(listed(lambda x: x.cast("string"), key), 256).alias("d"),
    )
    present = F.array_distinct(F.flatten(F.collect_set("present")))
    return ranges.agg(
        F.sum("rows").alias("rows"),
        F.sum("several").alias("multi_label_rows"),
        F.size(F.array_intersect(everything, present)).alias("labels_present"),
        F.array_sort(F.array_except(everything, present)).alias("labels_missing"),
        F.sha2(listed(lambda x: x["d"], F.struct("r", "d")), 256).alias("ids_sha256"),
    )


def schema_variants(json_texts: DataFrame, column: str) -> DataFrame:
    """Distinct sorted key sets of JSON objects, and rows that are none."""
    keys = F.array_join(F.array_sort(F.json_object_keys(column)), ",")
    return json_texts.select(F.coalesce(keys, F.lit("<invalid>")).alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))


def padding(df: DataFrame, length: str, batch: int, multiple: int = 8, cap: int = 2048) -> DataFrame:
    """Share of padding if rows in order of length form batches padded to a multiple of their longest row.

    A batch's longest row is its last one, so the counts of lengths tell all:
    between a length's first and last place lie as many ends of batches as whole
    batches end there. Only the last batch may have fewer rows. Rows without
    length don't count.
    """
    counts = df.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("n")).agg(F.count("*").alias("c"))
    order = Window.orderBy("n")
    ends = counts.withColumn("after", F.sum("c").over(order)).withColumn("whole", F.floor(F.col("after") / batch) - F.floor((F.col("after") - F.col("c")) / batch))
    kept = F.least(F.col("n"), F.lit(cap))
    width = F.least(F.ceil(kept / multiple) * multiple, F.lit(cap))
    total = ends.agg(F.sum("c").alias("rows"), F.sum(F.col("c") * kept).alias("used"), F.sum(F.col("whole") * batch * width).alias("whole"), F.max(width).alias("widest"))
    padded = F.col("whole") + F.col("rows") % batch * F.col("widest")
    return total.select(F.ceil(F.coalesce("rows", F.lit(0)) / batch).alias("batches"), "used", padded.alias("padded")).withColumn("padding_ratio", 1 - F.col("used") / F.col("padded"))
