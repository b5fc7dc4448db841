"""Ranking, multilabel, threshold and regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import floor_percentiles


def ranking(qrels: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """queries, recall, mrr, ndcg at k: graded gains 2**relevance - 1, averaged over all judged queries."""
    judged = qrels.join(run.where(F.col("rank") <= k).select("query", "doc", "rank"), ["query", "doc"], "left")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "doc"))
    rows = judged.withColumn("ideal", ideal)
    good = F.col("relevance") > 0
    per = rows.groupBy("query").agg(
        F.count_if(good).alias("relevant"),
        F.count_if(good & F.col("rank").isNotNull()).alias("found"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), gain / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0))), F.lit(0.0)).alias("idcg"),
    )
    return per.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), 6).alias("ndcg"),
    )


def proxy_ranking(relevant: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """The same with binary gains and relevance by a rule: relevant has (query, doc); adds the hit rate."""
    hits = run.where(F.col("rank") <= k).join(relevant.select("query", "doc", F.lit(1).alias("good")), ["query", "doc"], "left")
    return _proxy(relevant.groupBy("query").agg(F.count("*").alias("relevant")), hits, k)


def label_proxy_ranking(queries: DataFrame, docs: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """proxy_ranking() where the documents (doc, label) of a query's label (query, label) are relevant.

    Relevant documents are counted by label and only retrieved ones are looked up,
    so no pair of a query and a relevant document is made that was not retrieved.
    """
    top = run.where(F.col("rank") <= k).join(docs.select("doc", F.col("label").alias("__d")), "doc").join(queries.select("query", F.col("label").alias("__q")), "query")
    hits = top.withColumn("good", F.when(F.col("__d") == F.col("__q"), 1))
    sizes = docs.groupBy("label").agg(F.count("*").alias("relevant"))
    return _proxy(queries.join(sizes, "label").select("query", "relevant"), hits, k)


def _proxy(totals: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    per = hits.groupBy("query").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("found"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when(F.col("good") == 1, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"))
    rows = totals.join(per, "query").withColumn("idcg", ideal)
    return rows.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("found") / F.col("relevant")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"),
        F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("hit_rate"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def label_counts(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, tp, fp, fn, support of array columns; labels without rows have zeros."""
    every = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    flags = rows.select(every, F.col(gold).alias("g"), F.col(predicted).alias("p")).select("label", F.array_contains("g", F.col("label")).alias("g"), F.array_contains("p", F.col("label")).alias("p"))
    return flags.groupBy("label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"), F.count_if("g").alias("support"))


def label_report(counts: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    band = F.when(F.col("support") == 0, "0").when(F.col("support") <= 5, "1-5").when(F.col("support") <= 20, "6-20").otherwise("21+")
    f1 = _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), band.alias("band"))


def multilabel(counts: DataFrame, rows: int) -> DataFrame:
    """Micro and macro precision, recall and F1, macro F1 of supported labels, Hamming loss."""
    report = counts.join(label_report(counts).select("label", F.col("precision").alias("p"), F.col("recall").alias("r"), F.col("f1").alias("f")), "label")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return report.agg(
        F.round(_ratio(tp, tp + fp), 6).alias("micro_precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("micro_recall"),
        F.round(_ratio(2.0 * tp, 2 * tp + fp + fn), 6).alias("micro_f1"),
        F.round(F.avg("p"), 6).alias("macro_precision"),
        F.round(F.avg("r"), 6).alias("macro_recall"),
        F.round(F.avg("f"), 6).alias("macro_f1"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("f"))), 6).alias("macro_f1_supported"),
        F.round((fp + fn) / (F.count("*") * F.lit(rows)), 6).alias("hamming"),
    )


def tuned_thresholds(scored: DataFrame, label: str, truth: str, score: str, least: int = 5) -> DataFrame:
    """label, threshold, f1: the first best of 0.10, 0.15 .. 0.90; 0.5 for a label with few rows of either kind."""
    grid = F.explode(F.array(*[F.lit(k / 100) for k in range(10, 91, 5)])).alias("threshold")
    hit = F.col(score) >= F.col("threshold")
    rows = scored.select(label, F.col(truth).cast("boolean").alias("t"), score, grid)
    counts = rows.groupBy(label, "threshold").agg(F.count_if(hit & F.col("t")).alias("tp"), F.count_if(hit & ~F.col("t")).alias("fp"), F.count_if(~hit & F.col("t")).alias("fn"), F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    graded = counts.withColumn("f1", F.round(_ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9))
    few = (F.col("pos") < least) | (F.col("neg") < least)
    order = Window.partitionBy(label).orderBy(F.when(few, F.abs(F.col("threshold") - 0.5)).otherwise(-F.col("f1")), "threshold")
    return graded.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(label, "threshold", F.round("f1", 6).alias("f1"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def binarized(probabilities: Column, thresholds: Column) -> Column:
    """Positions at or over their threshold; the largest one's if there is none."""
    over = F.filter(F.sequence(F.lit(0), F.size(probabilities) - 1), lambda i: F.get(probabilities, i) >= F.get(thresholds, i))
    return F.when(F.size(over) > 0, over).otherwise(F.array(F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def regression(rows: DataFrame, truth: str, predicted: str, groups: list[str] = ()) -> DataFrame:
    error = F.abs(F.col(truth) - F.col(predicted))
    return rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*groups).agg(F.count("*").alias("rows"), F.round(F.avg(error), 6).alias("mae"), F.round(F.median(error), 6).alias("median_ae"))


def quantiles(df: DataFrame, value: str, points: list[float], groups: list[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles."""
    return df.groupBy(*groups).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(f"q{int(round(p * 100))}") for p in points])


def top_values(df: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The k most frequent values and their counts; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def extreme_rows(df: DataFrame, order: Column, tie: str, k: int, last: bool = False) -> DataFrame:
    """The k rows that are highest by an expression, or lowest; ties by a column."""
    return df.orderBy(order.asc() if last else order.desc(), tie).limit(k)


def regression_of_top(df: DataFrame, label: str, truth: str, predicted: str, k: int = 20) -> DataFrame:
    """regression() of the k most frequent labels; one without known numbers has 0 rows."""
    top = top_values(df, label, k).select(label, F.col("n").alias("label_rows"))
    graded = regression(df.join(F.broadcast(top), label, "left_semi"), truth, predicted, [label])
    return top.join(graded, label, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def binary_prf(rows: DataFrame, truth: Column, predicted: Column, groups: list[str] = ()) -> DataFrame:
    """Rows, precision, recall and F1 of a yes-or-no prediction; rows without a truth don't count."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~F.coalesce(predicted, F.lit(False)))
    return rows.where(truth.isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(2.0 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the same key side by side; fails on evaluation if a key has no partner, or is there twice."""
    marks = [d.withColumn(f"__{i}", F.lit(True)).withColumn("__n", F.lit(1)) for i, d in enumerate((left, right))]
    once = [d.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").limit(1).count() for d in (left, right)]
    if any(once):
        raise ValueError(f"a {key} is there twice")
    met = marks[0].drop("__n").join(marks[1].drop("__n"), key, "full")
    both = F.col("__0").isNotNull() & F.col("__1").isNotNull()
    return met.where(F.when(both, True).otherwise(F.raise_error(F.concat(F.lit(f"{key} without a partner: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).drop("__0", "__1")


def target_confusion(rows: DataFrame, gold: str, scores: str, targets: list[str], other: str = "other") -> tuple[DataFrame, DataFrame]:
    """(truth, predicted, n; the wrong rows) of rows with exactly one true label among the targets.

    ``gold`` is a list of labels and ``scores`` maps labels to probabilities. The
    prediction is the likeliest label of all, the first by name if several are; those outside the targets count as
    ``other``. Wrong rows come with both labels and their probabilities.
    """
    hit = F.array_intersect(gold, F.array(*[F.lit(t) for t in targets]))
    best = F.array_min(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label"))))
    single = rows.withColumn("__hit", hit).where(F.size("__hit") == 1).withColumns({"true_label": F.get("__hit", F.lit(0)), "__best": best}).drop("__hit")
    named = single.withColumns({"predicted_label": F.col("__best.label"), "predicted_probability": -F.col("__best.p"), "true_probability": F.element_at(F.col(scores), F.col("true_label"))}).drop("__best")
    matrix = named.groupBy("true_label", F.when(F.col("predicted_label").isin(targets), F.col("predicted_label")).otherwise(other).alias("predicted")).agg(F.count("*").alias("n"))
    return matrix, named.where("predicted_label <> true_label")


def review_queue(wrong: DataFrame, key: str, k: int = 200) -> DataFrame:
    """The k wrong rows that were predicted with most confidence; ties by key."""
    return extreme_rows(wrong, F.col("predicted_probability"), key, k)


def regression_checks(rows: DataFrame, category: str, expected: str, forbidden: str, predicted: str, ranked: str, abstain: str) -> DataFrame:
    """Rows, passes, pass rate, abstentions and expected labels in the top five by category of a regression set.

    A row passes if nothing is predicted where it must abstain, else if all expected
    labels are predicted, and no forbidden one is.
    """
    none = F.size(predicted) == 0
    right = F.when(F.col(abstain), none).otherwise(F.size(F.array_except(expected, predicted)) == 0)
    ok = right & ~F.arrays_overlap(predicted, forbidden)
    asks = F.size(expected) > 0
    found = asks & (F.size(F.array_except(F.col(expected), F.slice(ranked, 1, 5))) == 0)
    counts = rows.groupBy(category).agg(F.count("*").alias("rows"), F.count_if(ok).alias("passed"), F.count_if(none).alias("abstentions"), F.count_if(asks).alias("__asks"), F.count_if(found).alias("__found"))
    return counts.select(category, "rows", "passed", F.round(F.col("passed") / F.col("rows"), 6).alias("pass_rate"), "abstentions", F.round(F.col("__found") / F.greatest("__asks", F.lit(1)), 6).alias("expected_in_top5"))


def contract_metrics(rows: DataFrame, flags: dict[str, Column], cited: Column, known: Column, latency: str, groups: list[str] = ()) -> DataFrame:
    """The share of rows for each flag, citations outside the known ids, and latency (median, and the p95 at floor(0.95 (n - 1)))."""
    outside = F.size(F.filter(cited, lambda x: ~F.array_contains(known, x)))
    made = rows.select(*groups, F.col(latency).alias("__ms"), F.size(cited).alias("__cited"), outside.alias("__outside"), *[c.alias(n) for n, c in flags.items()])
    shares = made.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        *[F.round(F.avg(F.coalesce(F.col(n), F.lit(False)).cast("int")), 6).alias(n) for n in flags],
        F.sum("__cited").alias("citations"),
        F.sum("__outside").alias("unknown_citations"),
        F.round(F.sum("__outside") / F.nullif(F.sum("__cited"), F.lit(0)), 6).alias("unknown_citation_rate"),
    )
    spans = floor_percentiles(made, list(groups), "__ms", [0.5, 0.95]).groupBy(*groups).agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("latency_p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("latency_p95"))
    return shares.join(spans, list(groups)) if groups else shares.crossJoin(spans)  # one row each


def probability_audit(scored: DataFrame, key: str, truth: str, probability: str, threshold: float | Column) -> DataFrame:
    """Of long rows (key, label): rows, abstentions, and means and extremes of the likeliest, the true and the other labels."""
    over = (F.col(probability) >= threshold).cast("int")
    t, p = F.col(truth).cast("boolean"), F.col(probability)
    per = scored.groupBy(key).agg(F.max(p).alias("best"), F.sum(over).alias("n"), F.sum(F.when(t, p)).alias("ts"), F.count_if(t).alias("tn"), F.max(F.when(~t, p)).alias("wrong"))
    return per.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("n") == 0).alias("abstained_rows"),
        F.max("n").alias("most_labels"),
        F.round(F.avg("best"), 6).alias("mean_best"),
        F.round(F.min("best"), 6).alias("least_best"),
        F.round(F.sum("ts") / F.nullif(F.sum("tn"), F.lit(0)), 6).alias("mean_true"),
        F.round(F.max("wrong"), 6).alias("largest_wrong"),
    )
