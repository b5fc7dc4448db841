"""Queries of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import money, rules
from sievework.operators import metrics
from sievework.session import read_table

from .registry import query

_ROWS_SQL = "p as (select l.doc_id, list_filter([case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) as g, list_filter([case when length(text) > 600 then 'good' end, case when length(text) > 3000 then 'toxic' end, case when length(text) > 5000 then 'long' end], lambda x: x is not null) as p from labels l join documents d using (doc_id))"
_COUNTS_SQL = f"{_ROWS_SQL}, c as (select label, count(*) filter (list_contains(g, label) and list_contains(p, label)) as tp, count(*) filter (not list_contains(g, label) and list_contains(p, label)) as fp, count(*) filter (list_contains(g, label) and not list_contains(p, label)) as fn, count(*) filter (list_contains(g, label)) as support from p, (values ('good'), ('toxic'), ('long')) v(label) group by label), r as (select label, tp, fp, fn, support, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c)"


def _predicted(spark, sf_dir):
    met = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents"), "doc_id")
    gold = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    n = F.length("text")
    guess = F.array_compact(F.array(F.when(n > 600, "good"), F.when(n > 3000, "toxic"), F.when(n > 5000, "long")))
    return met.select(gold.alias("g"), guess.alias("p"))


def _counts(spark, sf_dir):
    return metrics.label_counts(_predicted(spark, sf_dir), "g", "p", ["good", "toxic", "long"])


@query(f"""with {_COUNTS_SQL} select round(sum(tp) / (sum(tp) + sum(fp)), 6) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) as micro_recall, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6)::double as micro_f1, round(avg(precision), 6) as macro_precision,
round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(avg(f1) filter (support > 0), 6) as macro_f1_supported, round((sum(fp) + sum(fn)) / (3 * (select count(*) from p)), 6) as hamming from r""")
def multilabel_prf(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return metrics.multilabel(counts, _predicted(spark, sf_dir).count())


@query(f"with {_COUNTS_SQL} select label, support, precision, recall, f1::double as f1, case when support = 0 then '0' when support <= 5 then '1-5' when support <= 20 then '6-20' else '21+' end as band from r")
def support_bands(spark, sf_dir):
    return metrics.label_report(_counts(spark, sf_dir))


@query("""
with s as (select source, quality = 1 as t, least(1.0, length(text) / 4000) as score from labels join documents using (doc_id)),
g as (select source, k / 100 as threshold, count(*) filter (score >= k / 100 and t) as tp, count(*) filter (score >= k / 100 and not t) as fp, count(*) filter (score < k / 100 and t) as fn, count(*) filter (t) as pos, count(*) filter (not t) as neg from s, (select unnest(range(10, 91, 5)) as k) group by source, k),
f as (select *, round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from g)
select source, threshold, round(f1, 6) as f1 from f qualify row_number() over (partition by source order by case when pos < 5 or neg < 5 then abs(threshold - 0.5) else -f1 end, threshold) = 1
""")
def threshold_tuning(spark, sf_dir):
    met = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents"), "doc_id")
    scored = met.select("source", (F.col("quality") == 1).alias("t"), F.least(F.lit(1.0), F.length("text") / 4000).alias("score"))
    return metrics.tuned_thresholds(scored, "source", "t", "score")


@query("select lang as gold, case when length(text) > 2500 then 'en' when length(text) > 1500 then 'fr' when length(text) > 700 then 'de' else 'es' end as predicted, count(*) as n from documents group by all")
def confusion_matrix(spark, sf_dir):
    n = F.length("text")
    guess = F.when(n > 2500, "en").when(n > 1500, "fr").when(n > 700, "de").otherwise("es")
    return metrics.confusion(read_table(spark, sf_dir, "documents").select(F.col("lang").alias("gold"), guess.alias("predicted")), "gold", "predicted")


_EDGES = ", ".join(str(e) for e in rules.FINE_EDGES)


def _bucket_sql(v):
    return f"case when len(list_filter([{_EDGES}], lambda e: e <= {v})) = 0 then {len(rules.FINE_EDGES) - 2} else least(len(list_filter([{_EDGES}], lambda e: e <= {v})) - 1, {len(rules.FINE_EDGES) - 2}) end"


@query(f"""
with l as (select l_returnflag, trunc(l_extendedprice)::bigint as v, trunc(l_extendedprice * (1 - l_discount))::bigint as p from lineitem), b as (select *, {_bucket_sql('v')} as vb, {_bucket_sql('p')} as pb from l)
select l_returnflag, count(*) as rows, round(avg(abs(v - p)), 6) as mae, round(median(abs(v - p)), 6) as median_ae, round(avg(case when vb = pb then 1 else 0 end), 6) as bucket_accuracy, min([{_EDGES}][vb + 1])::bigint as least_lower from b group by l_returnflag
""")
def bucket_metrics(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("long").alias("v"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("p"))
    edges = rules.FINE_EDGES
    b = l.withColumn("vb", money.bucket(F.col("v"), edges)).withColumn("pb", money.bucket(F.col("p"), edges))
    hits = b.groupBy("l_returnflag").agg(F.round(F.avg((F.col("vb") == F.col("pb")).cast("int")), 6).alias("bucket_accuracy"), F.min(money.bucket_range(F.col("vb"), edges)["lower"]).alias("least_lower"))
    return metrics.regression(l, "v", "p", ["l_returnflag"]).join(hits, "l_returnflag")


@query("select event_type, round(quantile_cont(value, 0.05), 6) as q5, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.95), 6) as q95 from events group by event_type")
def probability_quantiles(spark, sf_dir):
    return metrics.quantiles(read_table(spark, sf_dir, "events"), "value", [0.05, 0.5, 0.95], ["event_type"])


@query("""
with v as (select vec_id, list_transform(embedding[1:4], lambda x: round(1 / (1 + exp(-(greatest(-40.0::double, least(40.0::double, 20 * x::double))))), 9)) as p from embeddings),
o as (select vec_id, p, list_filter(range(4), lambda i: p[i + 1] >= 0.5) as over from v)
select len(over)::int as n_labels, count(*) as rows, sum(list_sum(case when len(over) > 0 then over else [list_position(p, list_max(p)) - 1] end))::bigint as label_sum from o group by 1
""")
def binarized_labels(spark, sf_dir):
    p = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(metrics.sigmoid(20 * x.cast("double")), 9))
    rows = read_table(spark, sf_dir, "embeddings").select(p.alias("p"))
    half = F.array(*[F.lit(0.5)] * 4)
    labels = rows.select(F.size(F.filter("p", lambda x: x >= 0.5)).alias("n_labels"), metrics.binarized(F.col("p"), half).alias("l"))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)
    return labels.groupBy("n_labels").agg(F.count("*").alias("rows"), F.sum(total).alias("label_sum"))


@query()
def tfidf_baseline(spark, sf_dir):
    """Accuracy of a majority guess and of a linear model on hashed character n-grams, on held-out documents."""
    from sievework.operators import baselines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return baselines.compare(docs)


@query()
def multilabel_baseline(spark, sf_dir):
    """Held-out micro-F1 of languages and quality marks: the most frequent label, and linear models over 60,000 n-grams."""
    from sievework.operators import baselines

    marks = read_table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("mark"))
    docs = read_table(spark, sf_dir, "documents").join(marks, "doc_id", "left").select("doc_id", "text", F.array("lang", "mark").alias("labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return baselines.multilabel(docs.where(~held_out), docs.where(held_out), "doc_id", "text", "labels")
