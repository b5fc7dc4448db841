"""Queries of conversions, label mappings, packets and diagnostic metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.text import selected_sentences
from sievework.operators import conversion, grounding, metrics
from sievework.session import read_table, spread
from sievework.sources import labels

from .registry import query

_LEAK = "|".join(p for _, p in rules.LEAKAGE)
_ENDS = rules.SENTENCE_ENDS


def _masked(value: str) -> str:
    for name, pattern in rules.PRIVACY:
        value = f"regexp_replace({value}, '{pattern}', '[{name.upper()}_REDACTED]', 'g')"
    return value


def _hits(value: str, pack) -> str:
    return " + ".join(f"len(regexp_extract_all({value}, '{p}'))" for _, p in pack)


def _private(value: str) -> str:
    parts = []
    for name, pattern in rules.PRIVACY:
        parts.append(f"len(regexp_extract_all({value}, '{pattern}'))")
        value = f"regexp_replace({value}, '{pattern}', '[{name.upper()}_REDACTED]', 'g')"
    return " + ".join(parts)


_CASES_SQL = rf"""
c as (select doc_id, ['train', 'validation', 'test'][doc_id % 3 + 1] as split, doc_id % 3 as o, text, lang, case when doc_id % 7 = 0 then null else doc_id % 40 end as months, case when doc_id % 5 = 0 then null else doc_id % 6 * 1000 end as fine, doc_id % 11 = 0 as death, doc_id % 22 = 0 as life from documents),
k as (select *, trim(array_to_string(list_filter(string_split(regexp_replace(trim(text), '([{_ENDS}])', '\1' || chr(1), 'g'), chr(1)), lambda x: not regexp_matches(x, '{_LEAK}')), '')) as clean, {_hits('text', rules.LEAKAGE)} as dropped from c),
m as (select *, {_masked('clean')} as fact, {_private('clean')} as private from k),
e as (select *, {_hits('fact', rules.LEAKAGE)} as remains, sha256(regexp_replace(lower(fact), '[^\p{{L}}\p{{N}}]+', '', 'g')) as norm from m),
w as (select *, case when clean = '' then 'empty_after_leakage_clean' when remains > 0 then 'residual_leakage_rows_excluded' end as why from e),
x as (select *, case when why is null and o > min(o) filter (why is null) over (partition by norm) then 'cross_split_duplicates_excluded' else why end as excluded,
  case when death and life then 'unknown' when death then 'death' when life then 'life' when months > 0 then 'fixed_term' when months = 0 then 'exempt' else 'unknown' end as sentence_type,
  case when fine = 0 then 'zero' when fine > 0 then 'positive' else 'missing' end as status from w)"""


def _converted(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    k = F.col("doc_id")
    cases = d.select(
        k.alias("case_id"),
        F.get(F.array(*[F.lit(s) for s in conversion.SPLITS]), (k % 3).cast("int")).alias("split"),
        F.col("text").alias("fact"),
        F.array("lang").alias("accusations"),
        F.array((k % 50).cast("int")).alias("relevant_articles"),
        F.when(k % 7 != 0, k % 40).cast("int").alias("months"),
        F.when(k % 5 != 0, k % 6 * 1000).alias("fine"),
        (k % 11 == 0).alias("death"),
        (k % 22 == 0).alias("life"),
    )
    return conversion.converted(cases, "synthetic", "1", rules.PRIVACY, rules.LEAKAGE, None, _ENDS, "art. {}")


@query(rf"""with {_CASES_SQL}
select 'V3-' || substr(sha256('synthetic:' || doc_id), 1, 20) as case_id, doc_id::varchar as source_case_id, split as original_split, sha256(fact) as fact_sha256, 'art. ' || doc_id % 50 as article, sentence_type,
  case when sentence_type in ('fixed_term', 'exempt') then months end::int as imprisonment_months, status as fine_status, case when status <> 'missing' then fine end as fine_amount, death and not life as death_penalty, case when private > 0 then 'redacted' else 'clear' end as privacy_status,
  case when dropped > 0 then 'cleaned' else 'clean' end as leakage_status, 'DG-' || substr(norm, 1, 20) as duplicate_group_id, sentence_type <> 'unknown' as sentencing_train, status = 'positive' as fine_amount_task
from x where excluded is null""")
def converted_cases(spark, sf_dir):
    c = conversion.kept(_converted(spark, sf_dir))
    return c.select("case_id", "source_case_id", "original_split", F.sha2("fact", 256).alias("fact_sha256"), F.get("relevant_articles", F.lit(0)).alias("article"), "sentence_type", "imprisonment_months", F.col("fine.status").alias("fine_status"), F.col("fine.amount").alias("fine_amount"), "death_penalty", "privacy_status", "leakage_status", "duplicate_group_id", "task_masks.sentencing_train", F.col("task_masks.fine_amount").alias("fine_amount_task"))


@query(rf"""with {_CASES_SQL}
select split as original_split, count(*) filter (excluded is null) as rows, count(*) filter (excluded = 'empty_after_leakage_clean') as empty, count(*) filter (excluded = 'residual_leakage_rows_excluded') as residual, count(*) filter (excluded = 'cross_split_duplicates_excluded') as crossing,
  count(*) filter (death and life) as conflicting_death_and_life, sum(private)::bigint as privacy_hits, sum(dropped)::bigint as leakage_rules_removed, count(*) filter (excluded is null and sentence_type <> 'unknown') as task_sentencing_train, count(*) filter (excluded is null and status = 'zero') as fine_zero from x group by split""")
def conversion_report(spark, sf_dir):
    r = conversion.conversion_report(_converted(spark, sf_dir))
    return r.select("original_split", "rows", F.col("empty_after_leakage_clean").alias("empty"), F.col("residual_leakage_rows_excluded").alias("residual"), F.col("cross_split_duplicates_excluded").alias("crossing"), "conflicting_death_and_life", F.col("privacy_hits").cast("long").alias("privacy_hits"), F.col("leakage_rules_removed").cast("long").alias("leakage_rules_removed"), "task_sentencing_train", "fine_zero")


@query("select label, row_number() over (order by label)::int - 1 as label_id from (select distinct unnest([source, lang]) as label from documents)")
def label_mapping(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.array("source", "lang").alias("l"))
    return labels.corpus_mapping(d, "l")


@query("select o_custkey, n from (select o_custkey, count(*) as n from orders group by all) order by n desc, o_custkey limit 20")
def most_common_customers(spark, sf_dir):
    """A report of the 20 most frequent values."""
    return metrics.top_values(read_table(spark, sf_dir, "orders"), "o_custkey", 20)


@query("select 'longest' as kind, doc_id, n from (select doc_id, length(text) as n from documents where text is not null order by n desc, doc_id limit 4) union all select 'shortest', doc_id, n from (select doc_id, length(text) as n from documents where text is not null order by n, doc_id limit 20)")
def extreme_documents(spark, sf_dir):
    """A report of the 4 longest and the 20 shortest documents."""
    d = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    ends = [metrics.extreme_rows(d, F.col("n"), "doc_id", k, last).select(F.lit(name).alias("kind"), "doc_id", "n") for name, k, last in (("longest", 4, False), ("shortest", 20, True))]
    return ends[0].unionByName(ends[1])


@query("""
with t as (select l_shipmode_like as label, count(*) as label_rows from (select l_returnflag || l_linestatus as l_shipmode_like from lineitem) group by all order by label_rows desc, label limit 3),
l as (select l_returnflag || l_linestatus as label, l_quantity as v, l_extendedprice / 1000 as p from lineitem)
select label, label_rows, count(*) as rows, round(avg(abs(v - p)), 6) as mae, round(median(abs(v - p)), 6) as median_ae from l join t using (label) group by all
""")
def top_group_regression(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_quantity").alias("v"), (F.col("l_extendedprice") / 1000).alias("p"))
    return metrics.regression_of_top(l, "label", "v", "p", 3)


@query("""
with r as (select l_returnflag, l_discount > 0.05 as t, l_quantity > 25 as p from lineitem), c as (select l_returnflag, count(*) as rows, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn from r group by all)
select l_returnflag, rows, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c
""")
def binary_prf(spark, sf_dir):
    return metrics.binary_prf(read_table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, F.col("l_quantity") > 25, ["l_returnflag"])


_SCORES_SQL = "s as (select doc_id, lang, [lang] as gold, {'en': round(((doc_id * 7) % 101) / 101, 6), 'fr': round(((doc_id * 13) % 103) / 103, 6), 'de': round(((doc_id * 17) % 107) / 107, 6), 'es': round(((doc_id * 19) % 109) / 109, 6)} as p from documents), b as (select *, list_sort([{'q': -p.en, 'l': 'en'}, {'q': -p.fr, 'l': 'fr'}, {'q': -p.de, 'l': 'de'}, {'q': -p.es, 'l': 'es'}])[1] as best from s where lang in ('en', 'fr', 'de'))"


def _scored(spark, sf_dir):
    k = F.col("doc_id")
    parts = [("en", 7, 101), ("fr", 13, 103), ("de", 17, 107), ("es", 19, 109)]
    p = F.create_map(*[x for name, a, m in parts for x in (F.lit(name), F.round((k * a) % m / m, 6))])
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.array("lang").alias("gold"), p.alias("scores"))


@query(f"with {_SCORES_SQL} select lang as true_label, case when best.l in ('en', 'fr', 'de') then best.l else 'other' end as predicted, count(*) as n from b group by all")
def target_confusion(spark, sf_dir):
    return metrics.target_confusion(_scored(spark, sf_dir), "gold", "scores", ["en", "fr", "de"])[0]


@query(f"with {_SCORES_SQL} select doc_id, lang as true_label, best.l as predicted_label, -best.q as predicted_probability from b where best.l <> lang order by predicted_probability desc, doc_id limit 200")
def review_queue(spark, sf_dir):
    """A queue of the 200 surest errors."""
    wrong = metrics.target_confusion(_scored(spark, sf_dir), "gold", "scores", ["en", "fr", "de"])[1]
    return metrics.review_queue(wrong, "doc_id").select("doc_id", "true_label", "predicted_label", "predicted_probability")


@query("""
with u as (select user_id, list_distinct(list(event_type)) as seen, count(*) as n from events group by user_id),
r as (select user_id, user_id % 4 as category, user_id % 5 = 0 as abstain, case when user_id % 5 = 0 then [] when user_id % 2 = 0 then ['click'] else ['view', 'error'] end as expected, case when user_id % 3 = 0 then ['error'] else [] end as forbidden, list_filter(seen, lambda x: length(x) > user_id % 7) as predicted, list_sort(seen) as ranked from u),
p as (select *, case when abstain then len(predicted) = 0 else len(list_filter(expected, lambda x: not list_contains(predicted, x))) = 0 end and len(list_intersect(predicted, forbidden)) = 0 as ok, len(expected) > 0 as asks, len(list_filter(expected, lambda x: not list_contains(ranked[1:5], x))) = 0 as found from r)
select category, count(*) as rows, count(*) filter (ok) as passed, round(count(*) filter (ok) / count(*), 6) as pass_rate, count(*) filter (len(predicted) = 0) as abstentions, round(count(*) filter (asks and found) / greatest(count(*) filter (asks), 1), 6) as expected_in_top5 from p group by category
""")
def regression_checks(spark, sf_dir):
    u = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    k, none = F.col("user_id"), F.array().cast("array<string>")
    wanted = F.when(k % 5 == 0, none).when(k % 2 == 0, F.array(F.lit("click"))).otherwise(F.array(F.lit("view"), F.lit("error")))
    rows = u.select((k % 4).alias("category"), (k % 5 == 0).alias("abstain"), wanted.alias("expected"), F.when(k % 3 == 0, F.array(F.lit("error"))).otherwise(none).alias("forbidden"), F.filter("seen", lambda x: F.length(x) > k % 7).alias("predicted"), F.array_sort("seen").alias("ranked"))
    return metrics.regression_checks(rows, "category", "expected", "forbidden", "predicted", "ranked", "abstain")


@query("""
with r as (select event_type, value > 10 as schema_valid, event_id % 3 <> 0 as reviewed, [user_id % 9, event_id % 9] as cited, [0, 1, 2, 3, 4, user_id % 9] as known, value from events where value is not null),
s as (select event_type, count(*) as rows, round(avg(schema_valid::int), 6) as schema_valid, round(avg(reviewed::int), 6) as reviewed, sum(len(cited))::bigint as citations, sum(len(list_filter(cited, lambda x: not list_contains(known, x))))::bigint as unknown_citations, list_sort(list(value)) as v from r group by event_type)
select event_type, rows, schema_valid, reviewed, citations, unknown_citations, round(unknown_citations / citations, 6) as unknown_citation_rate, v[floor(0.5 * (rows - 1))::bigint + 1] as latency_p50, v[floor(0.95 * (rows - 1))::bigint + 1] as latency_p95 from s
""")
def contract_metrics(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").where("value is not null")
    known = F.array(*[F.lit(x).cast("long") for x in range(5)], (F.col("user_id") % 9).cast("long"))
    cited = F.array((F.col("user_id") % 9).cast("long"), (F.col("event_id") % 9).cast("long"))
    return metrics.contract_metrics(e, {"schema_valid": F.col("value") > 10, "reviewed": F.col("event_id") % 3 != 0}, cited, known, "value", ["event_type"])


@query("""
with s as (select doc_id, l, l = lang as t, round((doc_id * m % n) / n::double, 6) as p from documents, (values ('en', 7, 101), ('fr', 13, 103), ('de', 17, 107), ('es', 19, 109)) v(l, m, n)),
r as (select doc_id, max(p) as best, count(*) filter (p >= 0.6) as k, sum(p) filter (t) as ts, count(*) filter (t) as tn, max(p) filter (not t) as wrong from s group by doc_id)
select count(*) as rows, count(*) filter (k = 0) as abstained_rows, max(k) as most_labels, round(avg(best), 6) as mean_best, round(min(best), 6) as least_best, round(sum(ts) / sum(tn), 6) as mean_true, round(max(wrong), 6) as largest_wrong from r
""")
def probability_audit(spark, sf_dir):
    long = _scored(spark, sf_dir).select("doc_id", "lang", F.explode("scores").alias("label", "p"))
    return metrics.probability_audit(long.withColumn("t", F.col("label") == F.col("lang")), "doc_id", "t", "p", 0.6)


@query("select l.doc_id, quality, toxic, lang, n_chars from labels l join documents d on l.doc_id = d.doc_id")
def aligned_rows(spark, sf_dir):
    """Two tables side by side by their row ids, with a check that neither has a row without a partner."""
    l = read_table(spark, sf_dir, "labels")
    d = read_table(spark, sf_dir, "documents").join(l.select("doc_id"), "doc_id", "left_semi")
    return metrics.aligned(l, d.select("doc_id", "lang", "n_chars"), "doc_id")


@query(f"""
with f as (select o_orderkey as request, o_orderstatus || ' order of a@b.com' as raw from orders), r as (select request, regexp_replace(raw, '{rules.PRIVACY[0][1]}', '[{rules.PRIVACY[0][0].upper()}_REDACTED]', 'g') as fact from f),
h as (select l_orderkey as request, list(l_linenumber || ':' || (case when l_partkey % 3 = 0 then 'statute' else 'case' end) order by case when l_partkey % 3 = 0 then 1 else 0 end, l_linenumber, l_partkey) as items from lineitem group by l_orderkey)
select request, 'req-' || substr(sha256('2024-01-31' || chr(0) || fact), 1, 16) as request_id, fact, coalesce(array_to_string(items, ','), '') as items from r left join h using (request)
""")
def evidence_packets(spark, sf_dir):
    facts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.concat("o_orderstatus", F.lit(" order of a@b.com")).alias("fact"), F.array("o_orderpriority").alias("predicted_labels"))
    none = F.array().cast("array<string>")
    hits = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("evidence_id"), F.when(F.col("l_partkey") % 3 == 0, "statute").otherwise("case").alias("kind"), F.struct("l_linenumber", "l_partkey").alias("rank"), F.lit("text").alias("text"), none.alias("labels"), none.alias("articles"))
    p = grounding.evidence_packet(facts, hits, F.lit("2024-01-31"), rules.PRIVACY)
    return p.select("request", "request_id", "fact", F.array_join(F.transform("evidence", lambda e: F.concat(e["evidence_id"], F.lit(":"), e["evidence_type"])), ",").alias("items"))


@query()
def keyword_truncation(spark, sf_dir):
    """Texts cut to 512 characters by sentences; checked against a plain version in the tests."""
    d = spread(read_table(spark, sf_dir, "documents"))
    short = selected_sentences(F.col("text"), ["the", "and", "que", "der"], 512, ".!?")
    return d.select("doc_id", F.md5(short).alias("text_md5"), F.length(short).alias("n"))
