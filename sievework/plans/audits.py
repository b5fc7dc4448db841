"""Queries of audits, sentencing evidence and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import features, redaction, rules
from sievework.functions.money import bucket
from sievework.operators import audits, policy, sentencing, validation
from sievework.session import read_table, spread
from sievework.sources.files import stored

from .registry import query


_TAGS = "list_filter([" + ", ".join(f"case when regexp_matches({{0}}, '{p}') then '{n}' end" for n, p in rules.FACTORS) + "], lambda x: x is not null)"


@query("""
with g as (select doc_id, unnest(list_concat(list_concat(case when length(c) = 0 then [] when length(c) <= 2 then [c] else list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) end, case when length(c) = 0 then [] when length(c) <= 3 then [c] else list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) end), case when length(c) = 0 then [] when length(c) <= 4 then [c] else list_transform(range(1, length(c) - 2), lambda i: substr(c, i, 4)) end)) as gram, kind from
  (select doc_id, regexp_replace(text, '\\s+', '', 'g') as c, 'd' as kind from documents union all select item_id, regexp_replace(text, '\\s+', '', 'g'), 'q' from benchmark)),
n as (select kind, doc_id, ('0x' || substr(md5(gram), 1, 15))::bigint % 262144 as bucket, count(*) as n from g group by all),
w as (select kind, doc_id, bucket, n / sqrt(sum(n * n) over (partition by kind, doc_id)) as weight from n),
s as (select q.doc_id as query, d.doc_id as doc, round(sum(q.weight * d.weight), 9) as cosine from w q join w d on q.kind = 'q' and d.kind = 'd' and q.bucket = d.bucket group by all),
e as (select s.*, source, d.lang, d.text as dt, b.text as qt from s join documents d on d.doc_id = doc join benchmark b on b.item_id = query where d.lang = ['en', 'fr', 'de', 'es', null][query % 5 + 1] or query % 5 = 4),
k as (select *, {tags_q} as qf, {tags_d} as df from e qualify row_number() over (partition by query order by cosine desc, doc) <= 60),
st as (select *, 0.6 * exp(-abs(ln(1.0 + length(qt)) - ln(1.0 + length(dt)))) + 0.4 * case when len(list_distinct(list_concat(qf, df))) = 0 then 0.5 else len(list_intersect(qf, df)) / len(list_distinct(list_concat(qf, df))) end as structure from k),
t as (select *, least(1.0, round(0.7 * greatest(0.0, least(1.0, cosine)) + 0.2 * structure + 0.1 * (query % 5 <> 4)::int, 9)) as score from st), g2 as (select * from t where score >= 0.2),
o as (select * from g2 qualify row_number() over (partition by query, source order by score desc, doc) = 1)
select query, doc, source as case_id, round(score, 6)::double as score, row_number() over (partition by query order by score desc, doc)::int as rank from o qualify row_number() over (partition by query order by score desc, doc) <= 3
""".replace("{tags_q}", _TAGS.format("qt")).replace("{tags_d}", _TAGS.format("dt")))
def sentencing_evidence(spark, sf_dir):
    """Cases whose language is the one predicted for the query; every fifth query has no prediction and meets all cases."""
    docs, asked = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    predicted = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 5).cast("int"))

    def told(df, more):
        return df.withColumns({f"{more}_tags": redaction.tags(F.col("text"), rules.FACTORS), f"{more}_size": F.length("text")}).drop("text")

    cases = docs.select(F.col("doc_id").alias("doc"), "text", "source")
    near = docs.select(F.col("doc_id").alias("doc"), "text", F.array_compact(F.array("lang")).alias("labels"))
    q = asked.select(F.col("item_id").alias("query"), "text", F.array_compact(F.array(predicted)).alias("labels"))
    queries = sentencing.packed(asked, "item_id", F.col("text")).withColumnRenamed("item_id", "query").join(q.select("query", "labels"), "query")
    # candidates are written, so that texts are met by them where they are read, and only theirs are searched for factors
    found = stored(sentencing.similar_texts(near, queries), "candidates")
    met = told(cases.join(found, "doc"), "doc").join(told(q, "query"), "query")
    scored = met.select("query", "doc", "cosine", F.col("source").alias("case_id"), features.evidence_similarity(F.col("query_tags"), F.col("doc_tags"), F.col("query_size"), F.col("doc_size")).alias("structure"), (F.size("labels") > 0).alias("same_labels"))
    return sentencing.evidence(scored).select("query", "doc", "case_id", F.round("score", 6).alias("score"), "rank")


@query("""
with p as (select user_id as query, event_type as label, round(count(*) / sum(count(*)) over (partition by user_id), 6) as probability, user_id % 2 = 0 as used_fallback from events group by user_id, event_type)
select query, label, probability from p qualify not used_fallback or row_number() over (partition by query order by probability desc, label) <= 3
""")
def narrowed_labels(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    total = e.groupBy("user_id").agg(F.count("*").alias("t"))
    p = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(total, "user_id")
    given = p.select(F.col("user_id").alias("query"), F.col("event_type").alias("label"), F.round(F.col("n") / F.col("t"), 6).alias("probability"), (F.col("user_id") % 2 == 0).alias("used_fallback"))
    return policy.narrowed_labels(given).drop("used_fallback")


@query()
def diverse_queries(spark, sf_dir):
    """200 documents at most, so that every tag has its turn; a selection, whose size is its purpose."""
    docs = read_table(spark, sf_dir, "documents")
    labels = F.array("lang")
    tagged = docs.select("doc_id", features.query_tags(labels, F.lit(100), F.col("text"), [("amount", r"[0-9]"), ("joint_crime", r" \| ")]).alias("tags"))
    return spark.createDataFrame([(k,) for k in policy.diverse_queries(tagged, "doc_id", "tags")], "doc_id long")


_P = [p for _, p in rules.PRIVACY[:1]][0]


@query(f"""
select lang, count(*) as rows, count(*) filter (trim(text) = '') as empty_texts, sum(len(regexp_extract_all(text, '{_P}')))::bigint as private_hits, count(*) filter (regexp_matches(text, '{_P}')) as private_rows, count(*) filter (regexp_matches(text, '[Ll]icen[sc]e[d]?')) as leaking_rows from documents group by lang
""")
def external_audit(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    a = audits.external(docs, "text", F.array("lang"), F.lit("missing"), F.lit(None).cast("int"), rules.PRIVACY[:1], rules.LEAKAGE[1:2], None, ["lang"])
    return a["counters"].select("lang", "rows", "empty_texts", "private_hits", "private_rows", "leaking_rows")


@query("select count(*) as rows, count(*) filter (c_acctbal is null) as missing, count(*) filter (c_acctbal < 0) as invalid, count(*) filter (c_acctbal >= 9000) as outliers, max(c_acctbal) as largest from customer")
def amount_audit(spark, sf_dir):
    return audits.amounts(read_table(spark, sf_dir, "customer"), "c_acctbal", 9000)


@query("""
with e as (select unnest(list_filter([case when o_totalprice <= 0 then 'no_price' end, case when o_orderstatus <> 'F' then 'open' end, case when o_custkey % 3 = 0 then 'third' end], lambda x: x is not null)) as error from orders)
select error, count(*) as n from e group by error
""")
def dataset_validation(spark, sf_dir):
    checks = [("no_price", F.col("o_totalprice") <= 0), ("open", F.col("o_orderstatus") != "F"), ("third", F.col("o_custkey") % 3 == 0)]
    return audits.error_histogram(read_table(spark, sf_dir, "orders"), checks)


@query("""
with p as (select event_type, event_id % 4 <> 0 as parsed, event_id % 3 <> 0 as valid, user_id % 2 = 0 as grounded from events),
m as (select event_type, count(*) as rows, round(avg(parsed::int), 6) as json_rate, round(avg((parsed and valid)::int), 6) as schema_rate, round(avg((parsed and valid and grounded)::int), 6) as grounded_rate from p group by event_type)
select *, list_filter([case when json_rate < 0.75 then 'json_rate' end, case when schema_rate < 0.5 then 'schema_rate' end, case when rows > 100000 then 'rows' end], lambda x: x is not null) as failed, not (json_rate < 0.75 or schema_rate < 0.5 or rows > 100000) as passed from m
""")
def generation_metrics(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    m = audits.generation(e, F.col("event_id") % 4 != 0, F.col("event_id") % 3 != 0, F.col("user_id") % 2 == 0, ["event_type"])
    return audits.threshold_gate(m, {"json_rate": 0.75, "schema_rate": 0.5}, {"rows": 100_000})


@query("""
with u as (select user_id, list_distinct(list(event_type)) as t, count(*) as n from events group by user_id)
select user_id, n < 20 as abstained, case when n < 20 then 0.0::double else round((n % 7) / 7, 6) end as confidence, n < 20 or round((n % 7) / 7, 6) < 0.6 as requires_review from u
""")
def service_decisions(spark, sf_dir):
    u = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    d = sentencing.service_decision(F.repeat(F.lit("x"), F.col("n").cast("int")), F.array((F.col("n") % 7) / 7))
    return u.select("user_id", d.alias("d")).select("user_id", "d.*")


@query()
def sentencing_baseline(spark, sf_dir):
    """Bucket accuracy of a hashed n-gram classifier for the length of a document, on held-out documents."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", redaction.tags(F.col("text"), rules.FACTORS).alias("f"), F.split(F.lower("text"), r"\s+").alias("grams"), bucket(F.length("text").cast("long"), [0, 500, 2000, 10**12]).cast("string").alias("y"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = sentencing.classifier("y", buckets=1 << 12, iterations=10).fit(rows.where(~part))
    return model.transform(rows.where(part)).agg(F.count("*").alias("rows"), F.round(F.avg((F.col("prediction") == F.col("__y")).cast("int")), 6).alias("accuracy"))


@query()
def sentencing_model(spark, sf_dir):
    """Figures of the whole hierarchical model on held-out documents, whose length stands for a sentence and its fine."""
    docs = spread(read_table(spark, sf_dir, "documents").where("text is not null"))
    n = F.length("text")
    kind = F.when(n > 8000, "life").when(n > 600, "fixed_term").otherwise("exempt")
    rows = docs.select("doc_id", F.split(F.lower("text"), r"\s+").alias("grams"), kind.alias("sentence_type"), F.when(kind == "fixed_term", F.floor(n / 100)).cast("int").alias("months"), F.when(F.col("lang") == "en", n).otherwise(0).cast("long").alias("fine"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = sentencing.SentencingModel(rows.where(~part), buckets=1 << 12, iterations=10)
    truth = rows.where(part).select("doc_id", "grams", F.col("sentence_type").alias("truth"), F.col("months").alias("true_months"), (F.col("fine") > 0).alias("true_fine"))
    p = model.predict(truth)
    return p.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("truth") == F.col("sentence_type")).cast("int")), 6).alias("type_accuracy"), F.round(F.avg((F.col("true_fine") == F.col("fine_imposed")).cast("int")), 6).alias("fine_accuracy"), F.round(F.avg(F.abs(F.col("true_months") - F.col("imprisonment_months"))), 6).alias("months_mae"))


# Training rows made of documents: each eighth has another fault.
_ROWS_SQL = """r as (select doc_id % 8 as s, case when doc_id % 5 = 0 then 'validation' else 'train' end as split, doc_id // 6 as case_id, case when doc_id % 11 = 0 then '' else 'sft-' || (doc_id // 2) end as sft_id, lang, doc_id from documents)"""


@query(f"""with {_ROWS_SQL},
e as (select unnest(list_filter([case when s = 1 then 'source_split_mismatch' end, case when s in (1, 2) then 'invalid_review_status' end, case when s = 3 then 'target_schema_invalid' end, case when s = 4 then 'assistant_json_invalid' end,
  case when s = 5 then 'assistant_target_mismatch' end, case when s = 6 then 'insufficient_information_has_accusation' end, case when s in (6, 7) then 'insufficient_information_not_escalated' end], lambda x: x is not null)) as error from r),
i as (select split, nullif(sft_id, '') as id, count(*) as n from r group by all), d as (select sum(case when id is null then n else n - 1 end)::bigint as n from i),
o as (select count(*) as n from (select case_id from r group by case_id having count(distinct split) > 1))
select error, count(*) as n from e group by error union all select 'missing_or_duplicate_sft_id', n from d where n > 0 union all select 'source_case_cross_split_overlap', n from o where n > 0""")
def training_validation(spark, sf_dir):
    """Errors of chat training rows made of the documents."""
    d = read_table(spark, sf_dir, "documents").withColumn("s", F.col("doc_id") % 8)
    split = F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train")
    sound = F.concat(F.lit('{"candidate_accusations": ["'), F.coalesce("lang", F.lit("none")), F.lit('"], "key_facts": [], "confidence": "high", "requires_manual_review": true}'))
    other = F.replace(sound, F.lit('"key_facts": []'), F.lit('"key_facts": ["seen"]'))
    bare = F.lit('{"confidence": "low", "requires_manual_review": false}')
    rows = d.select(
        split.alias("split"),
        F.expr("doc_id div 6").alias("case_id"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("sft-"), F.expr("doc_id div 2"))).alias("sft_id"),
        F.when(F.col("s") == 1, "test").otherwise(split).alias("source_split"),
        F.when(F.col("s") == 1, None).when(F.col("s") == 2, "reviewed").otherwise("unreviewed").alias("review_status"),
        F.when(F.col("s") >= 6, "deterministic_insufficient_information").otherwise("plain").alias("construction_type"),
        F.when(F.col("s") == 3, "{}").when(F.col("s") == 7, bare).otherwise(sound).alias("target"),
        F.when(F.col("s") == 4, "none").when(F.col("s") == 5, other).when(F.col("s") == 7, bare).otherwise(sound).alias("answer"),
    )
    return validation.training_errors(rows)


@query("""
with q as (select item_id as query_id, item_id % 4 = 0 as other, item_id % 6 = 0 as seen from benchmark), c as (select doc_id as candidate_id, lang = 'en' as other from documents where doc_id % 7 <> 0),
j as (select l_suppkey * 3 as query_id, l_partkey as candidate_id, l_linenumber = 1 as claims, l_linenumber = 2 as seen from lineitem),
e as (select 'query_not_validation' as error from q where other union all select 'query_review_status_invalid' from q where seen union all select 'candidate_not_train' from c where other
  union all select 'dangling_qrel' from j where query_id not in (select query_id from q) or candidate_id not in (select candidate_id from c)
  union all select 'qrel_claims_non_proxy_judgment' from j where claims union all select 'qrel_review_status_invalid' from j where seen
  union all select 'reviewed_qrels_must_be_empty_before_human_review' from labels where toxic = 1)
select error, count(*) as n from e group by error
""")
def retrieval_validation(spark, sf_dir):
    """Errors of a retrieval set: benchmark items as queries, documents as candidates, order lines as judgments."""
    t = lambda name: read_table(spark, sf_dir, name)
    items = t("benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 0, "test").otherwise("validation").alias("source_split"), F.when(F.col("item_id") % 6 != 0, "unreviewed").alias("review_status"))
    candidates = t("documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("candidate_id"), F.when(F.col("lang") == "en", "validation").otherwise("train").alias("source_split"))
    qrels = t("lineitem").select((F.col("l_suppkey") * 3).alias("query_id"), F.col("l_partkey").alias("candidate_id"), F.when(F.col("l_linenumber") == 1, "people").otherwise("silver_proxy").alias("judgment_source"), F.when(F.col("l_linenumber") == 2, "reviewed").otherwise("unreviewed").alias("review_status"))
    return validation.retrieval_errors(queries, candidates, qrels, t("labels").where("toxic = 1"))


@query("""
with r as (select ['train', 'validation', 'test'][doc_id % 3 + 1] as split, case when lang = 'en' then 0 when lang = 'fr' then 1 else 9 end as label, doc_id % 50 = 0 as claims, sha256(text) as fact, substr(md5(lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))), 1, 20) as grp from documents),
f as (select distinct split, fact from r where fact is not null), g as (select distinct split, grp from r where grp is not null)
select 'size' as "check", split as splits, count(*) as n from r group by split union all select 'invalid_label_rows', split, count(*) filter (label = 9) from r group by split union all select 'manually_reviewed_rows', split, count(*) filter (claims) from r group by split
union all select 'shared_facts', a.split || '|' || b.split, count(*) from f a join f b on a.fact = b.fact and a.split < b.split group by all
union all select 'shared_groups', a.split || '|' || b.split, count(*) from g a join g b on a.grp = b.grp and a.split < b.split group by all
""")
def dataset_report(spark, sf_dir):
    """Sizes, unknown labels, claimed reviews and overlaps of three splits of the documents."""
    label = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(9)
    split = F.get(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3).cast("int"))
    group = F.substring(F.md5(F.lower(F.regexp_replace("text", "[^a-zA-Z]", ""))), 1, 20)
    rows = spread(read_table(spark, sf_dir, "documents")).select(split.alias("split"), F.array(label).alias("label_ids"), F.when(F.col("doc_id") % 50 == 0, "manually_reviewed").otherwise("unreviewed").alias("review_status"), F.sha2("text", 256).alias("fact_sha256"), group.alias("group_id"))
    return validation.dataset_report(rows, F.array(F.lit(0), F.lit(1)))


@query("""
with f as (select doc_id, sha256(text) as fact_sha256, text, case when doc_id % 9 = 0 then null when doc_id % 9 = 1 then -5 else length(text) * 1000 end as fine from documents)
select doc_id, fact_sha256, fine::bigint as fine, unnest(list_filter([case when fine is null or fine < 0 then 'invalid_fine' end, case when fine >= 1000000 then 'fine_outlier' end, case when regexp_matches(text, '[Ll]icen[sc]e') then 'residual_marker' end], lambda x: x is not null)) as finding from f
""")
def sentencing_findings(spark, sf_dir):
    """Documents with an invalid or outlying amount or a marker left in their text."""
    fine = F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 9 == 1, -5).otherwise(F.length("text") * 1000).cast("long")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fact_sha256"), fine.alias("fine"), "text")
    return validation.sentencing_findings(rows, "fine", "text", "[Ll]icen[sc]e", 1_000_000).drop("text")


_LEAK = "[Ll]icen[sc]e[d]?"
_YEAR = "20[0-9]{2}"


@query(f"""
with r as (select coalesce(source, 'none') as source, coalesce(text, '') as t, sha256(coalesce(text, '')) as fp, regexp_extract(coalesce(text, ''), '{_YEAR}') as y, case when doc_id % 6 = 0 then null when doc_id % 6 = 1 then -1 when doc_id % 6 = 2 then 0 else doc_id end as fine from documents),
p as (select source, t, fp, case when y = '' then 'missing' else y end as y, case when fine is null then 'missing' when fine < 0 then 'invalid' when fine = 0 then 'zero' else 'positive' end as st, fine from r),
q as (select source, list_sort(list(length(t)) filter (t <> '')) as lens, list_sort(list(fine) filter (fine > 0 and t <> '')) as fines from p group by source),
d as (select source, sum(n - 1)::bigint as n from (select source, fp, count(*) as n from p where t <> '' group by all) group by source)
select source, 'counters' as section, 'rows' as key, count(*)::double as value from p group by source union all select source, 'counters', 'empty_texts', count(*) filter (t = '') from p group by source
union all select source, 'counters', 'leakage_hits', sum(len(regexp_extract_all(t, '{_LEAK}'))) from p group by source union all select source, 'counters', 'leaking_rows', count(*) filter (regexp_matches(t, '{_LEAK}')) from p group by source
union all select source, 'counters', 'private_hits', sum(len(regexp_extract_all(t, '{_P}'))) from p group by source union all select source, 'counters', 'private_rows', count(*) filter (regexp_matches(t, '{_P}')) from p group by source
union all select source, 'counters', 'duplicates', n from d where n > 0
union all select source, 'years', y, count(*) from p where t <> '' group by source, y union all select source, 'fines', st, count(*) from p where t <> '' group by source, st
union all select source, 'lengths', 'p' || k, lens[((len(lens) - 1) * k // 100 + 1)::int] from q, (values (50), (90), (99), (100)) v(k) where len(lens) > 0
union all select source, 'positive_fines', 'p' || k, fines[((len(fines) - 1) * k // 100 + 1)::int] from q, (values (50), (90), (99), (100)) v(k) where len(fines) > 0
""")
def external_report(spark, sf_dir):
    """The whole audit of each source as one table."""
    d = spread(read_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    fine = F.when(F.col("doc_id") % 6 == 0, None).when(F.col("doc_id") % 6 == 1, -1).when(F.col("doc_id") % 6 == 2, 0).otherwise(F.col("doc_id")).cast("long")
    status = F.when(fine.isNull(), "missing").when(fine < 0, "invalid").when(fine == 0, "zero").otherwise("positive")
    rows = d.select(F.coalesce("source", F.lit("none")).alias("source"), text.alias("text"), fine.alias("fine"), status.alias("status"), F.coalesce(F.nullif(F.regexp_extract(text, _YEAR, 0), F.lit("")), F.lit("missing")).alias("year"))
    return audits.external_report(rows, "text", "year", "status", "fine", ["source"], rules.PRIVACY[:1], [("licence", _LEAK)], None)
