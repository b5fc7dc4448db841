"""Queries of splits, samples, batches and validity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.operators import dedup, quality, split, stats, validity
from sievework.session import read_table

from .registry import query


@query("""
with g as (select o_custkey, min(case when o_custkey % 7 = 0 then null else o_orderdate::date end) as first from orders group by o_custkey),
r as (select o_custkey, row_number() over (order by first, o_custkey) - 1 as k, count(*) over () as n from g where first is not null),
u as (select o_custkey, (('0x' || substr(sha256(o_custkey::varchar), 1, 8))::bigint % 10000) / 10000 as u from g where first is null)
select o_custkey, case when k < floor(n * (1 - 0.1::double - 0.1::double)) then 'train' when k < floor(n * (1 - 0.1::double)) then 'validation' else 'test' end as split from r
union all select o_custkey, case when u < 1 - 0.1::double - 0.1::double then 'train' when u < 1 - 0.1::double then 'validation' else 'test' end from u
""")
def temporal_group_split(spark, sf_dir):
    dated = F.when(F.col("o_custkey") % 7 != 0, F.to_date("o_orderdate"))
    return split.temporal_split(read_table(spark, sf_dir, "orders").select("o_custkey", dated.alias("d")), "o_custkey", "d")


@query("""
with d as (select distinct 's' || (doc_id % 3) as split, md5(text) as f from documents)
select a.split as split_a, b.split as split_b, count(*) as shared from d a join d b on a.f = b.f and a.split < b.split group by all
""")
def split_overlap(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("split"), F.md5("text").alias("f"))
    return dedup.split_overlap(d, "split", "f")


@query("""
with i as (select user_id, event_id, ts as starts, lead(ts) over (partition by user_id order by ts, event_id) as ends from events where event_type = 'purchase'),
p as (select user_id, event_id as point_id, ts as t_at from events where event_type = 'click')
select point_id, i.event_id from p join i on p.user_id = i.user_id and starts <= t_at and (ends is null or t_at < ends)
""")
def asof_interval_filter(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    intervals = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("starts"), nxt.alias("ends"))
    points = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("point_id"), F.col("ts").alias("at"))
    return validity.in_force(intervals, points, "user_id", "starts", "ends", "at").select("point_id", "event_id")


_RULES = {"suffixes": ["example.org", "example.com"], "verified": ["src1", "src2", "src3"], "in_force": ["en", "fr"]}


@query("""
with p as (select page_id, url, lower(regexp_extract(url, '^https://([^/?#:]*)', 1)) as host, 'src' || (page_id % 5) as source_status, ['en', 'fr', 'de'][page_id % 3 + 1] as legal_status,
  case when page_id % 4 = 0 then null else date '2024-01-01' + (page_id % 60)::int end as effective, case when page_id % 6 = 0 then date '2024-01-31' end as expiry, case when page_id % 9 = 0 then null else date '2024-01-31' end as as_of, case when page_id % 8 = 0 then 'case' else 'statute' end as kind from pages),
r as (select page_id, list_filter([case when kind <> 'statute' then 'not_statute_evidence' end,
  case when not (host in ('example.org', 'example.com') or ends_with(host, '.example.org') or ends_with(host, '.example.com')) then 'non_authoritative_source_url' end,
  case when source_status not in ('src1', 'src2', 'src3') then 'source_not_human_verified' end, case when legal_status not in ('en', 'fr') then 'legal_status_not_effective' end,
  case when as_of is null then 'missing_as_of_date' end, case when as_of is not null and effective is null then 'missing_effective_date' end,
  case when as_of < effective then 'not_yet_effective' end, case when as_of >= expiry then 'expired' end], lambda x: x is not null) as reasons from p)
select page_id, reasons, len(reasons) = 0 as accepted from r
""")
def validity_reasons(spark, sf_dir):
    k = F.col("page_id")
    pick = F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (k % 3).cast("int"))
    start = F.lit("2024-01-01").cast("date")
    p = read_table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("src"), (k % 5).cast("string")).alias("source_status"),
        pick.alias("legal_status"),
        F.when(k % 4 != 0, F.date_add(start, (k % 60).cast("int"))).alias("effective"),
        F.when(k % 6 == 0, F.lit("2024-01-31").cast("date")).alias("expiry"),
        F.when(k % 9 != 0, F.lit("2024-01-31").cast("date")).alias("as_of"),
        F.when(k % 8 == 0, "case").otherwise("statute").alias("kind"),
    )
    why = validity.reasons(*[F.col(c) for c in ("kind", "url", "source_status", "legal_status", "effective", "expiry", "as_of")], **_RULES)
    return p.select("page_id", why.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


@query("""
with o as (select doc_id, quality, case when doc_id % 4 = 0 then 'approved' when doc_id % 4 = 1 then 'rejected' else 'pending' end as status from labels where quality is not null)
select d.doc_id, case when o.status = 'approved' then 1 - o.quality else o.quality end as label from documents d join o using (doc_id)
""")
def label_overrides(spark, sf_dir):
    base = read_table(spark, sf_dir, "labels").where("quality is not null")
    status = F.when(F.col("doc_id") % 4 == 0, "approved").when(F.col("doc_id") % 4 == 1, "rejected").otherwise("pending")
    overrides = base.select("doc_id", status.alias("status"), F.array("quality").alias("original_accusations"), F.array(1 - F.col("quality")).alias("corrected_accusations"))
    cases = read_table(spark, sf_dir, "documents").join(base, "doc_id").select("doc_id", F.array("quality").alias("accusations"))
    return quality.apply_overrides(cases, overrides, "doc_id").select("doc_id", F.get("accusations", F.lit(0)).alias("label"))


@query("""
with o as (select doc_id * 2 as doc_id, case when doc_id % 4 = 0 then 'approved' when doc_id % 4 = 1 then 'rejected' else 'pending' end as status from labels)
select status, count(*) as overrides, count(*) filter (doc_id not in (select doc_id from documents)) as missing_cases from o group by status
""")
def override_audit(spark, sf_dir):
    status = F.when(F.col("doc_id") % 4 == 0, "approved").when(F.col("doc_id") % 4 == 1, "rejected").otherwise("pending")
    overrides = read_table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), status.alias("status"))
    return quality.override_audit(read_table(spark, sf_dir, "documents"), overrides, "doc_id")


def _users(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))


@query()
def stratified_split(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("labels"))
    return split.stratified_split(docs, "doc_id", "labels", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query()
def coverage_subset(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("labels"))
    return split.coverage_subset(docs, "doc_id", "labels", 100).select("doc_id")


@query("""
with d as (select doc_id, length(text)::bigint as n, len(list_filter([512, 1024, 2048, 4096], lambda e: e <= length(text))) as bucket from documents)
select bucket::int as bucket, count(*) as rows, ceil(count(*) / 16)::bigint as batches, max(n) as longest from d group by bucket
""")
def length_buckets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    batches = split.length_buckets(docs, "doc_id", "n", [512, 1024, 2048, 4096], 16)
    return batches.groupBy("bucket").agg(F.count("*").alias("rows"), F.count_distinct("batch").alias("batches"), F.max("n").alias("longest"))


@query("""
with d as (select doc_id, greatest(1, coalesce(length(text), 0)) as n from documents),
b as (select doc_id, len(list_filter([512, 1024, 2048, 4096], lambda e: e <= n)) as bucket, ('0x' || substr(md5(':' || doc_id || ':43'), 1, 15))::bigint as h from d),
r as (select *, row_number() over (partition by bucket order by h, doc_id) - 1 as k, count(*) over (partition by bucket) as m from b),
f as (select doc_id, bucket, k // 16 as i, k % 16 as place from r where k < m - m % 16),
g as (select doc_id, row_number() over (order by ('0x' || substr(md5('rest:' || doc_id || ':43'), 1, 15))::bigint, doc_id) - 1 as k from r where k >= m - m % 16),
u as (select * from f union all select doc_id, -1, k // 16, k % 16 from g),
o as (select bucket, i, count(*) as rows, row_number() over (order by ('0x' || substr(md5('batch:' || bucket || '/' || i || ':43'), 1, 15))::bigint, bucket, i) - 1 as batch from u group by bucket, i)
select doc_id, u.bucket::int as bucket, batch, place, rows, rows / 16 as loss_scale from u join o using (bucket, i)
""")
def token_bucket_batches(spark, sf_dir):
    """The second epoch's batch of each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n"))
    return split.token_batches(docs, "doc_id", "n", [512, 1024, 2048, 4096], 16, epoch=1).drop("n")


@query("""
with d as (select least(length(text), 2048) as n, row_number() over (order by length(text), doc_id) - 1 as k from documents), b as (select k // 4 as b, sum(n) as used, count(*) as rows, max(n) as longest from d group by 1)
select count(*) as batches, sum(used)::bigint as used, sum(rows * least(ceil(longest / 8) * 8, 2048))::bigint as padded, round(1 - sum(used) / sum(rows * least(ceil(longest / 8) * 8, 2048)), 6) as padding_ratio from b
""")
def padding_stats(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return stats.padding(docs, "n", 4).withColumn("padding_ratio", F.round("padding_ratio", 6))


@query("""
with l as (select l_orderkey, l_linenumber, case when l_extendedprice < 20000 then null else l_extendedprice end as amount, case when l_returnflag = 'A' then 'zero' when l_returnflag = 'N' then 'positive' else 'missing' end as status from lineitem),
v as (select unnest(list_filter([case when status = 'positive' and coalesce(amount, 0) <= 0 then 'positive_fine_without_amount' end, case when status = 'zero' and coalesce(amount, -1) <> 0 then 'zero_fine_with_amount' end,
  case when status not in ('positive', 'zero') and amount is not null then 'amount_without_fine' end], lambda x: x is not null)) as rule from l)
select rule, count(*) as n from v group by rule
""")
def contract_violations(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "zero").when(F.col("l_returnflag") == "N", "positive").otherwise("missing")
    amount = F.when(F.col("l_extendedprice") >= 20000, F.col("l_extendedprice"))
    l = read_table(spark, sf_dir, "lineitem").select(status.alias("status"), amount.alias("amount"))
    broken = quality.violations(quality.fine_contract(F.col("status"), F.col("amount")))
    return l.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
with e as (select user_id, count(*) filter (event_type = 'purchase') > 0 as bought, count(*) filter (event_type = 'view') > 0 as viewed, sum(value) > 1000 as spent from events group by user_id)
select user_id, bought and viewed and spent as passed, list_filter([case when not bought then 'bought' end, case when not viewed then 'viewed' end, case when not spent then 'spent' end], lambda x: x is not null) as blocking_reasons from e
""")
def firewall(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("bought"), (F.count_if(F.col("event_type") == "view") > 0).alias("viewed"), (F.sum("value") > 1000).alias("spent"))
    return e.select("user_id", quality.firewall([(c, F.col(c)) for c in ("bought", "viewed", "spent")]).alias("f")).select("user_id", "f.passed", "f.blocking_reasons")
