"""Queries over the corpus: statistics, filters, redaction, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import money, redaction, rules, text
from sievework.operators import dedup, knowledge, quality, stats
from sievework.session import read_table, spread
from sievework.sources.files import fresh_path

from .registry import query

_PRIVACY = dict(rules.PRIVACY)
_SHORT, _LOW_CHARS = 80, 400
_LOW_PATTERNS = [r"(?i)all rights reserved", r"(?i)the .* the .* the"]


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query("""
with p as (select unnest([0.25, 0.5, 0.9, 0.99]::double[]) as p), s as (select lang, list_sort(list(length(text))) as v, count(*) as n from documents where text is not null group by lang)
select lang, p, v[floor((n - 1) * p)::bigint + 1]::bigint as value from s, p
""")
def length_stats_by_lang(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.length("text").cast("long").alias("n"))
    return stats.floor_percentiles(d, ["lang"], "n", [0.25, 0.5, 0.9, 0.99])


@query("""
select lang, count(text) as rows, t.threshold::bigint as threshold, count(*) filter (length(text) > t.threshold) as over, round(count(*) filter (length(text) > t.threshold) / count(text), 6) as fraction
from documents, (values (512), (1024), (2048), (4096)) t(threshold) group by lang, t.threshold
""")
def exceedance_fractions(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.length("text").alias("n"))
    return stats.exceedance(d, "n", [512, 1024, 2048, 4096], ["lang"]).withColumn("fraction", F.round("fraction", 6))


@query("""
with h as (select source, sha256(text) as h, count(*) as n from documents group by all)
select source, sum(n)::bigint as rows, count(*) as distinct_texts, (sum(n) - count(*))::bigint as duplicates, max(n) as largest_group from h group by source
""")
def exact_dup_report(spark, sf_dir):
    return stats.duplicate_count(_docs(spark, sf_dir), text.exact_fingerprint(F.col("text")), ["source"])


@query(r"""
with k as (select doc_id, 'DG-' || substr(sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')), 1, 20) as group_id from documents)
select group_id, count(*) as n, min(doc_id) as first_doc from k group by group_id having count(*) > 1
""")
def normalized_dup_groups(spark, sf_dir):
    d = spread(_docs(spark, sf_dir)).select("doc_id", text.duplicate_group_id(F.col("text")).alias("group_id"))
    return d.groupBy("group_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(r"""
select doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))) as fingerprint from documents
""")
def normalized_fingerprints(spark, sf_dir):
    d = spread(_docs(spark, sf_dir))
    return d.select("doc_id", text.exact_fingerprint(text.normalize_text(F.col("text"))).alias("fingerprint"))


def _quality_rules():
    low = redaction.is_low_information(F.col("text"), _LOW_PATTERNS, _LOW_CHARS)
    return [("empty", F.coalesce(F.trim("text"), F.lit("")) == ""), ("short", F.length(F.trim("text")) < _SHORT), ("low_information", low)]


@query(f"""
with r as (select lang, case when trim(coalesce(text, '')) = '' then 'empty' when length(trim(text)) < {_SHORT} then 'short'
  when length(regexp_replace(text, '\\s+', '', 'g')) <= {_LOW_CHARS} and (regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '{_LOW_PATTERNS[0]}') or regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '{_LOW_PATTERNS[1]}')) then 'low_information' end as reason from documents)
select reason, count(*) as n from r where reason is not null group by reason
""")
def quality_filter_reasons(spark, sf_dir):
    return quality.filter_with_reasons(spread(_docs(spark, sf_dir)), _quality_rules())[1]


@query("select source, " + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::bigint as {n}" for n, p in rules.PRIVACY) + " from documents group by source")
def privacy_scan(spark, sf_dir):
    d = spread(_docs(spark, sf_dir)).select("source", redaction.scan(F.col("text"), rules.PRIVACY).alias("c"))
    return d.groupBy("source").agg(*[F.sum(F.col("c")[n]).alias(n) for n, _ in rules.PRIVACY])


def _nested_sql(column, pack, mark):
    for n, p in pack:
        column = f"regexp_replace({column}, '{p}', '{mark(n)}', 'g')"
    return column


@query(f"select doc_id, sha256(r) as redacted_sha256, length(r)::bigint as n_chars, r <> text as redacted from (select doc_id, text, {_nested_sql('text', rules.PRIVACY, lambda n: f'[{n.upper()}_REDACTED]')} as r from documents)")
def privacy_redact(spark, sf_dir):
    d = spread(_docs(spark, sf_dir)).select("doc_id", "text", redaction.redact(F.col("text"), rules.PRIVACY).alias("r"))
    return d.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.length("r").cast("long").alias("n_chars"), (F.col("r") != F.col("text")).alias("redacted"))


_LEAK_SQL = _nested_sql("text", rules.LEAKAGE, lambda n: rules.LEAKAGE_MASK)


@query(f"select doc_id, md5(trim(regexp_replace({_LEAK_SQL}, '(?:\\[MASKED\\]\\s*){{2,}}', '[MASKED]', 'g'))) as text_md5, regexp_matches({_LEAK_SQL}, '\\[MASKED\\]') as removed from documents")
def leakage_mask(spark, sf_dir):
    d = spread(_docs(spark, sf_dir)).select("doc_id", redaction.mask_leakage(F.col("text"), rules.LEAKAGE, rules.LEAKAGE_MASK).alias("m"))
    return d.select("doc_id", F.md5("m.text").alias("text_md5"), F.col("m.removed").alias("removed"))


@query("""
with s as (select doc_id, string_split(regexp_replace(trim(text), '([.;!?])', '\\1' || chr(1), 'g'), chr(1)) as parts from documents)
select doc_id, md5(trim(array_to_string(list_filter(parts, lambda x: not regexp_matches(x, '[Aa]ll rights reserved|[Ll]icen[sc]e[d]?|[Cc]opyright')), ''))) as text_md5,
  len(list_filter(parts, lambda x: regexp_matches(x, '[Aa]ll rights reserved|[Ll]icen[sc]e[d]?|[Cc]opyright')))::int as dropped from s
""")
def leakage_sentence_drop(spark, sf_dir):
    d = spread(_docs(spark, sf_dir))
    clean = redaction.drop_leaking_sentences(F.col("text"), rules.LEAKAGE, None, rules.SENTENCE_ENDS)
    hit = "|".join(p for _, p in rules.LEAKAGE)
    dropped = F.size(F.filter(redaction.sentences(F.trim("text"), rules.SENTENCE_ENDS), lambda s: s.rlike(hit)))
    return d.select("doc_id", F.md5(clean).alias("text_md5"), dropped.alias("dropped"))


@query("select event_type as label, count(distinct user_id) as support, dense_rank() over (order by event_type)::int - 1 as label_id from events group by event_type")
def label_support(spark, sf_dir):
    users = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    support = stats.label_support(users, "labels")
    return support.join(stats.label_ids(support), "label")


@query("""
with d as (select d.source as split, d.lang, length(d.text) as n, l.quality, l.toxic from documents d left join labels l using (doc_id))
select split, count(*) as rows, count(*) filter (quality = 1 and toxic = 1) as multi_label, count(distinct lang) as labels_present, count(quality) as labelled, count(*) - count(quality) as unlabelled,
  count(*) filter (toxic = 0) as toxic_zero, max(n)::bigint as longest, min(n)::bigint as shortest, list_sort(list(n))[floor((count(n) - 1) * 0.5)::bigint + 1]::bigint as p50 from d group by split
""")
def split_statistics(spark, sf_dir):
    d = _docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("n", F.length("text").cast("long"))
    counts = d.groupBy(F.col("source").alias("split")).agg(
        F.count("*").alias("rows"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("multi_label"),
        F.count_distinct("lang").alias("labels_present"),
        F.count("quality").alias("labelled"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
        F.count_if(F.col("toxic") == 0).alias("toxic_zero"),
        F.max("n").alias("longest"),
        F.min("n").alias("shortest"),
    )
    middle = stats.floor_percentiles(d.withColumnRenamed("source", "split"), ["split"], "n", [0.5]).select("split", F.col("value").alias("p50"))
    return counts.join(middle, "split")


@query("""
with s as (select p_brand, count(*) as support from part group by p_brand), l as (select list_sort(list(support)) as v, count(*) as n from s), q as (select unnest([0.25, 0.5, 0.75]::double[]) as q)
select q, v[greatest(0, floor(n * q)::bigint - 1) + 1] as cut from l, q
""")
def frequency_bands(spark, sf_dir):
    brands = read_table(spark, sf_dir, "part").select(F.array("p_brand").alias("labels"))
    return stats.frequency_band_edges(stats.label_support(brands, "labels"))


@query("""
with c as (select l_suppkey, l_returnflag, l_linestatus, count(*) as n from lineitem group by all)
select l_suppkey, l_returnflag, l_linestatus, n, count(*) over (partition by l_suppkey) > 1 as conflict from c
qualify row_number() over (partition by l_suppkey order by n desc, l_returnflag || '|' || l_linestatus) = 1
""")
def modal_outcome(spark, sf_dir):
    return stats.modal_value(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("""
with d as (select md5(d.text) as key, doc_id, text, case when quality is null then [] else [quality] end as labels from documents d left join labels using (doc_id))
select key, md5(arg_min(text, doc_id)) as text_md5, min(doc_id) as doc_id, list_sort(list_distinct(flatten(list(labels)))) as labels, count(*) as merged, count(distinct labels) > 1 as label_conflict from d group by key
""")
def merge_duplicates(spark, sf_dir):
    labels = F.when(F.col("quality").isNull(), F.array().cast("array<int>")).otherwise(F.array("quality"))
    d = _docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id", "left").select(F.md5("text").alias("key"), "doc_id", "text", labels.alias("labels"))
    merged = stats.merge_duplicates(d, "key", "doc_id", "text", "labels")
    return merged.withColumn("text_md5", F.md5("text")).drop("text")


@query("""
with u as (select user_id, list_distinct(list(event_type)) as labels from events group by user_id),
r as (select user_id // 65536 as r, sha256(string_agg(user_id::varchar, ',' order by user_id)) as d from u group by 1)
select count(*) as rows, count(*) filter (len(labels) > 1) as multi_label_rows, len(list_distinct(flatten(list(labels))))::int as labels_present,
  list_filter(list_sort(list_append((select list(distinct event_type) from events), 'never')), lambda x: not list_contains(flatten(list(labels)), x)) as labels_missing, (select sha256(string_agg(d, ',' order by r)) from r) as ids_sha256 from u
""")
def subset_report(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    known = sorted(r[0] for r in events.select("event_type").distinct().collect())
    return stats.subset_report(users, "user_id", "labels", [*known, "never"])


@query("select array_to_string(list_sort(json_keys(props)), ',') as keys, count(*) as n from events group by 1")
def schema_audit(spark, sf_dir):
    return stats.schema_variants(read_table(spark, sf_dir, "events"), "props")


@query("select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as total, count(props->>'$.missing') as missing_present from events group by event_type")
def json_props(spark, sf_dir):
    d = read_table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count("m").alias("missing_present"))


@query("""
select case when v is null then 'missing' when v < 0 then 'invalid' when v = 0 then 'zero' else 'positive' end as status, count(*) as n, sum(case when v >= 0 then v end)::bigint as total,
  count(*) filter (v >= 100000) as large from (select trunc(c_acctbal)::bigint as v from customer) group by 1
""")
def amount_status(spark, sf_dir):
    d = read_table(spark, sf_dir, "customer").select(money.parse_number(F.col("c_acctbal")).alias("a"))
    return d.groupBy(F.col("a.status").alias("status")).agg(F.count("*").alias("n"), F.sum("a.amount").alias("total"), F.count_if(F.col("a.amount") >= 100_000).alias("large"))


@query("""
with g as (select doc_id, unnest(case when length(c) = 0 then [] when length(c) <= 3 then [c] else list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) end) as gram from (select doc_id, regexp_replace(text, '\\s+', '', 'g') as c from documents)),
h as (select doc_id, ('0x' || substr(md5(gram), 1, 16))::ubigint as h from g),
v as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as s from h, (select unnest(range(64))::ubigint as b) group by doc_id, b),
t as (select doc_id, b, coalesce(s, 0) as s from (select doc_id from documents where text is not null) cross join (select unnest(range(64))::ubigint as b) left join v using (doc_id, b))
select doc_id, sum(case when s < 0 then 0 when b = 63 then -9223372036854775808 else 1::bigint << b::int end)::bigint as simhash from t group by doc_id
""")
def simhash_fingerprints(spark, sf_dir):
    return dedup.simhash(spread(_docs(spark, sf_dir)), "doc_id", F.col("text"))


@query("""
with g as (select doc_id, unnest(case when length(c) = 0 then [] when length(c) <= 3 then [c] else list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) end) as gram from (select doc_id, regexp_replace(text, '\\s+', '', 'g') as c from documents)),
h as (select doc_id, ('0x' || substr(md5(gram), 1, 16))::ubigint as h from g),
v as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as s from h, (select unnest(range(64))::ubigint as b) group by doc_id, b),
t as (select doc_id, b, coalesce(s, 0) as s from (select doc_id from documents where text is not null) cross join (select unnest(range(64))::ubigint as b) left join v using (doc_id, b)),
f as (select doc_id, sum(case when s < 0 then 0 when b = 63 then -9223372036854775808 else 1::bigint << b::int end)::bigint as x from t group by doc_id),
n as (select x, min(doc_id) as first from f group by x)
select least(a.first, b.first) as a, greatest(a.first, b.first) as b, bit_count(xor(a.x, b.x))::int as distance from n a join n b on a.x < b.x and bit_count(xor(a.x, b.x)) <= 3
union all select n.first, f.doc_id, 0 from f join n using (x) where f.doc_id <> n.first
""")
def near_duplicate_pairs(spark, sf_dir):
    return dedup.near_pairs(dedup.simhash(spread(_docs(spark, sf_dir)), "doc_id", F.col("text")), "doc_id")


@query("select doc_id, text_md5, doc_lang from (select min(doc_id) as doc_id, md5(text) as text_md5, arg_min(lang, doc_id) as doc_lang from documents group by text)")
def first_wins_dedup(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.md5("text").alias("text_md5"), "doc_id", F.col("lang").alias("doc_lang"))
    return dedup.first_wins(d, "text_md5", ["doc_id"])


@query("""
select doc_id::varchar as case_id, sha256(case when doc_id % 10 = 0 then coalesce(text, '') || ' (amended)' else coalesce(text, '') end) as content_sha256, doc_id % 10 = 0 as replaced from documents where doc_id % 17 <> 0
""")
def knowledge_build(spark, sf_dir):
    """A knowledge base of all documents, then of an edition in which some are changed and some are missing."""
    docs, root = read_table(spark, sf_dir, "documents"), fresh_path(spark, "knowledge")
    knowledge.build(docs, root, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    edition = docs.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(text, F.lit(" (amended)"))).otherwise(text).alias("text"))
    last = knowledge.build(edition, root, "doc_id", "text")
    return knowledge.documents(spark, root).select("case_id", "content_sha256", (F.col("segment") == last["version"]).alias("replaced"))
