"""Queries of chunks, pages, citations, grounding and chat records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import chunking, features, repair, rules, text
from sievework.operators import answers, grounding
from sievework.session import read_table, spread
from sievework.sources import html, statutes

from .registry import query


@query()
def chunks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunks(docs, "doc_id", "text", ends=".!?;\n").drop("text")


@query()
def html_visible_text(spark, sf_dir):
    pages = html.visible_text(read_table(spark, sf_dir, "pages"), "page_id", "html")
    return pages.select("page_id", F.sha2("visible", 256).alias("visible_sha256"), F.length("visible").alias("n_chars"))


@query("""
with s as (select doc_id, string_split(regexp_replace(text, '([.!?;])', '\\1' || chr(1), 'g'), chr(1)) as p from documents),
k as (select doc_id, list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '')[1:3] as key_facts from s)
select doc_id, md5(array_to_string(key_facts, '|')) as facts_md5, len(key_facts)::int as n_facts from k
""")
def key_facts(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", text.key_sentences(F.col("text"), ".!?;", 3).alias("k"))
    return d.select("doc_id", F.md5(F.array_join("k", "|")).alias("facts_md5"), F.size("k").alias("n_facts"))


@query("""
with c as (select o_orderkey, list_distinct(list(l_suppkey % 7)) as cited from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey), k as (select *, [0, 1, 2, 3, o_orderkey % 7] as known from c)
select o_orderkey, list_sort(list_filter(cited, lambda x: not list_contains(known, x))) as unknown, len(list_filter(cited, lambda x: not list_contains(known, x))) = 0 as valid from k
""")
def citation_validation(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("cited"))
    known = F.array(*[F.lit(x).cast("long") for x in range(4)], F.col("o_orderkey") % 7)
    return c.select("o_orderkey", grounding.citation_check(F.col("cited"), known).alias("c")).select("o_orderkey", "c.unknown", "c.valid")


@query("""
with c as (select l_orderkey as request, case when l_linenumber % 2 = 1 then 'legal_basis' else 'analogous_cases' end as section, l_partkey % 20 as evidence_id from lineitem),
g as (select distinct l_orderkey as request, l_partkey % 20 as evidence_id from lineitem where l_partkey % 20 <> 7),
k as (select *, case when evidence_id % 3 = 0 then 'case' else 'statute' end as kind, case when evidence_id % 5 = 0 then 1 else 0 end as bad from g),
m as (select c.*, kind, bad, kind is null as u, (section = 'legal_basis' and kind <> 'statute') or (section = 'analogous_cases' and kind <> 'case') as w, section = 'legal_basis' and kind = 'statute' and bad = 1 as i from c left join k using (request, evidence_id)),
r as (select request, coalesce(list_sort(list_distinct(list(evidence_id) filter (u))), []) as unknown, coalesce(list_sort(list_distinct(list(evidence_id) filter (w))), []) as wrong_type, coalesce(list_sort(list_distinct(list(evidence_id) filter (i))), []) as not_applicable, not bool_or(section = 'legal_basis') as missing_legal_basis from m group by request)
select *, len(unknown) + len(wrong_type) + len(not_applicable) = 0 and not missing_legal_basis as valid from r
""")
def grounding_report(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    claims = rows.select(F.col("l_orderkey").alias("request"), F.when(F.col("l_linenumber") % 2 == 1, "legal_basis").otherwise("analogous_cases").alias("section"), (F.col("l_partkey") % 20).alias("evidence_id"))
    kind = F.when(F.col("evidence_id") % 3 == 0, "case").otherwise("statute")
    bad = F.array_compact(F.array(F.when(F.col("evidence_id") % 5 == 0, F.lit("expired"))))
    catalog = claims.select("request", "evidence_id").distinct().where("evidence_id <> 7").select("request", "evidence_id", kind.alias("kind"), bad.alias("reasons"))
    return grounding.grounding_report(claims, catalog)


@query("""
select page_id, substr(sha256('2024-01-31' || chr(0) || url), 1, 16) as request_id from pages
""")
def evidence_request_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", grounding.request_id(F.lit("2024-01-31"), F.col("url")).alias("request_id"))


@query(f"""
with r as (select doc_id, trim(regexp_replace(regexp_replace(text, '{rules.PRIVACY[0][1]}', '[EMAIL_REDACTED]', 'g'), '\\s+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) > 360 then substr(t, 1, 360) || '…' else t end as shown from r
""")
def safe_evidence(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", grounding.safe_evidence(F.lit("case"), F.col("text"), pack=rules.PRIVACY[:1])["text"].alias("shown"))


@query("""
select conv_id, list(case when role = 'assistant' then 'A' when role = 'user' then 'U' else 'S' end order by turn) as roles, md5(string_agg(text, chr(10) order by turn)) as text_md5, count(*) filter (role = 'assistant') as targets
from conversations group by conv_id having bool_or(role = 'user')
""")
def sft_messages(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(turns.alias("t"), F.count_if(F.col("role") == "assistant").alias("targets")).where(F.exists("t", lambda x: x["role"] == "user"))
    short = F.transform("t", lambda x: F.upper(F.substring(x["role"], 1, 1)))
    return g.select("conv_id", short.alias("roles"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text_md5"), "targets")


@query("""
select doc_id, 'sft-' || doc_id as record_id, sha256(text) as fact_sha256, length(text) >= 1120 as requires_manual_review from documents
""")
def sft_targets(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    r = grounding.tuning_record(F.col("doc_id"), F.col("text"), F.array("lang"), "Name the language.", ends=".!?;")
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.record_id", "r.fact_sha256", "r.requires_manual_review")


@query("""
with f as (select event_id, event_type, value, case when value > 90 then 'large' end as a, case when event_type = 'error' then 'error' end as b, case when user_id % 10 = 0 then 'tenth' end as c from events)
select reason, count(*) as n from (select unnest(list_distinct(list_filter([a, b, c], lambda x: x is not null))) as reason from f) group by reason
""")
def failure_reasons(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    why = F.array_compact(F.array(F.when(F.col("value") > 90, F.lit("large")), F.when(F.col("event_type") == "error", F.lit("error")), F.when(F.col("user_id") % 10 == 0, F.lit("tenth"))))
    return grounding.failure_reasons(e.select(why.alias("r")), "r")


@query("""
with p as (select p_partkey, '```json\n{"predicted_accusations": "' || p_brand || '罪", "置信度": "高", "key_facts": ["' || p_type || '"], "other": 1}\n``` and more' as raw, p_brand, p_type from part)
select p_partkey, p_brand as label, p_type as fact, 'high' as confidence, true as requires_manual_review from p
""")
def repaired_outputs(spark, sf_dir):
    raw = F.concat(F.lit('```json\n{"predicted_accusations": "'), "p_brand", F.lit('罪", "置信度": "高", "key_facts": ["'), "p_type", F.lit('"], "other": 1}\n``` and more'))
    schema = "candidate_accusations array<string>, key_facts array<string>, confidence string, requires_manual_review boolean"
    fixed = read_table(spark, sf_dir, "part").select("p_partkey", F.from_json(repair.canonicalize_output(raw), schema).alias("v"))
    return fixed.select("p_partkey", F.get("v.candidate_accusations", F.lit(0)).alias("label"), F.get("v.key_facts", F.lit(0)).alias("fact"), "v.confidence", "v.requires_manual_review")


@query("""
with d as (select doc_id, length(text) as n, doc_id % 5 as y from documents), p as (select a.doc_id, 0.45 * 0.5 + 0.45 * exp(-abs(ln(1 + a.n) - ln(1 + b.n))) + 0.10 * exp(-abs(a.y - b.y) / 5.0) as s from d a join d b on b.doc_id = a.doc_id + 1)
select doc_id, round(s, 6) as similarity from p
""")
def structured_similarity(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), (F.col("doc_id") % 5).alias("y"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("n2"), F.col("y").alias("y2"))
    none = F.array().cast("array<string>")
    s = features.structured_similarity(none, none, F.col("n"), F.col("n2"), F.col("y"), F.col("y2"))
    return d.join(b, "doc_id").select("doc_id", F.round(s, 6).alias("similarity"))


@query()
def statute_articles(spark, sf_dir):
    """Articles of a text made of part names: numbers in Chinese numerals, the longest body of each."""
    made = read_table(spark, sf_dir, "part").select(F.concat(F.lit("第"), F.get(F.array(*[F.lit(x) for x in ("一", "二", "十", "二十一", "一百零二")]), (F.col("p_partkey") % 5).cast("int")), F.lit("条 "), "p_name", F.lit(" ")).alias("line"), "p_partkey")
    return statutes.articles(made, "line", order=F.col("p_partkey"))


# Answers by the part's key modulo 8: full, simplified, in other words, cut off, without JSON, not readable, of a wrong type, and fenced with numbers as text.
_SHAPES = [
    '{"predicted_accusations": ["%b"], "relevant_articles": [%a], "similar_cases": [{"case_id": "%c", "reason": "alike"}], "analysis": "%t", "confidence": "high", "requires_manual_review": true}',
    '{"candidate_accusations": ["%b", "%b", "unheard of"], "key_facts": ["%t"], "confidence": "low", "requires_manual_review": "no"}',
    'Thus: {"预测罪名": "%b罪", "置信度": "高", "是否需要人工复核": "否"} as asked',
    '{"predicted_accusations": ["%b"], "analysis": "%t',
    'I can not say, %t.',
    '{"predicted_accusations": [%b], "analysis": "%t"}',
    '{"predicted_accusations": ["%b"], "key_facts": "%t", "analysis": "x", "confidence": "sure", "requires_manual_review": true, "extra": 1}',
    '<think>{"a": 1}</think>```json\n{"predicted_accusations": ["%b"], "relevant_articles": ["%a"], "similar_cases": [], "analysis": "%t", "confidence": "medium", "requires_manual_review": 0}\n```',
]


def _answers(spark, sf_dir):
    """Answers, right labels and what was retrieved, made from the parts."""
    label = F.when(F.col("p_partkey") % 3 == 0, "Brand#11").otherwise(F.col("p_brand"))
    shape = F.get(F.array(*[F.lit(x) for x in _SHAPES]), (F.col("p_partkey") % 8).cast("int"))
    for mark, value in (("%b", label), ("%t", F.col("p_type")), ("%a", (F.col("p_partkey") % 5).cast("string")), ("%c", (F.col("p_partkey") % 7).cast("string"))):
        shape = F.replace(shape, F.lit(mark), value)
    made = spread(read_table(spark, sf_dir, "part")).select("p_partkey", "p_type", F.array("p_brand").alias("gold"), shape.alias("output"), F.array(*[F.lit(str(x)) for x in range(4)]).alias("cases"), F.array(*[F.lit(x).cast("long") for x in range(3)]).alias("articles"))
    return answers.parsed(made, "output")


_ANSWERS_SQL = """m as (select p_partkey as k, p_type, p_brand as gold, p_partkey % 8 as s, case when p_partkey % 3 = 0 then 'Brand#11' else p_brand end as label from part),
a as (select *, s in (0, 7) as full_ok, s = 1 as simplified_ok, s in (0, 1, 2, 6, 7) as repaired_ok, s in (0, 1, 2, 6, 7) as readable from m)"""


@query(f"""with {_ANSWERS_SQL}
select k as p_partkey, readable, full_ok, simplified_ok, repaired_ok, case when repaired_ok then label end as label, case when repaired_ok then case s when 0 then 'high' when 2 then 'high' when 7 then 'medium' else 'low' end end as confidence,
  case s when 0 then '' when 1 then 'analysis:missing|extra:candidate_accusations' when 2 then 'analysis:missing|confidence:missing|requires_manual_review:missing|extra:是否需要人工复核|extra:置信度|extra:预测罪名'
    when 6 then 'key_facts:type|confidence:value|extra:extra' when 7 then '' else 'not_an_object' end as full_faults, case when full_ok then [k % 5] end as articles from a""")
def answer_faults(spark, sf_dir):
    """What is wrong with each answer under the full schema, and what repair makes of it."""
    rows = _answers(spark, sf_dir)
    ok = {f"{form}_ok": F.size(f"{form}.faults") == 0 for form in ("full", "simplified", "repaired")}
    return rows.select("p_partkey", "readable", *[c.alias(k) for k, c in ok.items()], F.get("repaired.candidate_accusations", F.lit(0)).alias("label"), F.col("repaired.confidence").alias("confidence"), F.array_join("full.faults", "|").alias("full_faults"), F.col("full.relevant_articles").alias("articles"))


@query(f"""with {_ANSWERS_SQL},
c as (select *, case when gold <> 'Brand#25' then 1 else 0 end as g, case when label <> 'Brand#25' then 1 else 0 end as t, case when gold = label and gold <> 'Brand#25' then 1 else 0 end as tp,
  case when s = 0 and k % 7 > 3 then 1 else 0 end + case when full_ok and k % 5 > 2 then 1 else 0 end as bad from a),
r as (select p_type, count(*) as rows, avg(readable::int) as json_rate, avg(full_ok::int) as full_schema_rate, avg(simplified_ok::int) as simplified_schema_rate, avg(repaired_ok::int) as repaired_schema_rate,
  coalesce(2.0 * sum(tp * full_ok::int) / nullif(sum(g + t * full_ok::int), 0), 0) as full_micro_f1, coalesce(2.0 * sum(tp * simplified_ok::int) / nullif(sum(g + t * simplified_ok::int), 0), 0) as simplified_micro_f1,
  coalesce(2.0 * sum(tp * repaired_ok::int) / nullif(sum(g + t * repaired_ok::int), 0), 0) as repaired_micro_f1, avg((full_ok and bad = 0)::int) as grounded_rate, sum(bad)::bigint as unsupported_citations,
  count(*) filter (not readable) as no_or_truncated_json, count(*) filter (s = 5) as unreadable_json, count(*) filter (not full_ok) as full_schema_invalid, count(*) filter (not simplified_ok) as simplified_schema_invalid from c group by p_type)
select * replace (round(json_rate, 6) as json_rate, round(full_schema_rate, 6) as full_schema_rate, round(simplified_schema_rate, 6) as simplified_schema_rate, round(repaired_schema_rate, 6) as repaired_schema_rate,
  round(full_micro_f1, 6)::double as full_micro_f1, round(simplified_micro_f1, 6)::double as simplified_micro_f1, round(repaired_micro_f1, 6)::double as repaired_micro_f1, round(grounded_rate, 6) as grounded_rate) from r""")
def answer_evaluation(spark, sf_dir):
    """Metrics of answers by type of part; one brand is no known label."""
    known = F.array(*[F.lit(f"Brand#{x}") for x in range(1, 100) if x != 25])
    return answers.evaluation(_answers(spark, sf_dir), "gold", known, "cases", "articles", ["p_type"])


@query("""
with t as (select doc_id, coalesce(text, '') || ' [case-' || doc_id || '] so [' || coalesce(source, 'none') || ':c' || doc_id % 3 || '], [no citation], [case-' || doc_id || ']' as text, ['case-' || (doc_id - doc_id % 2), coalesce(source, 'none') || ':c0'] as known from documents),
c as (select doc_id, known, list_sort(list_distinct(regexp_extract_all(text, '\\[(case-[^\\]]+|[^:\\]]+:c\\d+)\\]', 1))) as cited from t),
u as (select doc_id, cited, list_sort(list_filter(cited, lambda x: not list_contains(known, x))) as unknown, list_sort(list_filter(known, lambda x: not list_contains(cited, x))) as uncited from c)
select doc_id, cited, unknown, uncited, len(unknown) = 0 and len(cited) > 0 as valid from u
""")
def text_citations(spark, sf_dir):
    """Citations found in whole texts, to each of which some are added."""
    source = F.coalesce("source", F.lit("none"))
    case = F.concat(F.lit("[case-"), "doc_id", F.lit("]"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), case, F.lit(" so ["), source, F.lit(":c"), F.col("doc_id") % 3, F.lit("], [no citation], "), case)
    known = F.array(F.concat(F.lit("case-"), F.col("doc_id") - F.col("doc_id") % 2), F.concat(source, F.lit(":c0")))
    r = spread(read_table(spark, sf_dir, "documents")).select("doc_id", grounding.citation_report(text, known).alias("r"))
    return r.select("doc_id", "r.cited", "r.unknown", "r.uncited", "r.valid")
