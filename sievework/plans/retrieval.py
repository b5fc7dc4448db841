"""Queries of sparse, dense and hybrid retrieval; language stands for the label that gates a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import features, redaction, rules
from sievework.operators import bm25, dense, fusion, metrics, mining, partitioned, saved, tracing
from sievework.session import read_table, spread
from sievework.sources.files import fresh_path, stored

from . import registry
from .registry import query

_GRAMS = "case when length(c) = 0 then [] when length(c) <= 2 then [c] else list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) end"


def _bm25_sql(part: str = "''", every: bool = False) -> str:
    """Common table expressions up to scores(query, doc, part, score) of every part, with a query's strongest terms or with every one."""
    kept = "from m" if every else "from m where good or not any_good qualify row_number() over (partition by query, part order by weight desc, term) <= 64"
    return f"""
d as (select doc_id as doc, {part} as part, regexp_replace(text, '\\s+', '', 'g') as c from documents),
t as (select doc, part, g as term, count(*) as tf from (select doc, part, unnest({_GRAMS}) as g from d) group by all),
dl as (select doc, part, case when length(c) = 0 then 0 else greatest(length(c) - 1, 1) end as dl from d),
sz as (select part, count(*) as n, avg(dl) as avgdl from dl group by part),
q as (select item_id as query, g as term, count(*) as qtf from (select item_id, unnest({_GRAMS}) as g from (select item_id, regexp_replace(text, '\\s+', '', 'g') as c from benchmark)) group by all),
w as (select part, term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select part, term, count(*)::double as df from t group by all) join sz using (part)),
m as (select query, part, term, idf, round(idf * least(qtf, 3), 12) as weight, idf >= 0.2 as good, bool_or(idf >= 0.2) over (partition by query, part) as any_good from q join w using (term)),
k as (select query, part, term, weight {kept}),
s as (select query, doc, part, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))), 9) as score from t join k using (part, term) join dl using (doc, part) join sz using (part) group by all)"""


def _index(spark, sf_dir, part=None):
    return bm25.build(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", part)


def _ranked(spark, sf_dir, k, every=False):
    scored = bm25.best(_index(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), "item_id", "text", k, every=every)
    return bm25.top(scored, k).select("query", "doc", "score", "rank")


@query(f"with {_bm25_sql(every=True)} select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 3")
def bm25_topk(spark, sf_dir):
    """Every term of a query counts."""
    return _ranked(spark, sf_dir, 3, every=True).withColumn("score", F.round("score", 6))


@query(f"with {_bm25_sql()}, f as (select s.* from s join documents on doc_id = doc where lang = 'en') select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from f qualify row_number() over (partition by query order by score desc, doc) <= 3")
def bm25_filtered(spark, sf_dir):
    """Statistics of the whole corpus, hits of one label."""
    scored = bm25.best(_index(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), "item_id", "text", 3, where=F.col("lang") == "en")
    return bm25.top(scored, 3).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql('lang')} select query, part, doc, round(score, 6) as score, row_number() over (partition by query, part order by score desc, doc)::int as rank from s qualify row_number() over (partition by query, part order by score desc, doc) <= 2")
def bm25_partitioned(spark, sf_dir):
    """Statistics and hits of each label."""
    scored = bm25.best(_index(spark, sf_dir, "lang"), read_table(spark, sf_dir, "benchmark"), "item_id", "text", 2)
    return bm25.top(scored, 2, ["query", "part"]).select("query", "part", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_bm25_sql()}, r as (select part, term, ln(n - df + 0.5) - ln(df + 0.5) as idf from (select part, term, count(*)::double as df from t group by all) join sz using (part)),
o as (select term, case when idf < 0 then 0.25 * (select avg(idf) from r) else idf end as idf from r),
f as (select query, doc, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as x from t join q using (term) join o using (term) join dl using (doc, part) join sz using (part) group by all),
e as (select b.item_id as query, d.doc, round(coalesce(x, 0.0), 9) as score from benchmark b cross join d left join f on f.query = b.item_id and f.doc = d.doc)
select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from e qualify row_number() over (partition by query order by score desc, doc) <= 3""")
def bm25_okapi(spark, sf_dir):
    best = bm25.okapi_top(_index(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), "item_id", "text", 3)
    return best.select("query", "doc", F.round("score", 6).alias("score"), "rank")


_V = "v as (select vec_id as doc, label, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 1.1920929e-07)) as e from embeddings)"
_DOT = "round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 9)"


def _dense(spark, sf_dir, k, gate=None):
    v = read_table(spark, sf_dir, "embeddings")
    return dense.search(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", k, gate)


@query(f"with {_V}, s as (select a.doc as query, b.doc, {_DOT} as score from v a join v b on a.doc % 50 = 0 and a.doc <> b.doc) select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 5")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query(f"with {_V}, s as (select a.doc as query, b.doc, {_DOT} as score from v a join v b on a.doc % 50 = 0 and a.doc <> b.doc and a.label = b.label) select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 5")
def dense_filtered(spark, sf_dir):
    return _dense(spark, sf_dir, 5, "label").withColumn("score", F.round("score", 6))


_LISTS_SQL = f"""{_bm25_sql()}, a as (select query, doc, row_number() over (partition by query order by score desc, doc) as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 20),
b as (select s.query, s.doc, row_number() over (partition by s.query order by score / sqrt(greatest(dl, 1)) desc, s.doc) as rank from s join dl using (doc) qualify row_number() over (partition by s.query order by round(score / sqrt(greatest(dl, 1)), 9) desc, s.doc) <= 20),
u as (select query, doc, rank from a union all select query, doc, rank from b),
f as (select query, doc, round(sum(1.0 / (60 + rank)), 9) as score from u group by all)"""


def _two_lists(spark, sf_dir):
    """The BM25 list, and a second one by score over the root of the length."""
    index, queries = _index(spark, sf_dir), read_table(spark, sf_dir, "benchmark")
    plain, short = (bm25.best(index, queries, "item_id", "text", 20, by_root=r) for r in (False, True))
    return {"bm25": bm25.top(plain, 20), "short": bm25.top(short, 20)}


@query(f"with {_LISTS_SQL} select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from f qualify row_number() over (partition by query order by score desc, doc) <= 5".replace("order by score / sqrt(greatest(dl, 1)) desc, s.doc) as rank", "order by round(score / sqrt(greatest(dl, 1)), 9) desc, s.doc) as rank"))
def rrf_fusion(spark, sf_dir):
    fused = fusion.reranked(fusion.reciprocal_rank(_two_lists(spark, sf_dir)), 5)
    return fused.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_bm25_sql()}, r as (select query, doc, row_number() over (partition by query order by score desc, doc) as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 30),
c as (select query, source as case_id, doc, rank from r join documents on doc_id = doc qualify row_number() over (partition by query, source order by rank) = 1)
select query, case_id, doc, row_number() over (partition by query order by rank)::int as rank from c qualify row_number() over (partition by query order by rank) <= 3""")
def case_dedup_topk(spark, sf_dir):
    cases = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("case_id"))
    ranked = _ranked(spark, sf_dir, 30).join(cases, "doc")
    return fusion.first_per_case(ranked, "case_id", 3).select("query", "case_id", "doc", "rank")


_FACTOR_SQL = "list_filter([" + ", ".join(f"case when regexp_matches({{c}}, '{p}') then '{n}' end" for n, p in rules.FACTORS) + "], lambda x: x is not null)"


def _factors(text):
    return redaction.tags(text, rules.FACTORS)


_PROFILE = "list_transform(['" + "', '".join("abcdefghijklmnopqrstuvwxyz") + "'], lambda x: (length(t) - length(replace(t, x, '')))::double)"
_UNIT = "list_transform(c, lambda x: x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1.1920929e-07))"
_HYBRID_SQL = f"""{_bm25_sql()}, lp as (select doc_id as doc, {_PROFILE} as c from (select doc_id, lower(text) as t from documents where text is not null)), lq as (select item_id as query, {_PROFILE} as c from (select item_id, lower(text) as t from benchmark)),
le as (select doc, {_UNIT} as e from lp), qe as (select query, {_UNIT} as e from lq), ds as (select query, doc, {_DOT} as score from qe a cross join le b),
u as (select query, doc, row_number() over (partition by query order by score desc, doc) as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 20
  union all select query, doc, row_number() over (partition by query order by score desc, doc) as rank from ds qualify row_number() over (partition by query order by score desc, doc) <= 20),
f as (select query, doc, round(sum(1.0 / (60 + rank)), 9) as score from u group by all)"""


@query(f"""with {_HYBRID_SQL},
g as (select query, doc, row_number() over (partition by query order by score desc, doc) as rank from f qualify row_number() over (partition by query order by score desc, doc) <= 20),
h as (select query, doc, source, {_FACTOR_SQL.format(c='b.text')} as qf, {_FACTOR_SQL.format(c='d.text')} as df from g join benchmark b on b.item_id = query join documents d on d.doc_id = doc),
x as (select query, doc, source, round(case when len(list_distinct(list_concat(qf, df))) = 0 then 0.5 else len(list_intersect(qf, df)) / len(list_distinct(list_concat(qf, df))) end, 9) as score from h),
first as (select * from x qualify row_number() over (partition by query, source order by score desc, doc) = 1)
select query, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from first qualify row_number() over (partition by query order by score desc, doc) <= 3""")
def hybrid_topk(spark, sf_dir):
    """A sparse and a dense list, reciprocal-rank fusion, a structured reranker and the best hit of each case; letter profiles stand for an encoder, sources for cases."""
    best, _ = _hybrid(spark, sf_dir)
    return best.select("query", "doc", F.round("score", 6).alias("score"), "rank")


def _hybrid(spark, sf_dir, keep=None):
    """Sources stand for cases."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("case_id"), F.col("text").alias("dt"))
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), _factors(F.col("text")).alias("qf"))

    def rerank(hits):
        # the fused list is written by now, so texts are met by it where they are read, and only theirs are searched for factors
        met = docs.join(hits, "doc").join(queries, "query").withColumn("df", _factors(F.col("dt"))).drop("dt")
        return met.withColumn("score", F.round(features.jaccard(F.col("qf"), F.col("df")), 9)).drop("qf", "df")

    profiles = [dense.letter_profiles(spread(read_table(spark, sf_dir, t)).select(F.col(k).alias("id"), "text")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    near = dense.search(stored(profiles[0], "profiles"), profiles[1], "id", "v", 20, others=False)
    keep = keep or (lambda stage, ranked: stored(ranked, stage) if stage == "fused" else ranked)
    return fusion.hybrid(_ranked(spark, sf_dir, 20), near, rerank, case="case_id", keep=keep)


def _place(stage, rows, score="score", by="query"):
    order = f"partition by {by} order by {score} desc, doc"
    return f"select '{stage}' as stage, query, doc, {score} as score, row_number() over ({order})::int as rank from {rows}"


@query(f"""with {_HYBRID_SQL},
l1 as ({_place('sparse', 's')} qualify rank <= 20), l2 as ({_place('dense', 'ds')} qualify rank <= 20), l3 as ({_place('fused', 'f')} qualify rank <= 50),
tg as (select query, d.doc_id as doc, source, {_FACTOR_SQL.format(c='b.text')} as qf, {_FACTOR_SQL.format(c='d.text')} as df from l3 join benchmark b on b.item_id = query join documents d on d.doc_id = doc where rank <= 20),
x as (select query, doc, source, round(case when len(list_distinct(list_concat(qf, df))) = 0 then 0.5 else len(list_intersect(qf, df)) / len(list_distinct(list_concat(qf, df))) end, 9) as score from tg),
l4 as ({_place('reranked', 'x').replace(' from x', ', source from x')}),
first as (select * from l4 qualify row_number() over (partition by query, source order by rank) = 1),
l5 as (select 'final' as stage, query, doc, score, row_number() over (partition by query order by rank)::int as rank from first qualify row_number() over (partition by query order by rank) <= 3),
e as (select * from l1 union all select * from l2 union all select * from l3 union all select stage, query, doc, score, rank from l4 union all select * from l5)
select stage, query, doc, rank, round(score, 6)::double as score from e""")
def hybrid_trace(spark, sf_dir):
    """Ranks of every stage of a hybrid search; sources stand for cases."""
    stages = tracing.Stages(spark, "hybrid")
    best, _ = _hybrid(spark, sf_dir, stages.keep)
    stages.keep("final", best)
    return stages.ranks().withColumn("score", F.round("score", 6))


@query(f"""with {_bm25_sql('lang')}, p as (select query, part, probability, quota from (select item_id as query from benchmark) cross join (values ('en', 0.7::double, 2), ('fr', 0.3::double, 1)) v(part, probability, quota)),
c as (select query, part, doc, score as bm25, probability, quota from s join p using (query, part) qualify row_number() over (partition by query, part order by score desc, doc) <= quota * 20),
z as (select c.*, {_FACTOR_SQL.format(c='b.text')} as qf, {_FACTOR_SQL.format(c='d.text')} as df from c join benchmark b on b.item_id = query join documents d on d.doc_id = doc),
y as (select *, 0.45 * case when len(list_distinct(list_concat(qf, df))) = 0 then 0.5 else len(list_intersect(qf, df)) / len(list_distinct(list_concat(qf, df))) end + 0.275 as structured from z),
x as (select query, part, doc, quota, round(least(1.0, 0.55 * greatest(0.0, bm25 / max(bm25) over (partition by query, part)) + 0.25 * probability / max(probability) over (partition by query) + 0.15 * structured + 0.0), 9) as score from y),
a as (select * from x where score >= 0.45 qualify row_number() over (partition by query, doc order by score desc, part) = 1),
e as (select * from a qualify row_number() over (partition by query, part order by score desc, doc) <= quota)
select query, part, doc, round(score, 6) as score, row_number() over (partition by query order by score desc, doc)::int as rank from e qualify row_number() over (partition by query order by score desc, doc) <= 3""")
def charge_partitioned_topk(spark, sf_dir):
    """Two predicted labels with quotas 2 and 1, structured reranking and a least score."""
    return _by_charge(spark, sf_dir, _index(spark, sf_dir, "lang"))


def _by_charge(spark, sf_dir, index):
    queries = read_table(spark, sf_dir, "benchmark")
    predicted = queries.select(F.col("item_id").alias("query"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(p).alias("probability")) for n, p in (("en", 0.7), ("fr", 0.3))])).alias("x")).select("query", "x.*")
    given = partitioned.quotas(predicted, 3)
    hits = partitioned.search(index, queries, "item_id", "text", given, 3)
    docs = spread(read_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), _factors(F.col("text")).alias("df"))
    asked = queries.select(F.col("item_id").alias("query"), _factors(F.col("text")).alias("qf"))
    none = F.lit(None).cast("double")
    similar = features.structured_similarity(F.col("qf"), F.col("df"), none, none, none, none)
    marked = hits.join(docs, "doc").join(asked, "query").withColumn("structured", similar).withColumn("cardinality_match", F.lit(0.0))
    return partitioned.selected(partitioned.rescored(marked)).select("query", "part", "doc", F.round("score", 6).alias("score"), "rank")


@query(registry.ORACLES["bm25_topk"])
def bm25_saved_index(spark, sf_dir):
    """bm25_topk from an index on disk."""
    root = fresh_path(spark, "sparse")
    saved.save_sparse(_index(spark, sf_dir), root)
    scored = bm25.best(saved.load_sparse(spark, root), read_table(spark, sf_dir, "benchmark"), "item_id", "text", 3, every=True)
    return bm25.top(scored, 3).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(registry.ORACLES["charge_partitioned_topk"])
def partitioned_saved_index(spark, sf_dir):
    """charge_partitioned_topk from an index on disk."""
    root = fresh_path(spark, "sparse")
    saved.save_sparse(_index(spark, sf_dir, "lang"), root)
    return _by_charge(spark, sf_dir, saved.load_sparse(spark, root))


@query(registry.ORACLES["dense_filtered"])
def dense_saved_index(spark, sf_dir):
    """dense_filtered from an index on disk."""
    v, root = read_table(spark, sf_dir, "embeddings"), fresh_path(spark, "dense")
    saved.save_dense(v, root, "vec_id", "embedding", "label")
    return saved.search_dense(spark, root, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, "label").withColumn("score", F.round("score", 6)).select("query", "doc", "score", "rank")


def _tag_sql(column):
    return "list_filter([" + ", ".join(f"case when regexp_matches({column}, '{p}') then '{n}' end" for n, p in rules.FACTORS) + "], lambda x: x is not null)"


def _hits_with_tags(spark, sf_dir, k):
    docs = spread(read_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), "lang", _factors(F.col("text")).alias("df"))
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), _factors(F.col("text")).alias("qf"))
    return _ranked(spark, sf_dir, k).join(docs, "doc").join(queries, "query")


_HITS_SQL = f"""{_bm25_sql()}, r as (select query, doc, score, row_number() over (partition by query order by score desc, doc)::int as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 20),
h as (select r.*, d.lang, {_tag_sql('b.text')} as qf, {_tag_sql('d.text')} as df from r join benchmark b on b.item_id = query join documents d on d.doc_id = doc)"""


@query(f"""with {_HITS_SQL}, g as (select *, lang = 'en' as positive, case when lang = 'en' and len(list_intersect(qf, df)) > 0 then 2 when lang = 'en' then 1 else 0 end as relevance from h)
select query, doc, rank, relevance::int as relevance from g qualify row_number() over (partition by query, positive order by rank) <= 3""")
def silver_qrels(spark, sf_dir):
    hits = _hits_with_tags(spark, sf_dir, 20)
    same = F.size(F.array_intersect("qf", "df")) > 0
    return mining.silver_judgments(hits, F.col("lang") == "en", same).select("query", "doc", "rank", F.col("relevance").cast("int").alias("relevance"))


@query(f"""with {_HITS_SQL}, p as (select query, arg_min(doc, rank) as positive_id from h where lang = 'en' group by query),
n as (select h.query, positive_id, doc as negative_id, rank, score, case when lang = 'en' and len(list_intersect(qf, df)) = 0 then 'same_charge_different_behavior' else 'similar_fact_different_charge' end as negative_type, lang = 'en' as shared from h join p using (query) where doc <> positive_id)
select query, positive_id, negative_id, negative_type, round(score, 6) as score from n where not shared or negative_type = 'same_charge_different_behavior' qualify row_number() over (partition by query order by rank) <= 3""")
def hard_negatives(spark, sf_dir):
    hits = _hits_with_tags(spark, sf_dir, 20)
    return mining.hard_negatives(hits, F.col("lang") == "en", F.col("qf"), F.col("df")).withColumn("score", F.round("score", 6))


@query("""
with q as (select item_id as query_id, item_id * 7 % 1300 as case_id from benchmark), k as (select doc_id as case_id from documents)
select query_id, case_id, query_id not in (select item_id from benchmark where item_id % 3 <> 0) as query_missing, case_id not in (select case_id from k) as case_missing from q
where query_id not in (select item_id from benchmark where item_id % 3 <> 0) or case_id not in (select case_id from k)
""")
def dangling_qrels(spark, sf_dir):
    items = read_table(spark, sf_dir, "benchmark")
    qrels = items.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7 % 1300).alias("case_id"))
    return mining.dangling(qrels, items.where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id")), read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")))


_RUN_SQL = f"{_bm25_sql()}, r as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from s qualify row_number() over (partition by query order by score desc, doc) <= 20)"


@query(f"""with {_RUN_SQL}, j as (select query, doc, (rank % 3)::int as relevance from r where rank % 2 = 1), x as (select j.*, case when r.rank <= 10 then r.rank end as rank, row_number() over (partition by j.query order by relevance desc, j.doc) as ideal from j join r using (query, doc)),
p as (select query, count(*) filter (relevance > 0) as relevant, count(*) filter (relevance > 0 and rank is not null) as found, min(case when relevance > 0 then rank end) as first,
  coalesce(sum(case when rank is not null then (2.0 ** relevance - 1) / log2(rank + 1.0) end), 0.0) as dcg, coalesce(sum(case when ideal <= 10 then (2.0 ** relevance - 1) / log2(ideal + 1.0) end), 0.0) as idcg from x group by query)
select count(*) as queries, round(avg(case when relevant > 0 then found / relevant else 0.0 end), 6) as recall, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, round(avg(case when idcg > 0 then dcg / idcg else 0.0 end), 6) as ndcg from p""")
def ranking_metrics(spark, sf_dir):
    run = _ranked(spark, sf_dir, 20)
    judged = run.where("rank % 2 = 1").select("query", "doc", (F.col("rank") % 3).cast("int").alias("relevance"))
    return metrics.ranking(judged, run, 10)


@query(f"""with {_RUN_SQL}, rel as (select b.item_id as query, d.doc_id as doc from benchmark b join documents d on d.lang = ['en', 'fr', 'de', 'es'][b.item_id % 4 + 1]),
tot as (select query, count(*) as relevant from rel group by query), h as (select r.query, r.rank, rel.doc is not null as good from r left join rel using (query, doc) where rank <= 10),
p as (select query, count(*) filter (good) as found, min(case when good then rank end) as first, coalesce(sum(case when good then 1.0 / log2(rank + 1.0) end), 0.0) as dcg from h group by query),
x as (select *, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0 / log2(i + 1.0))) as idcg from tot join p using (query))
select count(*) as queries, round(avg(found / relevant), 6) as recall, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, round(avg(dcg / idcg), 6) as ndcg, round(avg(case when found > 0 then 1.0::double else 0 end), 6) as hit_rate from x""")
def proxy_metrics(spark, sf_dir):
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4).cast("int"))
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), lang.alias("label"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("label"))
    return metrics.label_proxy_ranking(queries, docs, _ranked(spark, sf_dir, 20), 10)
