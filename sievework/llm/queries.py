"""The registered queries of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontaminate, jaccard_join, langid, lattice, line_dedup, packing, quality, runs, storage, token_store, topk, url_filter

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
PROBE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, keep_empty=True)
    return out.select("doc_id", F.col("lines_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents"), n=4, threshold=Fraction(85, 100))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    return marked.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out_of_fit = quality.held_out(F.col("doc_id"), 4, 2)
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs, ~out_of_fit))
    return out.select("doc_id", out_of_fit.alias("held_out"), "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(storage.stored(chat.windows(rows.unionByName(probe)), "chat"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), storage.fresh_uri(spark, "ids"))
    return token_store.read_digests(spark, store)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows.select("conv_id"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(_table(spark, sf_dir, "documents"), runs.periodic_text)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_jaccard_join, op4_decontamination, op5_quality, op6_language_id, op7_chat_format, op8_token_store, op9_exact_topk, op10_packing, op11_lattice_near_dups, op12_conversation_repair, op13_periodic_runs)}

_OP1 = f"""
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null
), u as (
  select line, length(line) as n, min((doc_id, pos)) as loc from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by line
), near as (
  select distinct case when a.loc < b.loc then b.line else a.line end as line
  from u a join u b on a.n between b.n and b.n + {line_dedup.THRESHOLD} and a.line <> b.line and b.n >= {line_dedup.MIN_CHARS}
   and (contains(a.line, substr(b.line, 1, b.n // 3)) or contains(a.line, substr(b.line, b.n // 3 + 1, b.n // 3)) or contains(a.line, substr(b.line, b.n // 3 * 2 + 1)))
  where levenshtein(a.line, b.line) <= {line_dedup.THRESHOLD}
), marked as (
  select l.doc_id, l.pos, l.line, (u.line is not null and ((l.doc_id, l.pos) <> u.loc or near.line is not null)) as gone
  from l left join u on l.line = u.line left join near on l.line = near.line
), built as (
  select doc_id, count(*) filter (gone) as lines_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from marked group by doc_id
)
select d.doc_id, coalesce(b.lines_removed, 0) as lines_removed, length(b.kept) as n_chars_kept, md5(b.kept) as text_md5 from documents d left join built b on d.doc_id = b.doc_id
"""

_OP2 = """
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '^[^:]*(?::[^/][^:]*|:/[^/][^:]*)*://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^[^:]*(?::[^/][^:]*|:/[^/][^:]*)*://[^/?#]*([^?#]*)', 1), '') as path from pages
), r(verdict, host, path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits as (
  select p.page_id, r.host || r.path as rule, r.verdict, row_number() over (partition by p.page_id order by length(r.host || r.path) desc) as k
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') as verdict from p left join hits h on p.page_id = h.page_id and h.k = 1
"""

_OP4 = """
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), win as (
  select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) as g from bw where len(w) > 0
), sizes as (select distinct n from win), grams as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) as g from dw, sizes where len(w) >= n
), hits as (
  select grams.doc_id, grams.i, grams.n, win.item_id from grams join win on grams.n = win.n and grams.g = win.g
), words as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from (select distinct doc_id, i, n from hits)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id
)
select dw.doc_id, len(dw.w) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items, sha256(coalesce(items.s, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from dw left join words on dw.doc_id = words.doc_id left join items on dw.doc_id = items.doc_id
"""

_TOKENS = "len(regexp_extract_all({}, '" + chat._TOKEN.replace("{", "{{").replace("}", "}}") + "')) + 2"
_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\<>]', '', 'g'))"
_OP7 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
), t as (
  select *, {_TOKENS.format("text")} as n, row_number() over w as place, coalesce(sum({_TOKENS.format("text")}) over (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as before
  from c window w as (partition by conv_id order by turn nulls first, role, text)
), v as (
  select *, before // {chat.STRIDE} as win, row_number() over (partition by conv_id, role order by place) = 1 and role = 'system' as first_system from t
), starts as (select conv_id, win, min(before) as start from v group by all),
shown as (
  select v.*, s.win as w from v join starts s on v.conv_id is not distinct from s.conv_id and s.win >= v.win and (s.win = v.win or v.first_system or s.start - v.before <= {chat.HISTORY})
), cut as (
  select *, case when w = win or not first_system or n <= {chat.SYSTEM} then text else array_to_string(regexp_extract_all(text, '[\x09-\x0D\x20]*(?:{chat._TOKEN})')[1 : {chat.SYSTEM - 2}], '') end as x from shown
), chars as (
  select conv_id, sum(length('<turn  ></turn>') + case when w = win then 3 else 5 end + {_ESCAPED.format("role")} + {_ESCAPED.format("x")})::bigint as formatted_chars from cut group by conv_id
), d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
    coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '') as loss from t group by conv_id
)
select d.conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from d join chars on d.conv_id is not distinct from chars.conv_id
"""

_OP3 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) as g from w where len(w) > 0
), sizes as materialized (select doc_id, count(*) as n from s group by doc_id
), inter as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as materialized (
  select a, b from inter join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), least_of as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id from documents d left join sizes on d.doc_id = sizes.doc_id left join least_of on d.doc_id = a
"""

_OP9 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""

_OP11 = """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as materialized (
  select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as materialized (
  select a.r as a, b.r as b, b.vec_id from ok a join ok b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), least_of as (select a, min(vec_id) as m from reach join v on v.r = reach.b group by a), n as (select a, count(*) as k from links group by a)
select v.vec_id, coalesce(n.k, 0) as n_links, case when least_of.m < v.vec_id or v.vec_id is null then least_of.m else v.vec_id end as component_id,
  v.vec_id is not distinct from case when least_of.m < v.vec_id or v.vec_id is null then least_of.m else v.vec_id end as kept
from v left join n on n.a = v.r left join least_of on least_of.a = v.r
"""

#: The table of CRC-32, and the checksum of a string of one-byte characters.
_CRC = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as crc"
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1))::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255)::int + 1])), 4294967295)"


def _more(x: str, cost: str, letter: str) -> str:
    return f"lpad((substr({x}, 1, 10)::bigint + {cost})::varchar, 10, '0') || substr({x}, 11) || '{letter}'"


# s: least cost (ten digits) and audit in each state of the grammar: start, system, user, assistant; r: initial, x if it has to go, extra cost
_OPEN = "least(s[1], s[2], s[4])"
_ROW = f"""[{_more("s[1]", "2", "D")},
  least({_more("s[2]", "2", "D")}, case when r[2] = '' and r[1] = 's' then {_more("s[1]", "r[3]::bigint", "K")} end),
  least({_more("s[3]", "2", "D")}, case when r[2] = '' and r[1] = 'u' then {_more(_OPEN, "r[3]::bigint", "K")} end, case when r[2] = '' then {_more(_OPEN, "r[3]::bigint + 1", "R")} end),
  least({_more("s[4]", "2", "D")}, case when r[2] = '' and r[1] = 'a' then {_more("s[3]", "r[3]::bigint", "K")} end, case when r[2] = '' then {_more("s[3]", "r[3]::bigint + 1", "R")} end)]"""
_INSERT_USER = f"list_transform([{_ROW}], lambda s: [s[1], s[2], least(s[3], {_more(_OPEN, '5', 'I')}), s[4]])"
_FOLD = f"list_transform({_INSERT_USER}, lambda s: [s[1], s[2], s[3], least(s[4], {_more('s[3]', '5', 'I')})])[1]"

_OP12 = rf"""
with t as materialized ({_CRC}), d as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), keys as (select k, {_CRC_OF.format("k")} % 20 as kind from (select distinct k from d), t
), dam as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from d join keys using (k) where kind <> 0
), p as (
  select *, row_number() over w as place, substr(lag(role) over w, 1, 1) || substr(role, 1, 1) as pair from dam window w as (partition by conv_id order by turn nulls first, role, text)
), f as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' end as fault from p
), found as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (place > 1 and pair not in ('su', 'ua', 'au')) as illegal,
    list_reduce(list_prepend(['0000000000', null, '0000000005I', '0000000010II'], list([substr(role, 1, 1), case when fault in ('blank', 'duplicate') then 'x' else '' end, case when fault = 'truncated' then '5' else '0' end] order by place)), lambda s, r: {_FOLD}) as s
  from f group by conv_id
), told as (select *, least(s[1], s[4]) as best from found
), letters as (
  select conv_id, unnest(range(1, length(substr(best, 11)) + 1)) as i, unnest(string_split(substr(best, 11), '')) as l from told where length(best) > 10
), numbered as (
  select *, sum((l <> 'I')::int) over w as place, sum((l <> 'D')::int) over w as m from letters window w as (partition by conv_id order by i)
), taken as (
  select n.conv_id, n.m, n.l, f.role, f.text, max((n.m = 1 and n.l = 'K' and f.role[1] = 's')::int) over (partition by n.conv_id) as sys
  from numbered n left join f on n.conv_id is not distinct from f.conv_id and n.place = f.place and n.l <> 'I' where n.l <> 'D'
), repaired as (
  select conv_id, sha256(string_agg(case when l = 'K' then role when (m - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when l = 'I' then '' else text end, chr(10) order by m)) as sha from taken group by conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(substr(best, 1, 10)::bigint, 0) as cost, coalesce(substr(best, 11), '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join told on c.conv_id is not distinct from told.conv_id left join repaired on c.conv_id is not distinct from repaired.conv_id
"""

_OP13 = rf"""
with t as materialized ({_CRC}), d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from documents
), h as (select r, len(w) as n, {_CRC_OF.format("doc_id::varchar")} as h from d, t
), a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, 3 + (h // 10) % 8 as k from h
), words as materialized (select r, unnest(w) as x, unnest(range(len(w))) as i from d
), pos as materialized (
  select i.r, i.i, x.x from (select r, a, n, k, unnest(range(n)) as i from a) i join words x on x.r = i.r and x.i = case when i.i < a or a is null then i.i else a + (i.i - a) % (1 + (n - a) // k) end
), periods as (select r, len(w) as n, unnest(range(1, len(w) // 4 + 1)) as q from d
), cand as (select r, n, q, unnest(range(0, n - 3 * q + 1, q)) as j from periods
), k as materialized (select (r << 32) + i as k, x from pos
), pax as materialized (select c.*, k.x from cand c join k on k.k = (c.r << 32) + c.j
), pay as materialized (select c.* from pax c join k on k.k = (c.r << 32) + c.j + c.q and k.x = c.x
), paz as materialized (select c.r, c.n, c.q, c.j from pay c join k on k.k = (c.r << 32) + c.j + 2 * c.q and k.x = c.x
), pbx as materialized (select c.*, k.x from paz c join k on k.k = (c.r << 32) + c.j + c.q - 1
), pby as materialized (select c.* from pbx c join k on k.k = (c.r << 32) + c.j + c.q - 1 + c.q and k.x = c.x
), pbz as materialized (select c.r, c.n, c.q, c.j from pby c join k on k.k = (c.r << 32) + c.j + c.q - 1 + 2 * c.q and k.x = c.x
), pcx as materialized (select c.*, k.x from pbz c join k on k.k = (c.r << 32) + c.j + c.q // 2
), pcy as materialized (select c.* from pcx c join k on k.k = (c.r << 32) + c.j + c.q // 2 + c.q and k.x = c.x
), pcz as materialized (select c.r, c.n, c.q, c.j from pcy c join k on k.k = (c.r << 32) + c.j + c.q // 2 + 2 * c.q and k.x = c.x
), c3 as materialized (select distinct r, n, q from pcz
), breaks as (
  select c.r, c.q, c.i from (select c3.*, pos.i, pos.x from c3 join pos on pos.r = c3.r) c join k on k.k = (c.r << 32) + c.i + c.q where k.x <> c.x
  union all select r, q, -1 from c3 union all select r, q, n - q from c3
), stretches as (
  select r, q, lag(i) over (partition by r, q order by i) + 1 as s, i + q as e from breaks
), runs as materialized (
  select r, s, e, min(q) as q from stretches where s is not null and e - q > s and e - s >= greatest(6, 4 * q) group by r, s, e
), told as (
  select r, count(*) as n_runs, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q)) as runs_sha256 from runs group by r
), best as (
  select * from runs qualify row_number() over (partition by r order by (e - s)::double / q desc, s, q) = 1
), gone as (select distinct r, unnest(range(s + q, e)) as i from runs
), kept as (
  select r, sha256(string_agg(x, ' ' order by i)) as sha from pos anti join gone using (r, i) group by r
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.e - best.s as length, best.q as period, (1000 * (best.e - best.s)) // best.q as exponent_milli, coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(kept.sha, sha256('')) as collapsed_sha256
from d left join told on told.r = d.r left join best on best.r = d.r left join kept on kept.r = d.r
"""

ORACLES = {"op1_line_dedup": _OP1, "op2_url_filter": _OP2, "op3_jaccard_join": _OP3, "op7_chat_format": _OP7, "op4_decontamination": _OP4, "op9_exact_topk": _OP9, "op11_lattice_near_dups": _OP11, "op12_conversation_repair": _OP12, "op13_periodic_runs": _OP13}
