"""SQL that gives the rows of those queries that SQL can express, by brute force."""

from __future__ import annotations

#: The smallest node reachable over links (a, b).
_REACHED = "r(node, root) as (select a, a from l union select l.b, r.root from r join l on r.node = l.a), c as (select node, min(root) as root from r group by node)"

JACCARD = f"""with recursive d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as c from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 10 * k >= 8 * (x.c + y.c - k)),
{_REACHED}, m as (select a, count(*) as k from l group by 1)
select doc_id, coalesce(root, doc_id) as class_id, coalesce(k, 0) as n_links, coalesce(root, doc_id) = doc_id as kept from documents left join c on node = doc_id left join m on a = doc_id"""

EMBEDDINGS = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
n as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as z from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where a.z > 0 and b.z > 0 and list_dot_product(a.e, b.e) / (a.z * b.z) >= 0.93),
{_REACHED}, m as (select a, count(*) as k from l group by 1)
select vec_id, coalesce(k, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from embeddings left join c on node = vec_id left join m on a = vec_id"""

CHAT = """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, 11 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\\\<\\[\\]]', '', 'g')) as chars, case when role = 'assistant' then text else '' end as learnt from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256, cast(sum(length(learnt)) as bigint) as loss_chars,
 sha256(string_agg(learnt, '' order by turn)) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from e group by conv_id"""

_M = {"symbols": ("n_symbols", "n_words", 0.25, 0.75, 3, False), "dup_lines": ("n_dup_lines", "n_lines", 0.5, 0.99, 2, False), "repeats": ("n_repeat_words", "n_words", 0.5, 0.99, 2, False), "word_length": ("word_chars", "n_words", 0.25, 0.75, 5, True)}
_INSIDE = " and ".join(
    f"coalesce({m} <= q{m}[2] + {reach} * greatest(q{m}[2] - q{m}[1], 5)" + (f" and {m} >= q{m}[1] - {reach} * greatest(q{m}[2] - q{m}[1], 5)" if low else "") + ", true)" for m, (_, _, _, _, reach, low) in _M.items()
)
_OWN = ", ".join(f"quantile_disc({m}, [{p}, {q}]) filter (not base_failed) as q{m}" for m, (_, _, p, q, _, _) in _M.items())
RULES = f"""with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
h as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as k from g) where k > 1) group by 1),
m as (select w.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
 len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(h.n, 0) as n_repeat_words from w left join h on w.doc_id = h.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {", ".join(f"floor(1000.0 * {a} / greatest({c}, 1)) as {n}" for n, (a, c, *_) in _M.items())} from m),
s as (select lang, source, count(*) filter (not base_failed) as k, {_OWN} from b group by 1, 2), g1 as (select lang, {_OWN} from b group by 1),
f as (select s.lang, s.source, {", ".join(f"case when k >= 50 then s.q{m} else g1.q{m} end as q{m}" for m in _M)} from s left join g1 on s.lang is not distinct from g1.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_INSIDE} as kept from b left join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source"""

_INTS = "(select vec_id, label, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"


def _assign(k: int) -> str:
    """Parts with the nearest entry of codebook ``k`` (ties to the lower); sums of products of small whole numbers are exact."""
    pairs = f"select p.*, entry, list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) as d from p join c{k} c using (part)"
    return f"a{k} as materialized (select vec_id, label, part, any_value(x) as x, min(d) as d, arg_min(entry, d * 256 + entry) as entry from ({pairs}) group by 1, 2, 3)"


def _means(k: int) -> str:
    sums = f"select part, entry, i, floor(sum(v) / count(*)) as m from (select part, entry, unnest(x) as v, unnest(range(len(x))) as i from a{k}) group by 1, 2, 3"
    return f"c{k + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) as x from c{k} c left join (select part, entry, list(m order by i) as x from ({sums}) group by 1, 2) m using (part, entry))"


VECTOR_CODES = f"""with v as materialized {_INTS.format(scale=1024)}, w as (select max(len(e)) // 4 as n from v),
p as materialized (select vec_id, label, part, e[part * n + 1 : part * n + n] as x from v, w, range(4) r(part)),
c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p where vec_id in (select vec_id from v order by vec_id limit 256)),
{", ".join(f"{_assign(k)}, {_means(k)}" for k in range(4))}, {_assign(4)},
b as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: cast(y as bigint)), ','), ',' order by part, entry)) as h from c4),
o as (select vec_id, label, string_agg(lower(printf('%02x', entry)), '' order by part) as code, cast(sum(d) as bigint) as error from a4 group by 1, 2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from o, b"""

TOP_K = f"""with v as {_INTS.format(scale=64)},
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""

#: The checksum of a feature's bytes, byte by byte with the table of its polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)), lambda x, b: xor(tab[(xor(x, b) & 255) + 1], x >> 8)), 4294967295)"
RESAMPLING = f"""with k as (select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab),
t as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from t),
f as materialized (select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
b as materialized (select f, {_CRC} % 10000 as bucket from (select f, hex(encode(f)) as h from (select distinct f from f)), k),
n as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from f join b using (f) group by 1),
g as (select bucket, cast(floor(1000 * ln(((t + 1) * ((sum(s) over ()) + 10000.0::double)) / ((s + 1) * ((sum(t) over ()) + 10000.0::double)))) as bigint) as gain from n),
m as (select id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from f join b using (f) join g using (bucket) where kind = 'd' group by 1),
o as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('7:' || doc_id)[1 : 8])::bigint as h from documents left join m on id = doc_id),
c as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from o),
r as (select *, n_features >= 39 as fit, row_number() over (partition by n_features >= 39 order by score desc, doc_id) as rank, count(*) over (partition by n_features >= 39) as n from c)
select doc_id, n_features, weight, score, case when fit and rank <= 25 * n // 100 then rank end as rank from r"""

ORACLE_SQL = {"op3_jaccard_join": JACCARD, "op5_chat": CHAT, "op8_embedding_dedup": EMBEDDINGS, "op9_quality_rules": RULES, "op11_vector_codes": VECTOR_CODES, "op12_exact_topk": TOP_K, "op13_resampling": RESAMPLING}
