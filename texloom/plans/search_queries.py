"""Keyword and ranked search over ``documents``, vector search over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import text as T
from texloom.operators import retrieval as R
from texloom.operators import neighbours, text_index

from .registry import Tables, query

TERMS = ["the", "erth", "ening"]

# The tokens, and Okapi scores of TERMS, in SQL.
TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
COUNTS = f"""
c as (select doc_id, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as tf0, len(list_filter(w, lambda x: x = 'erth')) as tf1,
  len(list_filter(w, lambda x: x = 'ening')) as tf2 from (select doc_id, {TOK} as w from documents)),
s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1, count(*) filter (tf2 > 0) as df2 from c)"""
OKAPI = f"""with {COUNTS},
t as (select term, count(distinct doc_id) as df from (select doc_id, unnest({TOK}) as term from documents) group by term),
m as (select avg(ln(n - df + 0.5) - ln(df + 0.5)) as mean_idf from t, s),
i as (select n, avgdl, mean_idf, ln(n - df0 + 0.5) - ln(df0 + 0.5) as i0, ln(n - df1 + 0.5) - ln(df1 + 0.5) as i1, ln(n - df2 + 0.5) - ln(df2 + 0.5) as i2, df0, df1, df2 from s, m),
w as (select avgdl, case when df0 = 0 then 0 when i0 < 0 then 0.25 * mean_idf else i0 end as w0, case when df1 = 0 then 0 when i1 < 0 then 0.25 * mean_idf else i1 end as w1,
  case when df2 = 0 then 0 when i2 < 0 then 0.25 * mean_idf else i2 end as w2 from i),
o as (select doc_id, w0 * tf0 * 2.5 / (tf0 + 1.5 * (0.25 + 0.75 * dl / avgdl)) + w1 * tf1 * 2.5 / (tf1 + 1.5 * (0.25 + 0.75 * dl / avgdl)) + w2 * tf2 * 2.5 / (tf2 + 1.5 * (0.25 + 0.75 * dl / avgdl)) as score from c, w)"""


@query(f"{OKAPI} select doc_id, round(score, 6) as score from o order by o.score desc, doc_id limit 10")
def bm25_topk(t: Tables):
    return text_index.of(t.documents).top(TERMS, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{OKAPI} select o.doc_id, round(score, 6) as score, quality from o join labels l on o.doc_id = l.doc_id order by o.score desc, o.doc_id limit 10")
def bm25_with_labels(t: Tables):
    hits = text_index.of(t.documents).top(TERMS, 10, within=t.labels).join(t.labels.select("doc_id", "quality"), "doc_id")
    return hits.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"), "quality")


@query(f"""with {COUNTS.replace("'the'", "'nosuchterm'")},
i as (select avgdl, ln(n - df1 + 0.5) - ln(df1 + 0.5) as w1, ln(n - df2 + 0.5) - ln(df2 + 0.5) as w2 from s)
select doc_id, round(score, 6) as score from (select doc_id, w1 * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + 2 * w2 * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from c, i) order by 2 desc, 1 limit 300""")
def bm25_index_repeated(t: Tables):
    """A term twice in the query, one that no text has, and more hits asked for than there may be."""
    return text_index.of(t.documents).top(["erth", "ening", "nosuchterm", "ening"], 300, k1=1.2).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with {COUNTS},
i as (select avgdl, greatest(ln(n - df0 + 0.5) - ln(df0 + 0.5), 1e-6) as w0, greatest(ln(n - df2 + 0.5) - ln(df2 + 0.5), 1e-6) as w2 from s)
select doc_id, round(w0 * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + w2 * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score
from c, i where tf0 > 0 and tf2 > 0""")
def bm25_all_terms(t: Tables):
    return R.full_text(t.documents, ["the", "ening"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with {COUNTS},
i as (select avgdl, greatest(ln(n - df0 + 0.5) - ln(df0 + 0.5), 1e-6) as w0 from s)
select doc_id, round(w0 * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score from c, i where tf0 > 0 and doc_id in (select doc_id from labels where quality = 1)""")
def full_text_within(t: Tables):
    return R.full_text(t.documents, ["the"], within=t.labels.where("quality = 1")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOK}) as term from documents) group by 1, 2) group by term")
def term_stats(t: Tables):
    return R.term_stats(R.postings(t.documents))


@query(f"select doc_id, cast(len({TOK}) as bigint) as dl from documents")
def doc_stats(t: Tables):
    return R.doc_stats(t.documents)


@query("select doc_id, lang, source from documents where contains(lower(text), 'erth') and contains(lower(text), 'ening')")
def keyword_and(t: Tables):
    return t.documents.where(T.contains_all(F.col("text"), T.query_keywords("Erth ening of"))).select("doc_id", "lang", "source")


MATCHES = "cast(contains(lower(text), 'erth') as int) + cast(contains(lower(text), 'ening') as int) + cast(contains(lower(text), 'thble') as int)"


@query(f"""select doc_id, n_chars, {MATCHES} as matches, case when length(text) > 500 then substring(text, 1, 500) || '...' else text end as preview
from (select * from documents where contains(lower(text), 'erth') or contains(lower(text), 'ening') or contains(lower(text), 'thble') order by n_chars desc, doc_id limit 20)""")
def keyword_two_phase(t: Tables):
    keys = ["erth", "ening", "thble"]
    head = t.documents.where(T.contains_any([F.col("text")], keys)).orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return head.select("doc_id", "n_chars", T.match_count(F.col("text"), keys).alias("matches"), T.preview(F.col("text"), 500).alias("preview")).orderBy(F.desc("matches"), F.desc("n_chars"), "doc_id")


@query("select doc_id, lang from documents where contains(lower(text), 'erth') and doc_id in (select doc_id from labels where quality = 1)")
def keyword_in_ids(t: Tables):
    return t.documents.where(T.contains_all(F.col("text"), ["erth"])).join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("select doc_id from documents where contains(lower(text), 'ening') or contains(lower(source), 'ening') or contains(lower(text), 'src1') or contains(lower(source), 'src1')")
def or_terms_two_columns(t: Tables):
    return t.documents.where(T.contains_any([F.col("text"), F.col("source")], ["ening", "src1"])).select("doc_id")


@query("select d.doc_id, source, quality from documents d left join labels l on d.doc_id = l.doc_id order by quality desc nulls last, n_chars desc, d.doc_id limit 50")
def doc_listing_quality(t: Tables):
    both = t.documents.join(t.labels, "doc_id", "left")
    return both.orderBy(F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "source", "quality")


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as preview from documents")
def truncate_preview(t: Tables):
    return t.documents.select("doc_id", T.preview(F.col("text"), 200).alias("preview"))


QUERY_VEC = "(select embedding as q from embeddings where vec_id = 0)"
L2 = "list_sum(list_transform(list_zip(embedding, q), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double))))"


def _vector(t: Tables, vec_id: int = 0):
    return t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query(f"select vec_id, round(d, 6) as distance from (select vec_id, {L2} as d from embeddings, {QUERY_VEC}) order by d, vec_id limit 10")
def knn_l2(t: Tables):
    return R.nearest(t.embeddings, _vector(t), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, round(1 / (1 + d), 6) as similarity, round(1 - d, 6) as vector_score from (select vec_id, {L2} as d from embeddings, {QUERY_VEC}) order by d, vec_id limit 20")
def knn_similarity(t: Tables):
    return R.nearest(t.embeddings, _vector(t), 20).select("vec_id", F.round("similarity", 6).alias("similarity"), F.round(1 - F.col("distance"), 6).alias("vector_score"))


@query(f"""with p as (select a.vec_id as query_id, b.vec_id, {L2.replace('embedding', 'b.embedding').replace(', q)', ', a.embedding)')} as d
from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, vec_id, cast(rank as int) as rank, round(d, 6) as distance from (select *, row_number() over (partition by query_id order by d, vec_id) as rank from p) where rank <= 5""")
def knn_per_label_topk(t: Tables):
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    return neighbours.nearest_per_query(t.embeddings, asked, 5, "label").select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"""with p as (select a.vec_id as query_id, b.vec_id, {L2.replace('embedding', 'b.embedding').replace(', q)', ', a.embedding)')} as d
from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, vec_id, row_number() over (partition by query_id order by d, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, doc_id, lang, source, n_chars from r join documents on doc_id = vec_id where rank <= 10""")
def knn_documents(t: Tables):
    """The documents behind the nearest vectors of many queries: ids first, then one join for what is shown of them."""
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = neighbours.nearest_per_query(t.embeddings, asked, 10)
    shown = t.documents.select("doc_id", "lang", "source", "n_chars")
    return hits.join(shown, hits.vec_id == shown.doc_id).select("query_id", "rank", "doc_id", "lang", "source", "n_chars")


LISTS = f"""{OKAPI},
a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from o order by score desc, doc_id limit 100),
b as (select doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents order by n_chars desc, doc_id limit 100)"""


def _lists(t: Tables):
    return R.ranked(text_index.of(t.documents).top(TERMS, 100)), R.ranked(t.documents.select("doc_id", F.col("n_chars").alias("score")))


@query(f"{LISTS} select doc_id, round(sum(1.0 / (60 + rank)), 6) as rrf_score from (select * from a union all select * from b) group by doc_id")
def rrf_two_lists(t: Tables):
    return R.reciprocal_rank_fusion(list(_lists(t))).select("doc_id", F.round("rrf_score", 6).alias("rrf_score"))


@query(f"{LISTS} select doc_id, cast(min(l) as int) as list, cast(arg_min(rank, l) as int) as rank from (select doc_id, rank, 0 as l from a union all select doc_id, rank, 1 as l from b) group by doc_id")
def dedup_first(t: Tables):
    return R.first_of_each(list(_lists(t)), "doc_id")


OVERLAP = f"len(list_intersect({TOK}, ['the', 'erth', 'ening'])) / 3.0"


@query(f"{OKAPI} select o.doc_id, round(0.5 * score + 0.5 * {OVERLAP}, 6) as hybrid_score from o join documents d on o.doc_id = d.doc_id")
def hybrid_weighted(t: Tables):
    overlap = t.documents.select("doc_id", R.token_overlap(F.col("text"), TERMS).alias("score"))
    return R.hybrid(R.okapi(t.documents, TERMS).select("doc_id", "score"), overlap).select("doc_id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query(f"""{LISTS}, r as (select a.doc_id, rank, {OVERLAP} as s from a join documents d on a.doc_id = d.doc_id)
select doc_id, cast(rank as int) as rank, cast(row_number() over (order by case when rank > 20 then 1 else 0 end, case when rank <= 20 then s end desc nulls last, rank) as int) as new_rank from r""")
def rerank_head(t: Tables):
    ranks = R.ranked(text_index.of(t.documents).top(TERMS, 100)).join(t.documents.select("doc_id", "text"), "doc_id")
    return R.rerank_head(ranks, R.token_overlap(F.col("text"), TERMS)).select("doc_id", "rank", "new_rank")
