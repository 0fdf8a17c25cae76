"""References of pages, stage scores and reports, citation search, and the ranking of a page of results by every method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import formulas as L
from texloom.functions import text as T
from texloom.operators import chunking, scores
from texloom.operators import citations as C
from texloom.operators import entities as E
from texloom.operators import pages as P
from texloom.operators import references as R
from texloom.operators import retrieval

from .corpus_queries import CHUNKS, CLEAN, _plain
from .entity_queries import _CONS, _FUNS, _OPS, _VARS, FOUND, MATH, _cited, _found, _latex
from .registry import Tables, query
from .search_queries import OKAPI, OVERLAP, TERMS

#: The pages have no references, so each gets some, in one of three layouts.
ADDED = """html || case page_id % 3 when 0 then '<h2>References</h2><p>[1] Alpha B. "On page ' || page_id || ' and more". Journal of Things, 2019.</p><p>[2] short</p><p>[3] Beta C. "A longer title". 2011.</p><h2>Appendix</h2><p>[4] Not a reference at all.</p>'
when 1 then '<h3>1 Reference list</h3><ol><li>Gamma D. Some long title of ' || page_id || ', 2018</li><li>brief</li></ol>' else '<div class="my-bib box"><div>Delta E. Another long entry, ' || url || '</div></div>' end"""
PART = "case when regexp_replace(hd, '(?is)<h[1-6]\\b.*', '') <> '' then regexp_replace(hd, '(?is)<h[1-6]\\b.*', '') else regexp_extract(x, '(?is)<div\\b[^>]*class=\"[^\"]*(?:bib|reference)[^\"]*\"[^>]*>(.*)', 1) end"


def _pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(ADDED).alias("html"))


@query(f"""with x as (select page_id, {ADDED} as x from pages), h as (select page_id, regexp_extract(x, '(?is)<h[1-4]\\b[^>]*>[^<]*reference[^<]*</h[1-4]\\s*>(.*)', 1) as hd, x from x), p as (select page_id, {PART} as part from h),
l as (select page_id, list_filter(list_transform(regexp_extract_all(part, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1), lambda e: {_plain("e")}), lambda e: regexp_matches(e, '^\\[?[0-9]+\\]?')) as numbered,
 list_transform(regexp_extract_all(part, '(?is)<(?:div|li|p)\\b[^>]*>(.*?)</(?:div|li|p)\\s*>', 1), lambda e: {_plain("e")}) as others from p),
e as (select page_id, case when len(numbered) > 0 then numbered else others end as e from l)
select page_id, cast(i - 1 as int) as position, e[i] as citation_text from (select page_id, e, unnest(range(1, len(e) + 1)) as i from e) where length(e[i]) >= 20""")
def reference_entries(t: Tables):
    return R.reference_entries(_pages(t))


@query(f"""with h as (select page_id, regexp_extract_all({ADDED}, '(?is)<(h[1-6]\\b[^>]*>.*?)</h[1-6]\\s*>', 1) as h from pages),
t as (select page_id, cast(i - 1 as int) as position, {_plain("regexp_replace(h[i], '(?s)^h[1-6]\\b[^>]*>', '')")} as title from (select page_id, h, unnest(range(1, len(h) + 1)) as i from h)),
c as (select * from t where regexp_matches(lower(title), 'references|bibliography|citations') and not regexp_matches(lower(title), 'abstract|summary|intro|background|motivation|related work|literature review|prior work|method|approach|techniques|experiment|evaluation|results|findings|analysis|discussion|interpretation|conclusion|future work|acknowledg|thanks'))
select page_id, min(position) as position, arg_min(title, position) as title from c group by page_id""")
def references_pick(t: Tables):
    return R.references_section(P.headings(_pages(t)))


@query("""select doc_id, trim(coalesce(s[i], '')) as sentence from (select doc_id, s, list_position(list_transform(range(1, len(s) + 1), lambda i: 70 <= list_sum(list_transform(s[1:i], lambda x: length(x) + 1)) - 1), true) as i
from (select doc_id, string_split_regex(text, '[.!?]+') as s from documents where length(text) > 400))""")
def sentence_context(t: Tables):
    long = t.documents.where("length(text) > 400")
    return long.select("doc_id", R.sentence_around(F.col("text"), F.lit(70)).alias("sentence"))


@query(f"""with f as (select doc_id, f, {_VARS} as v, {_FUNS} as n, {_OPS} as o, {_CONS} as c from {MATH}),
g as (select source, len(v) > 0 as hv, len(n) > 0 as hn, len(o) > 0 as ho, least(10.0, 0.01 * length(f) + 0.5 * len(v) + len(n) + 0.3 * len(o) + case when contains(f, '\\frac') then 2 else 0 end + case when contains(f, '\\sum') or contains(f, '\\int') then 3 else 0 end + case when contains(f, '\\sqrt') then 1 else 0 end) as x
 from f join documents d on d.doc_id = f.doc_id)
select source, round(cast(least(10.0, 5.0 + cast(bool_or(hv) as int) + cast(bool_or(hn) as int) + cast(bool_or(ho) as int) + least(3.0, 0.3 * avg(x))) as double), 6) as math_quality from g group by source""")
def math_quality(t: Tables):
    f = F.col("f")
    rows = _latex(t).join(t.documents.select("doc_id", "source"), "doc_id").select("source", "f", L.variables(f).alias("variables"), L.functions(f).alias("functions"), L.operators(f).alias("operators"))
    rows = rows.withColumn("complexity", L.complexity(f, F.size("variables"), F.size("functions"), F.size("operators")))
    return scores.math_quality(rows, "source").select("source", F.round("math_quality", 6).alias("math_quality"))


_RELATED = f"""{FOUND}, p as (select distinct doc_id, unnest(regexp_extract_all(text, '(?i)([^.!?\\n]{{0,80}}\\b(?:with)\\b[^.!?\\n]{{0,80}})', 1)) as context from documents),
x as (select distinct p.doc_id, context, normalized from p join e on p.doc_id = e.doc_id and contains(lower(context), normalized)),
r as (select a.doc_id, count(*) as relations from x a join x b on a.doc_id = b.doc_id and a.context = b.context and a.normalized < b.normalized group by 1),
n as (select doc_id, count(*) as entities, cast(sum(mention_count) as bigint) as mentions from e group by 1)"""


def _extracted(t: Tables) -> list[DataFrame]:
    merged = E.merged(_found(t))
    related = E.relations(t.documents, merged, {"uses": (r"[^.!?\n]{0,80}\b(?:with)\b[^.!?\n]{0,80}",)}, apart=r"[.!?\n]")
    return [merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"), F.sum("mention_count").alias("mentions")), related.groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations"))]


@query(f"{_RELATED} select d.doc_id, round(cast(least(10.0, 0.1 * coalesce(entities, 0) + 0.2 * coalesce(relations, 0)) as double), 6) as extraction_quality from documents d left join n on n.doc_id = d.doc_id left join r on r.doc_id = d.doc_id")
def extraction_quality(t: Tables):
    counts = scores.stage_report(t.documents, _extracted(t))
    return counts.select("doc_id", F.round(scores.extraction_quality(F.col("entities"), F.col("relations")), 6).alias("extraction_quality"))


@query(f"""select d.doc_id, coalesce(chunks, 0) as chunks, coalesce(round(avg_chars, 6), 0) as avg_chars, coalesce(entities, 0) as entities, coalesce(mentions, 0) as mentions, coalesce(relations, 0) as relations
from documents d left join ({CHUNKS} select doc_id, count(*) as chunks, avg(char_count) as avg_chars from c group by 1) c on c.doc_id = d.doc_id
left join ({_RELATED} select n.*, relations from n left join r on n.doc_id = r.doc_id) n on n.doc_id = d.doc_id""")
def stage_reports(t: Tables):
    chunks = chunking.chunked(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("char_count"), 6).alias("avg_chars"))
    return scores.stage_report(t.documents, [chunks, *_extracted(t)]).select("doc_id", "chunks", "avg_chars", "entities", "mentions", "relations")


@query("""with c as (select doc_id, unnest([cast(doc_id % 5 as int), 3, 4, null]) as number from documents), u as (select distinct * from c)
select doc_id, round(least(10.0, 3.0 + 3.0 * 3 / 4 + 2.0 + 2.0 * count(*) filter (number is null or number between 1 and 4) / count(*)), 6) as citation_quality from u group by doc_id""")
def citation_quality(t: Tables):
    """Four references to a document, three of them with authors and title; the links are those of ``citation_link_exact``."""
    links = _cited(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("cited"), F.count("ref_id").alias("linked"))
    refs = F.lit(4), F.lit(3)
    return links.select("doc_id", F.round(scores.citation_quality(*refs, F.col("cited"), F.col("linked")), 6).alias("citation_quality"))


@query("""select source, round(coalesce(len(list_distinct(list(kind) filter (kind in ('abstract', 'introduction', 'methodology', 'results', 'conclusion')))), 0) / 5.0, 6) as completeness
from (select source, case doc_id % 4 when 0 then 'introduction' when 1 then 'methodology' when 2 then 'abstract' else 'other' end as kind from documents) group by source""")
def structure_completeness(t: Tables):
    kind = F.col("doc_id") % 4
    title = F.when(kind == 0, "1 Introduction").when(kind == 1, "Our Approach").when(kind == 2, "Summary").otherwise("Thanked nobody")
    kinds = t.documents.select("source", T.canonical_section(title).alias("kind")).groupBy("source").agg(F.collect_set("kind").alias("kinds"))
    return kinds.select("source", F.round(scores.structure_completeness(F.col("kinds")), 6).alias("completeness"))


@query("""with r as (select doc_id, doc_id || '_' || i as ref_id, i, case when i = 3 then 2020 when i = 0 then 2011 else 2011 + i end as year, case when i = 3 then 'Smith A' else 'Jones B' end as author from (select doc_id, unnest([0, 1, 2, 3]) as i from documents)),
c as (select distinct doc_id, number from (select doc_id, unnest([cast(doc_id % 5 as int), 3, 4, null]) as number from documents))
select ref_id, year, (select count(*) from c where c.doc_id = r.doc_id and (number is null and i = 3 or number = i + 1)) as in_text from r where author = 'Smith A' order by year desc nulls last, r.doc_id, ref_id limit 20""")
def citation_search(t: Tables):
    each = t.documents.select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("position"))
    entry = F.when(F.col("position") == 3, "Smith A. \"A title of it\". Journal of Things, 2020").otherwise(F.concat((F.col("position") + 1).cast("string"), F.lit(". Jones B. \"Another title\". 2011")))
    refs = C.parsed(each.withColumn("citation_text", entry)).withColumn("ref_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("position").cast("string")))
    return C.search(refs, _cited(t), "smith").select("ref_id", "year", "in_text")


_HITS = "b as (select doc_id, text, row_number() over (order by n_chars desc, doc_id) as rank from documents order by n_chars desc, doc_id limit 30)"


@query(f"""{OKAPI.replace("documents", "(select * from documents order by n_chars desc, doc_id limit 30) documents")}, {_HITS},
ways as (select 'bm25' as method, b.doc_id, rank, score as s from b join o on o.doc_id = b.doc_id union all select 'rrf', doc_id, rank, 1.0 / (60 + rank) from b
 union all select 'cross_encoder', doc_id, rank, {OVERLAP} from b union all select 'none', doc_id, rank, -rank from b)
select method, doc_id, cast(rank as int) as rank, cast(row_number() over (partition by method order by s desc, rank) as int) as new_rank from ways""")
def rank_dispatch(t: Tables):
    hits = retrieval.ranked(t.documents.select("doc_id", "text", F.col("n_chars").alias("score")), k=30)
    each = [retrieval.rank_by(m, hits, TERMS).select(F.lit(m).alias("method"), "doc_id", "rank", "new_rank") for m in ("bm25", "rrf", "cross_encoder", "none")]
    return reduce(DataFrame.unionByName, each)


_MD = f"regexp_replace({CLEAN}, '(?is)<head\\b.*?</head\\s*>', '', 'g')"
for _n in range(1, 7):
    _MD = f"regexp_replace({_MD}, '(?is)<h{_n}\\b[^>]*>(.*?)</h{_n}\\s*>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"
for _from, _to in (('(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a\\s*>', "'[\\2](\\1)'"), ("(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "'**\\1**'"), ("(?i)<li\\b[^>]*>", "chr(10) || '* '"), ("(?i)</?(?:p|div|br|ul|ol|article|section|tr)\\b[^>]*>", "chr(10)"), ("(?s)<[^>]*>", "''")):
    _MD = f"regexp_replace({_MD}, '{_from}', {_to}, 'g')"


@query(f"select page_id, array_to_string(list_filter(list_transform(string_split({_MD}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as markdown from pages")
def html_markdown(t: Tables):
    return t.pages.select("page_id", P.markdown(F.col("html")).alias("markdown"))


@query(f"""with m as (select page_id, string_split(regexp_replace({CLEAN}, '(?i)<(h[1-6]\\b)', chr(1) || '<\\1', 'g'), chr(1))[2:] as cuts from pages),
u as (select page_id, i, cuts[i] as html, cast(substring(cuts[i], 3, 1) as int) as level from (select page_id, cuts, unnest(range(1, len(cuts) + 1)) as i from m)),
e as (select a.page_id, a.i, a.level, a.html, min(b.i) as upto from u a left join u b on a.page_id = b.page_id and b.i > a.i and b.level <= a.level group by all),
j as (select e.page_id, e.i, e.level, e.html, string_agg(u.html, ' ' order by u.i) as inside from e join u on u.page_id = e.page_id and u.i >= e.i and (upto is null or u.i < upto) group by all)
select page_id, cast(i - 1 as int) as position, level, {_plain("regexp_extract(html, '(?is)^<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1)")} as title, {_plain("regexp_replace(inside, '(?is)^<h[1-6]\\b[^>]*>.*?</h[1-6]\\s*>', '')")} as body from j""")
def section_bodies(t: Tables):
    return P.section_bodies(t.pages)
