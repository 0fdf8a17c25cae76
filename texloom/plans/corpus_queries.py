"""Extraction from ``documents`` and ``pages``: sentences, chunks, HTML, formulas, headings, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import text as T
from texloom.operators import chunking as C
from texloom.operators import pages as P

from .registry import Tables, query

SENT = """list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))),
  lambda x: length(x) >= 11 and not regexp_matches(x, '(et al\\.|Fig\\.|Tab\\.|Eq\\.)$'))"""


@query(f"select doc_id, cast(i - 1 as int) as position, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {SENT} as s from documents))")
def sentences(t: Tables):
    return t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


CHUNKS = f"""with recursive l as (select doc_id, {SENT} as s from documents),
q as (select doc_id, i, length(s[i]) as x from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from l)),
r(doc_id, i, st, n, size, last, done, es, en, ez) as (
  select doc_id, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint) from l
  union all
  select r.doc_id, r.i + 1,
    case when f then case when a then st + n - 1 else st + n end else st end, case when f then case when a then 2 else 1 end else n + 1 end,
    case when f then case when a then last + x else x end else size + x end, x, case when f then done + 1 else done end,
    case when f then st end, case when f then n end, case when f then size end
  from (select r.*, q.x, (size + q.x > 1500 and n > 0 and size > 100) as f, (done > 0 and n > 1) as a from r join q on q.doc_id = r.doc_id and q.i = r.i + 1) r),
k as (select doc_id, done - 1 as chunk_index, es as st, en as n, ez as size from r where en is not null
  union all select doc_id, done, st, n, size from (select *, row_number() over (partition by doc_id order by i desc) as z from r) where z = 1 and n > 0),
c as (select k.doc_id, chunk_index, array_to_string(s[st + 1 : st + n], ' ') as chunk_text, n as sentence_count, size as char_count,
  right(array_to_string(s[greatest(st - 1, 1) : st], ' '), 200) as context_before, left(array_to_string(s[st + n + 1 : st + n + 2], ' '), 200) as context_after
  from k join l on k.doc_id = l.doc_id where size >= 100),
d as (select *, regexp_matches(chunk_text, '[=∑∫≤≥±]') or regexp_matches(chunk_text, '(?i)\\b(figure|fig\\.)\\s*[0-9]+') as marked from c)"""


@query(f"{CHUNKS} select doc_id, cast(chunk_index as int) as chunk_index, md5(chunk_text) as chunk_md5, sentence_count, char_count from c")
def chunks_greedy(t: Tables):
    return C.chunked(t.documents).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"), "sentence_count", "char_count")


@query(f"{CHUNKS} select doc_id, cast(chunk_index as int) as chunk_index, context_before, context_after from c")
def chunk_context(t: Tables):
    return C.chunked(t.documents).select("doc_id", "chunk_index", "context_before", "context_after")


@query(f"{CHUNKS} select doc_id, count(*) as chunk_count, round(avg(char_count), 6) as avg_size, min(char_count) as min_size, max(char_count) as max_size, count(*) filter (marked) as marked, round(least(10.0, 6 * least(1.0, avg(char_count) / 800) + 4 * count(*) filter (marked) / count(*)), 6) as quality from d group by doc_id")
def chunk_stats(t: Tables):
    s = C.chunk_statistics(C.chunked(t.documents))
    return s.select("doc_id", "chunk_count", F.round("avg_size", 6).alias("avg_size"), "min_size", "max_size", "marked", F.round("quality", 6).alias("quality"))


CLEAN = "html"
for _tag in P.REMOVED:
    CLEAN = f"regexp_replace({CLEAN}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', '', 'g')"
CLEAN = f"trim(regexp_replace(regexp_replace({CLEAN}, '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select page_id, length({CLEAN}) as clean_chars, md5({CLEAN}) as clean_md5 from pages")
def html_clean(t: Tables):
    out = P.cleaned(F.col("html"))
    return t.pages.select("page_id", F.length(out).cast("long").alias("clean_chars"), F.md5(out).alias("clean_md5"))


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""select page_id, cast(i - 1 as int) as position, cast(substring(h[i], 2, 1) as int) as level, {_plain("regexp_replace(h[i], '(?s)^h[1-6]\\b[^>]*>', '')")} as title
from (select page_id, h, unnest(range(1, len(h) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)<(h[1-6]\\b[^>]*>.*?)</h[1-6]\\s*>', 1) as h from pages))""")
def html_headings(t: Tables):
    return P.headings(t.pages)


@query(f"""select page_id, cast(i - 1 as int) as position, md5(x) as text_md5, cast(len(string_split(x, ' ')) as bigint) as word_count
from (select page_id, i, {_plain("h[i]")} as x from (select page_id, h, unnest(range(1, len(h) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1) as h from pages))) where length(x) >= 10""")
def html_paragraphs(t: Tables):
    return P.paragraphs(t.pages).select("page_id", "position", F.md5("text").alias("text_md5"), "word_count")


@query(f"""select page_id, (cast(regexp_matches(html, '(?i)<meta[^>]*name="citation_') as int) + cast(regexp_matches(html, '(?i)<div[^>]*class="[^"]*page-main') as int) + cast(regexp_matches(html, '(?i)<article\\b') as int)
+ cast(contains(html, 'arxiv.org') as int) + cast(regexp_matches(html, '(?is)<title\\b[^>]*>\\s*[^<\\s]') as int)) >= 2 and length({_plain(CLEAN)}) >= 1000 as valid from pages""")
def html_validity(t: Tables):
    return t.pages.select("page_id", P.validity(F.col("html")).alias("valid"))


@query("select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, md5(url) as url_md5, sha256(html) as content_hash from pages")
def url_parts(t: Tables):
    return t.pages.select("page_id", *P.url_parts(F.col("url")), F.md5("url").alias("url_md5"), F.sha2("html", 256).alias("content_hash"))


# the pages have headings only; no figure, table or formula
@query("""select page_id, cast(i - 1 as int) as position, 'section' as kind, cast(substring(h[i], 2, 1) as int) as level,
regexp_replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(h[i], '(?s)^h[1-6]\\b[^>]*>', ''), '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') as text, regexp_extract(h[i], '^h[1-6]\\b[^>]*\\bid="([^"]*)"', 1) as label
from (select page_id, h, unnest(range(1, len(h) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)<(h[1-6]\\b[^>]*>.*?)</h[1-6]\\s*>', 1) as h from pages))""")
def page_structure(t: Tables):
    return P.structure(t.pages)


_CASE = " ".join("when " + " or ".join(f"contains(lower(x), '{k}')" for k in keys) + f" then '{name}'" for name, keys in T.CANONICAL)


@query(f"""select doc_id, case {_CASE} else 'other' end as canonical from (select doc_id, case doc_id % 5 when 0 then '1 Introduction' when 1 then 'Results' when 2 then 'Summary of ' || source when 3 then 'Future Work' else source end as x from documents)""")
def canonical_section(t: Tables):
    kind = F.col("doc_id") % 5
    title = F.when(kind == 0, "1 Introduction").when(kind == 1, "Results").when(kind == 2, F.concat(F.lit("Summary of "), "source")).when(kind == 3, "Future Work").otherwise(F.col("source"))
    return t.documents.select("doc_id", T.canonical_section(title).alias("canonical"))
