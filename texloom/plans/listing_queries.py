"""What a document has and lacks: chains of tables, joins that ask only whether, selection, issues, sections and numbered formulas, listings with context."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import chunking, citations, corpus, facade, intervals
from texloom.operators import pages as P
from texloom.sources import chains

from .corpus_queries import CHUNKS, CLEAN, _plain
from .place_queries import _CITED, FORMULA, PLACED
from .registry import ORACLE_SQL, Tables, query


@query(f"with {PLACED} select doc_id, f as latex, cast(0 as int) as position, 'equation' as kind, cast(0 as int) as complexity from f")
def formulas_or_raw(t: Tables):
    """Processed formulas if there is a table of them, else those of the texts with constants for the rest."""
    processed = lambda: t.processed_formulas.select("doc_id", "latex", "position", "kind", "complexity")
    raw = lambda: intervals.located(t.documents, FORMULA).select("doc_id", F.col("match").alias("latex"), F.lit(0).alias("position"), F.lit("equation").alias("kind"), F.lit(0).alias("complexity"))
    return chains.first_of([processed, raw])


@query("select 'labels' as found_in, min(doc_id) as doc_id from labels where toxic = 1")
def first_processed(t: Tables):
    """Whether any document is done, asked of one table after the other: one that is not there, one without such rows, one with."""
    asked = {"downloads": lambda: t.downloads.where("success"), "conversations": lambda: t.conversations.where("role = 'tool'").select(F.col("conv_id").alias("doc_id")), "labels": lambda: t.labels.where("toxic = 1"), "documents": lambda: t.documents}
    rows = chains.first_of([lambda name=name, ask=ask: ask().select("doc_id", F.lit(name).alias("found_in")) for name, ask in asked.items()], skip_empty=True)
    return rows.groupBy("found_in").agg(F.min("doc_id").alias("doc_id"))


@query(f"""with {PLACED}, l as (select doc_id, 'label' as origin, cast(quality as varchar) as value from labels where quality = 0),
x as (select doc_id, 'formula' as origin, f as value from f), d as (select doc_id, 'source' as origin, source as value from documents)
select * from l union all select * from x where doc_id not in (select doc_id from l) union all select * from d where doc_id not in (select doc_id from l) and doc_id not in (select doc_id from x)""")
def described_by_first(t: Tables):
    """Every document by what is known of it first: a label of bad quality, else its formulas, else its source."""
    labels = t.labels.where("quality = 0").select("doc_id", F.lit("label").alias("origin"), F.col("quality").cast("string").alias("value"))
    found = intervals.located(t.documents, FORMULA).select("doc_id", F.lit("formula").alias("origin"), F.col("match").alias("value"))
    return chains.first_of_each([labels, found, t.documents.select("doc_id", F.lit("source").alias("origin"), F.col("source").alias("value"))], "doc_id")


COMPLETE = f"""select distinct d.doc_id, len(regexp_extract_all(text, '{FORMULA}')) > 0 as has_math, {_CITED} > 0 as has_citations
from documents d join labels l on d.doc_id = l.doc_id where quality = 1 and regexp_matches(text, '\\S')"""


@query(COMPLETE)
def complete_documents(t: Tables):
    """Documents that have lines and a label of good quality, and whether they have formulas and citations."""
    docs = t.documents.select("doc_id", "text")
    required = {"lines": docs.where(F.col("text").rlike(r"\S")), "label": t.labels.where("quality = 1")}
    return corpus.complete(required, {"math": intervals.located(docs, FORMULA), "citations": citations.in_text(docs)})


@query(f"select * from ({COMPLETE}) where has_math order by doc_id limit 1")
def first_complete(t: Tables):
    """The first of them with formulas: one document, the limit being what is asked for."""
    return complete_documents(t).where("has_math").orderBy("doc_id").limit(1)


NAMES = "[A-Z][a-z]+ [A-Z][a-z]+"


@query(f"""with a as (select doc_id, lang, split_part(text, chr(10), 1) as abstract, list_distinct(regexp_extract_all(text, '{NAMES}')) as authors from documents)
select doc_id, len(authors) as n_authors, 5.0 + case when length(abstract) > 0 then 2 else 0 end + case when length(abstract) > 500 then 1 else 0 end + 1.0 + case when len(authors) between 2 and 8 then 0.5 else 0 end as score
from a where lang in ('de', 'fr') and length(abstract) > 0 and len(authors) >= 2""")
def selection_eligible(t: Tables):
    """Documents with a first line and two names or more, of the languages that the caller's function takes, and their scores."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)))
    docs = t.documents.select("doc_id", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("abstract"), names.alias("authors"))
    kept = corpus.eligible(docs, F.col("abstract"), F.col("authors"), 2, predicate=lambda rows: rows["lang"].isin(["de", "fr"]))
    score = corpus.selection_score("metadata_only", F.lit(False), F.lit(False), F.col("abstract"), F.size("authors"), F.lit(0))
    return kept.select("doc_id", F.size("authors").cast("long").alias("n_authors"), score.alias("score"))


ISSUES = """i as (select d.doc_id, x.issue from documents d left join labels l on d.doc_id = l.doc_id,
unnest(list_filter([case when length(text) < 100 then 'short text' end, case when l.doc_id is null then 'no label' end, case when toxic = 1 then 'toxic' end,
 case when contains(text, '$') then 'marked up' end, case when regexp_matches(text, '[#*%]{3}') then 'marked up' end], lambda y: y is not null)) as x(issue))"""


def _issues(t: Tables):
    facts = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("labelled")), "doc_id", "left")
    marks = F.contains("text", F.lit("$")) | F.col("text").rlike("[#*%]{3}")
    return corpus.issues(facts, {"short text": F.length("text") < 100, "no label": F.col("labelled").isNull(), "toxic": F.col("toxic") == 1, "marked up": marks})


@query(f"with {ISSUES} select doc_id, list_sort(list(distinct issue)) as issues from i group by 1")
def document_issues(t: Tables):
    return _issues(t).select("doc_id", F.array_sort("issues").alias("issues"))


@query(f"with {ISSUES} select issue, count(distinct doc_id) as n_rows, min(doc_id) as first_key from i group by 1")
def distinct_issues(t: Tables):
    """The issues of all documents, each once."""
    return corpus.distinct_issues(_issues(t))


@query(f"""select p.page_id, coalesce(found, false) as found, coalesce(body, substring({_plain(f"regexp_replace({CLEAN}, '(?is)<head\\b.*?</head\\s*>', '', 'g')")}, 1, 2000)) as body from pages p
left join (select page_id, true as found, arg_min(body, position) as body from ({ORACLE_SQL["section_bodies"]}) where contains(lower(title), 'the') group by 1) b on p.page_id = b.page_id""")
def section_or_start(t: Tables):
    """The section whose title holds a word, or the beginning of a page that has none."""
    return P.section_or_start(t.pages, "The")


@query(r"""select doc_id, 'math' as kind, cast(row_number() over (partition by doc_id order by i, j) - 1 as int) as position, m[j] as latex, '(' || i || ')' as number
from (select doc_id, i, m, unnest(range(1, len(m) + 1)) as j from (select doc_id, i, regexp_extract_all(s[i], '\$([^$]+)\$', 1) as m from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(text, chr(10)) as s from documents))))""")
def equation_numbers(t: Tables):
    """Formulas of the texts, set as pages whose lines are numbered at their ends, with the number that follows each."""
    safe = F.col("text")
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(char), F.lit(reference))
    line = lambda x, i: F.concat(F.lit("<p>"), F.regexp_replace(x, r"\$([^$]+)\$", '<math alttext="$1">x</math>'), F.lit("</p><span>("), i + 1, F.lit(")</span>"))
    return P.equations(t.documents.select("doc_id", F.array_join(F.transform(F.split(safe, "\n"), line), "").alias("html")), key="doc_id")


CHUNK_TERMS = "list_filter(regexp_split_to_array(lower(chunk_text), '\\s+'), lambda x: x <> '')"


@query(f"""{CHUNKS}, w as (select *, doc_id || '-' || chunk_index as chunk_id, {CHUNK_TERMS} as w from c),
tf as materialized (select *, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as tf0, len(list_filter(w, lambda x: x = 'ening')) as tf1 from w),
st as (select count(*) as n, avg(dl) as avgdl, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1 from tf),
so as (select tf.*, (greatest(ln(n - df0 + 0.5) - ln(df0 + 0.5), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(ln(n - df1 + 0.5) - ln(df1 + 0.5), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf, st where tf0 > 0 and tf1 > 0)
select doc_id, chunk_id, case when length(chunk_text) > 500 then substring(chunk_text, 1, 500) || '...' else chunk_text end as chunk_text, round(score, 3) as relevance_score, context_before, context_after, 'semantic' as match_type
from so order by score desc, chunk_id limit 20""")
def chunk_search(t: Tables):
    """Ranked chunks joined by id to their rows, with what stands before and after each."""
    chunks = chunking.chunked(t.documents).select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", F.col("chunk_text").alias("text"), "context_before", "context_after")
    return facade.Search(chunks).query("the ening", k=20, with_context=True).rows
