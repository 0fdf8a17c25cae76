"""Lexicon entities, relationships, formulas and citations over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import formulas as L
from texloom.operators import citations as C
from texloom.operators import entities as E
from texloom.operators import intervals

from .registry import Tables, query

#: Words that occur in the tables stand for the entities.
WORDS = (("method", r"\b[a-z]*erth[a-z]*\b", ("the", "and")), ("dataset", r"\b[a-z]*ening\b", ("for",)), ("metric", r"\b[a-z]*thble\b", ()))

PATTERNS = [("method", 0, "(?i)(\\b[a-z]*erth[a-z]*\\b)", "cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'and') as int)"), ("dataset", 1, "(?i)(\\b[a-z]*ening\\b)", "cast(contains(lower(text), 'for') as int)"), ("metric", 2, "(?i)(\\b[a-z]*thble\\b)", "0")]
FOUND = "with f as (" + " union all ".join(
    f"select doc_id, '{kind}' as entity_type, {seq} as seq, i - 1 as position, m[i] as entity_text, {boost} as boost from (select doc_id, text, m, unnest(range(1, len(m) + 1)) as i from (select doc_id, text, regexp_extract_all(text, '{pattern}', 1) as m from documents))"
    for kind, seq, pattern, boost in PATTERNS
) + """), g as (select *, least(1.0, 0.5 + case when regexp_matches(entity_text, '^[A-Z]') then 0.2 else 0.0 end + 0.1 * boost) as confidence from f where length(entity_text) >= 3 and lower(entity_text) not in ('the', 'and', 'or', 'in', 'on', 'at')),
e as (select doc_id, entity_type, lower(entity_text) as normalized, count(*) as mention_count, max(confidence) as confidence, arg_min(entity_text, seq * 1000000 + position) as entity_text from g group by 1, 2, 3)"""  # fmt: skip


def _found(t: Tables):
    return E.mentions(t.documents.select("doc_id", F.col("doc_id").alias("chunk_id"), "text"), WORDS)


@query(f"{FOUND} select doc_id, entity_type, cast(position as int) as position, entity_text, round(cast(confidence as double), 6) as confidence from g")
def entity_mentions(t: Tables):
    return _found(t).select("doc_id", "entity_type", "position", "entity_text", F.round("confidence", 6).alias("confidence"))


@query(f"{FOUND} select doc_id, entity_type, normalized, mention_count, round(cast(confidence as double), 6) as confidence, entity_text, md5(doc_id || '|' || entity_type || '|' || normalized) as entity_id from e")
def entity_dedup(t: Tables):
    return E.merged(_found(t)).select("doc_id", "entity_type", "normalized", "mention_count", F.round("confidence", 6).alias("confidence"), "entity_text", "entity_id")


@query(f"{FOUND} select doc_id, entity_type, normalized, mention_count from e where contains(lower(entity_text), 'erth') or contains(lower(entity_type), 'erth') order by confidence desc, mention_count desc, doc_id, entity_type, normalized limit 20")
def entity_search(t: Tables):
    return E.search(E.merged(_found(t)), ["erth"]).select("doc_id", "entity_type", "normalized", "mention_count")


@query(f"{FOUND} select entity_type, n, mentions, round(c, 6) as avg_confidence, cast(row_number() over (order by n desc, entity_type) as int) as rank from (select entity_type, count(*) as n, cast(sum(mention_count) as bigint) as mentions, avg(confidence) as c from e group by 1)")
def entity_type_stats(t: Tables):
    return E.ranked_types(E.merged(_found(t))).select("entity_type", "n", "mentions", F.round("avg_confidence", 6).alias("avg_confidence"), "rank")


@query(f"{FOUND} select lang, entity_type, count(*) as n from e join documents d on e.doc_id = d.doc_id group by 1, 2 order by n desc, lang, entity_type")
def entity_by_class(t: Tables):
    both = E.merged(_found(t)).join(t.documents.select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "entity_type")


@query(f"{FOUND}, x as (select distinct doc_id, entity_type, normalized from e) select a.doc_id, a.normalized as source, b.normalized as target from x a join x b on a.doc_id = b.doc_id and (a.entity_type, a.normalized) < (b.entity_type, b.normalized)")
def cooccurrence(t: Tables):
    return E.cooccurrence(_found(t)).select("doc_id", F.col("source.name").alias("source"), F.col("target.name").alias("target"))


@query(f"""{FOUND}, p as (select distinct doc_id, unnest(regexp_extract_all(text, '(?i)([^.!?\\n]{{0,80}}\\b(?:with)\\b[^.!?\\n]{{0,80}})', 1)) as context from documents),
x as (select distinct p.doc_id, context, normalized from p join e on p.doc_id = e.doc_id and contains(lower(context), normalized))
select a.doc_id, a.normalized as source, b.normalized as target, md5(a.context) as context_md5 from x a join x b on a.doc_id = b.doc_id and a.context = b.context and a.normalized < b.normalized""")
def relations_pairs(t: Tables):
    return E.relations(t.documents, E.merged(_found(t)), {"uses": (r"[^.!?\n]{0,80}\b(?:with)\b[^.!?\n]{0,80}",)}, apart=r"[.!?\n]").select("doc_id", "source", "target", F.md5("context").alias("context_md5"))


#: What stands between single dollar signs in the documents, cleaned.
MATH = "(select doc_id, trim(regexp_replace(regexp_replace(m, '(?s)^\\$(.*)\\$$', '\\1'), '\\s+', ' ', 'g')) as f from (select doc_id, unnest(regexp_extract_all(text, '(\\$[^$]+\\$)', 1)) as m from documents))"


def _latex(t: Tables):
    return intervals.located(t.documents, r"\$[^$]+\$").select("doc_id", L.cleaned(F.col("match")).alias("f"))


#: Word borders are those of any script, which this SQL reads only as ASCII: letters beyond it stand as underscores.
_B = "regexp_replace(f, '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}]', '_', 'g')"
_G, _FN, _OP, _K = ("|".join(x) for x in (L.GREEK, L.FUNCTIONS, L.OPERATORS, L.CONSTANTS))
_VARS = f"list_distinct(list_concat(regexp_extract_all({_B}, '\\b([a-zA-Z])\\b', 1), regexp_extract_all(f, '\\\\({_G})', 1)))"
_FUNS = f"list_distinct(list_concat(regexp_extract_all(f, '\\\\({_FN})', 1), regexp_extract_all(f, '([a-zA-Z]+)\\s*\\(', 1)))"
_OPS = f"list_distinct(list_concat(regexp_extract_all(f, '\\\\({_OP})', 1), regexp_extract_all(f, '([+\\-*/=<>])', 1)))"
_CONS = f"list_distinct(list_concat(regexp_extract_all(f, '\\\\({_K})', 1), regexp_extract_all({_B}, '\\b([0-9]+(?:\\.[0-9]+)?)\\b', 1)))"


@query(f"""select doc_id, array_to_string(list_sort(v), ',') as variables, array_to_string(list_sort(n), ',') as functions, array_to_string(list_sort(o), ',') as operators, array_to_string(list_sort(c), ',') as constants,
case when length(f) > 50 or contains(f, '\\frac') or contains(f, '\\sum') then 'equation' else 'inline' end as math_type,
round(cast(least(10.0, 0.01 * length(f) + 0.5 * len(v) + len(n) + 0.3 * len(o) + case when contains(f, '\\frac') then 2 else 0 end + case when contains(f, '\\sum') or contains(f, '\\int') then 3 else 0 end + case when contains(f, '\\sqrt') then 1 else 0 end) as double), 6) as complexity
from (select doc_id, f, {_VARS} as v, {_FUNS} as n, {_OPS} as o, {_CONS} as c from {MATH})""")
def latex_features(t: Tables):
    f = F.col("f")
    rows = _latex(t).select("doc_id", "f", L.variables(f).alias("v"), L.functions(f).alias("n"), L.operators(f).alias("o"), L.constants(f).alias("c"), L.kind(f).alias("math_type"))
    return rows.select("doc_id", *[F.array_join(a, ",").alias(b) for a, b in (("v", "variables"), ("n", "functions"), ("o", "operators"), ("c", "constants"))], "math_type", F.round(L.complexity(f, F.size("v"), F.size("n"), F.size("o")), 6).alias("complexity"))


@query(f"select doc_id, f as latex from {MATH} where contains(lower(f), 'an') order by doc_id, f limit 20")
def math_search(t: Tables):
    return _latex(t).where(F.contains(F.lower("f"), F.lit("an"))).orderBy("doc_id", "f").limit(20).select("doc_id", F.col("f").alias("latex"))


@query("select item_id, count(doc_id) as n, min(doc_id) as first_doc from benchmark b left join documents d on contains(d.text, b.text) group by item_id")
def citation_theta(t: Tables):
    return C.quoted(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"))


_CITE = "(select doc_id, 'As shown [' || (doc_id % 5) || ', 3-4] and (Smith, 2020).' as text from documents)"


def _cited(t: Tables):
    text = F.concat(F.lit("As shown ["), (F.col("doc_id") % 5).cast("string"), F.lit(", 3-4] and (Smith, 2020)."))
    cites = C.in_text(t.documents.select("doc_id", text.alias("text")))
    entry = F.when(F.col("position") == 3, "Smith A. \"A title of it\". Journal of Things, 2020").otherwise(F.concat((F.col("position") + 1).cast("string"), F.lit(". Jones B. \"Another title\". 2011")))
    each = t.documents.select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("position"))
    refs = C.parsed(each.withColumn("citation_text", entry)).withColumn("ref_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("position").cast("string")))
    return C.linked(cites, refs)


@query(f"""select doc_id, kind, number, case when number is null then doc_id || '_3' when number between 1 and 4 then doc_id || '_' || (number - 1) end as ref_id
from (select doc_id, 'numeric' as kind, unnest([cast(doc_id % 5 as int), 3, 4]) as number from {_CITE} union all select doc_id, 'author_year', null from {_CITE})
group by all""")
def citation_link_exact(t: Tables):
    return _cited(t).select("doc_id", "kind", "number", "ref_id")


@query(f"select doc_id, round(100.0 * avg(case when number is null or number between 1 and 4 then 1 else 0 end), 6) as link_rate from (select distinct doc_id, unnest([cast(doc_id % 5 as int), 3, 4, null]) as number from {_CITE}) group by doc_id")
def link_rate(t: Tables):
    return C.link_rate(_cited(t)).select("doc_id", F.round("link_rate", 6).alias("link_rate"))
