"""Formulas and phrases by their place in ``documents``, the whole lexicon, streamed messages, deletes that cascade."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.operators import chunking, citations, corpus, intervals, memory, phrases
from texloom.operators import entities as E
from texloom.streaming import deltas, sinks

from .corpus_queries import CHUNKS
from .registry import Tables, query

#: Formulas between single dollar signs.
FORMULA = r"\$[^$]+\$"
PLACED = f"""p as (select doc_id, string_split_regex(text, '{FORMULA}') as g, regexp_extract_all(text, '({FORMULA})', 1) as m from documents),
f as (select doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, m[i] as f from (select doc_id, g, m, unnest(range(1, len(m) + 1)) as i from p))"""


@query(f"with {PLACED} select doc_id, cast(s as bigint) as start_at, cast(s + length(f) as bigint) as end_at, f as formula from f")
def formula_places(t: Tables):
    return intervals.located(t.documents, FORMULA).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("match").alias("formula"))


CUT = "w as (select doc_id, p as part, 600 * p as s, least(600 * p + 800, n) as e from (select doc_id, n, unnest(range(0, cast(greatest(0, ceil((n - 800) / 600.0)) as bigint) + 1)) as p from (select doc_id, length(text) as n from documents where length(text) > 0)))"


@query(f"with {PLACED}, {CUT} select f.doc_id, cast(part as int) as part, cast(f.s as bigint) as start_at, f as formula from f join w on f.doc_id = w.doc_id and f.s >= w.s and f.s + length(f) <= w.e")
def formula_in_chunk(t: Tables):
    """Formulas with the overlapping pieces of 800 characters in which they lie whole."""
    pairs = intervals.overlapping(intervals.located(t.documents, FORMULA), intervals.windows(t.documents, 800, 600), "doc_id", 500, inside=True)
    return pairs.select("doc_id", F.col("right_part").alias("part"), F.col("left_start").alias("start_at"), F.col("left_match").alias("formula"))


@query(f"with {PLACED}, {CUT} select w.doc_id, cast(part as int) as part, count(f.s) as formulas from w left join f on f.doc_id = w.doc_id and f.s < w.e and w.s < f.s + length(f) group by 1, 2 having count(f.s) > 0")
def formulas_per_chunk(t: Tables):
    """How many formulas each piece has a share of."""
    pairs = intervals.overlapping(intervals.located(t.documents, FORMULA), intervals.windows(t.documents, 800, 600), "doc_id", 500)
    return pairs.groupBy("doc_id", F.col("right_part").alias("part")).agg(F.count(F.lit(1)).alias("formulas"))


_NAMES = "(select distinct unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) as phrase from benchmark)"


@query(f"select phrase, count(*) as n, min(doc_id) as first_doc from {_NAMES} join documents on contains(lower(text), phrase) group by 1")
def phrase_documents(t: Tables):
    """Every word of the benchmark, wherever it stands in a document, also within a word."""
    low = F.lower(F.replace("text", F.lit("İ"), F.lit("i")))  # which Spark alone makes two characters
    names = t.benchmark.select(F.explode(F.split(low, "[^a-z]+")).alias("phrase")).where("length(phrase) >= 3").distinct()
    found = phrases.matches(t.documents.select("doc_id", low.alias("text")), names.withColumn("phrase_id", F.col("phrase")))
    return found.groupBy(F.col("phrase_id").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


#: Word borders are those of any script, which this SQL reads only as ASCII: letters beyond it stand as underscores, but for a pattern that takes text along.
_BORDERED = "regexp_replace(text, '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}]', '_', 'g')"
_BOOST = lambda words: " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in words)


def _mentions(key: str, source: str) -> str:
    """SQL of the tables m and e: all matches of the lexicon in the rows of ``source`` (``key``, text), and those kept, with their confidence c."""
    each = " union all ".join(
        f"select {key}, '{kind}' as entity_type, unnest(regexp_extract_all({'text' if '[^.]' in pattern else _BORDERED}, '(?i)({pattern})', 1)) as x, {_BOOST(context)} as boost from {source}" for kind, pattern, context in E.LEXICON
    )
    c = "least(1.0, 0.5 + case when regexp_matches(x, '^[A-Z]') then 0.2 else 0 end + case when contains(x, ' ') then 0.1 else 0 end + 0.1 * boost)"
    return f"m as ({each}), e as (select *, {c} as c from m where length(x) >= 3 and lower(x) not in ('the', 'and', 'or', 'in', 'on', 'at'))"


LEXICON = f"with {_mentions('doc_id', 'documents')}"


def _lexicon(t: Tables) -> DataFrame:
    return E.mentions(t.documents.select("doc_id", F.col("doc_id").alias("chunk_id"), "text"))


@query(f"{LEXICON} select doc_id, entity_type, lower(x) as normalized, count(*) as mention_count, round(cast(max(c) as double), 6) as confidence from e group by 1, 2, 3")
def lexicon_entities(t: Tables):
    """The whole lexicon over all documents."""
    return E.merged(_lexicon(t)).select("doc_id", "entity_type", "normalized", "mention_count", F.round("confidence", 6).alias("confidence"))


_PHRASES = " union ".join(f"select doc_id, '{kind}' as relationship, unnest(regexp_extract_all(text, '(?i)({p})', 1)) as context from documents" for kind, ps in E.RELATIONS.items() for p in ps)


@query(f"""{LEXICON}, p as ({_PHRASES}), n as (select distinct doc_id, lower(x) as normalized from e),
x as (select distinct p.doc_id, relationship, context, normalized from p join n on p.doc_id = n.doc_id and contains(lower(context), normalized))
select doc_id, relationship, context, list_sort(list(normalized)) as entities from x group by 1, 2, 3""")
def lexicon_phrases(t: Tables):
    """Phrases of all relationships that name an entity of the lexicon, and the entities."""
    found = E.merged(_lexicon(t)).select("doc_id", "normalized").distinct()
    said = E.phrases(t.documents)
    both = said.join(found, "doc_id").where(F.contains(F.lower("context"), F.col("normalized")))
    return both.groupBy("doc_id", "relationship", "context").agg(F.array_sort(F.collect_set("normalized")).alias("entities"))


_CITED = " + ".join("len(regexp_extract_all(coalesce(text, ''), '{}'))".format(p.replace("'", "''")) for p in citations.IN_TEXT.values())


@query(f"""{CHUNKS}, {_mentions("doc_id, chunk_index", "(select doc_id, chunk_index, chunk_text as text from c)")},
ck as (select doc_id, count(*) as chunks, min(char_count) as lo, max(char_count) as hi from c group by 1),
cn as (select doc_id, count(*) as entities, min(c) as least from (select doc_id, entity_type, lower(x), max(c) as c from e group by 1, 2, 3) group by 1),
co as (select c.doc_id, count(*) as orphans from c left join (select distinct doc_id, chunk_index from e) h on h.doc_id = c.doc_id and h.chunk_index = c.chunk_index where h.doc_id is null group by 1),
cf as (select d.doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S'))) as sections, len(regexp_extract_all(coalesce(text, ''), '{FORMULA}')) as math, {_CITED} as cites,
 coalesce(chunks, 0) as chunks, lo, hi, coalesce(entities, 0) as entities, least, coalesce(orphans, 0) as orphans from documents d left join ck on ck.doc_id = d.doc_id left join cn on cn.doc_id = d.doc_id left join co on co.doc_id = d.doc_id),
cs as (select doc_id, ((case when sections >= 5 then 100 else 0 end) + (case when sections = 0 then 0 else 70 end) + (case when chunks >= 10 then 100 else 0 end) + (case when math > 0 then 100 else 80 end) + (case when cites >= 3 then 100 else 0 end) + (case when entities >= 5 then 100 else 70 end)) / 6.0 as cm,
 ((case when lo < 100 then 80 when hi > 2000 then 85 else 100 end) + (case when least < 0.3 then 75 else 100 end) + (case when cites = 0 then 50 else 100 end)) / 3.0 as qu,
 ((case when orphans > 0 then 85 else 100 end) + (case when math > 0 and cites > 0 and chunks > 0 and entities > 0 then 100 else 60 end)) / 2.0 as it from cf)
select doc_id, round(cm, 6) as completeness, round(qu, 6) as quality, round(it, 6) as integrity, round(0.4 * cm + 0.4 * qu + 0.2 * it, 6) as overall from cs""")
def validation_extracted(t: Tables):
    """Validation of every document on what the library itself finds in it: lines, formulas, citations, chunks, entities, chunks without any."""
    docs = t.documents.select("doc_id", "text")
    chunks = chunking.chunked(docs).select("doc_id", "chunk_index", "chunk_text", "char_count")
    found = E.mentions(chunks, chunk_id="chunk_index", text="chunk_text")
    orphans = F.count_if(F.size("mentions") == 0).alias("orphan_chunks")
    sizes = E.with_mentions(chunks, text="chunk_text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("char_count").alias("min_chunk"), F.max("char_count").alias("max_chunk"), orphans)
    names = E.merged(found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("entity_count"), F.min("confidence").alias("min_confidence"))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S")))
    counted = corpus.counted(docs, {"math": intervals.located(docs, FORMULA), "citation": citations.in_text(docs)})
    facts = reduce(lambda a, b: a.join(b, "doc_id", "left"), [sizes, names], docs.select("doc_id", lines.alias("section_count")).join(counted, "doc_id", "left"))
    had = {"math_processing": "math_count", "citation_parsing": "citation_count", "content_chunking": "chunk_count", "entity_extraction": "entity_count"}
    stages = F.array_compact(F.array(F.lit("document_structure"), *[F.when(F.col(c) > 0, stage) for stage, c in had.items()]))
    shares = {"author_share": F.lit(None).cast("double"), "title_share": F.lit(None).cast("double")}  # of references, of which there are none
    v = corpus.validated(facts.withColumns({"section_types": F.array().cast("array<string>"), "stages": stages, **shares}))
    return v.select("doc_id", *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "integrity", "overall")])


SPOKEN = "select conv_id, turn as msg, coalesce(text, '') as text, cast(greatest(1, ceil(length(coalesce(text, '')) / 40.0)) as int) as n_deltas from conversations"


def _spoken(conversations: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") % 1000 * 3 + F.col("turn"))
    return deltas.cut(conversations.select("conv_id", F.col("turn").cast("long").alias("msg"), "text", at.alias("at")), 40)


@query(SPOKEN)
def message_deltas(t: Tables):
    """Turns cut to deltas of 40 characters, and put together again."""
    return deltas.assembled(_spoken(t.conversations)).select("conv_id", "msg", "text", "n_deltas")


@query(SPOKEN)
def message_deltas_stream(t: Tables):
    """The same through keyed state and a sink that may run twice."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(setting)
    folder = f"{t.spark.conf.get('spark.sql.warehouse.dir')}/texloom_messages_{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.conversations.schema).parquet(f"{t.sf_dir}/conversations.parquet*")
    t.spark.conf.set(setting, deltas.STATE_STORE)
    try:
        sinks.run(deltas.accumulated(_spoken(stream)), sinks.upsert(f"{folder}/messages", ["conv_id", "msg"], "at"), f"{folder}/checkpoint")
    finally:
        t.spark.conf.set(setting, before)
    return t.spark.read.parquet(f"{folder}/messages").select("conv_id", "msg", "text", "n_deltas")


def _store(t: Tables) -> tuple[dict[str, DataFrame], list[tuple[str, str, str, str]]]:
    """Users, their sessions and messages, and vectors of sessions, of the conversations and embeddings."""
    sessions = t.conversations.select("conv_id").distinct().select(F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"), "conv_id", F.concat(F.lit("user_"), F.col("conv_id") % 23).alias("user_id"))
    messages = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"))
    vectors = t.embeddings.select("vec_id", F.concat_ws("-", F.col("vec_id") % 100, F.lit(0)).alias("message_id"))
    tables = {"user": sessions.select("user_id").distinct(), "session": sessions.select("session_id", "user_id"), "message": messages, "vector": vectors}
    return tables, [("session", "user_id", "user", "user_id"), ("message", "session_id", "session", "session_id"), ("vector", "message_id", "message", "message_id")]


def _named(left: dict[str, DataFrame]) -> DataFrame:
    names = {"user": "user_id", "session": "session_id", "message": "message_id", "vector": "vec_id"}
    return reduce(DataFrame.unionByName, [left[n].select(F.lit(n).alias("part_of"), F.col(c).cast("string").alias("id")) for n, c in names.items()])


_STORE = """s as (select distinct 's' || conv_id as session_id, 'user_' || conv_id % 23 as user_id from conversations), m as (select conv_id || '-' || turn as message_id, 's' || conv_id as session_id from conversations),
v as (select vec_id, (vec_id % 100) || '-0' as message_id from embeddings)"""
_LEFT = """ks as (select * from s where session_id not in (select session_id from gone)), km as (select * from m where session_id not in (select session_id from gone)),
gm as (select message_id from m where session_id in (select session_id from gone)), kv as (select * from v where message_id not in (select message_id from gm))"""


@query(f"""with {_STORE}, gone as (select session_id from s where starts_with(user_id, 'user_1')), {_LEFT}
select 'user' as part_of, user_id as id from (select distinct user_id from s) where not starts_with(user_id, 'user_1') union all select 'session', session_id from ks
union all select 'message', message_id from km union all select 'vector', cast(vec_id as varchar) from kv""")
def cascade_by_prefix(t: Tables):
    """What stays when the users of a prefix go, with their sessions, messages and vectors."""
    tables, links = _store(t)
    return _named(memory.cascade(tables, links, "user", tables["user"].where(F.col("user_id").startswith("user_1"))))


@query(f"""with {_STORE}, gone as (select session_id from s where user_id = 'user_7'), {_LEFT}
select 'user' as part_of, user_id as id from (select distinct user_id from s) union all select 'session', session_id from ks
union all select 'message', message_id from km union all select 'vector', cast(vec_id as varchar) from kv""")
def cascade_by_user(t: Tables):
    """What stays when one user's sessions go, with their messages and vectors."""
    tables, links = _store(t)
    return _named(memory.cascade(tables, links, "session", tables["session"].where("user_id = 'user_7'")))
