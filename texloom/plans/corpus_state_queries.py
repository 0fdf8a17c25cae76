"""Counts, validation, selection, logs, writes, set operations and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from texloom.operators import chunking, corpus

from .corpus_queries import CHUNKS
from .registry import Tables, query


@query(f"{CHUNKS} select d.doc_id, coalesce(a.n, 0) as chunk_count, coalesce(b.n, 0) as label_count from (select distinct doc_id from documents) d left join (select doc_id, count(*) as n from c group by 1) a on d.doc_id = a.doc_id left join (select doc_id, count(*) as n from labels group by 1) b on d.doc_id = b.doc_id")
def metadata_counts(t: Tables):
    return corpus.counted(t.documents, {"chunk": chunking.chunked(t.documents), "label": t.labels})


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def orphans_anti(t: Tables):
    return corpus.orphans(t.documents, t.labels, "doc_id").select("doc_id", "lang")


@query("select user_id, array_to_string(list_sort(list_filter(['click', 'view', 'purchase', 'signup', 'refund'], lambda x: not list_contains(s, x))), ',') as missing from (select user_id, list(distinct event_type) as s from events group by 1)")
def missing_stages(t: Tables):
    wanted = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "refund")))
    return t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", F.array_join(F.array_sort(F.array_except(wanted, "s")), ",").alias("missing"))


@query(f"""{CHUNKS}, f as (select d.doc_id, d.n_chars, coalesce(n, 0) as chunks, lo, hi from documents d left join (select doc_id, count(*) as n, min(char_count) as lo, max(char_count) as hi from c group by 1) x on d.doc_id = x.doc_id),
s as (select doc_id, ((case when n_chars // 400 >= 5 then 100 else 0 end) + (case when n_chars // 400 = 0 then 0 else 70 end) + (case when chunks >= 10 then 100 else 0 end) + 80 + (case when doc_id % 7 >= 3 then 100 else 0 end) + (case when n_chars // 300 >= 5 then 100 else 70 end)) / 6.0 as co,
 ((case when lo < 100 then 80 when hi > 2000 then 85 else 100 end) + 100 + (case when doc_id % 7 = 0 then 50 else 100 end)) / 3.0 as qu, (100 + 60) / 2.0 as it from f)
select doc_id, round(co, 6) as completeness, round(qu, 6) as quality, round(0.4 * co + 0.4 * qu + 0.2 * it, 6) as overall, 0.4 * co + 0.4 * qu + 0.2 * it >= 70 and co >= 60 as ready from s""")
def validation_scores(t: Tables):
    sizes = chunking.chunked(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("char_count").alias("min_chunk"), F.max("char_count").alias("max_chunk"))
    facts = t.documents.join(sizes, "doc_id", "left").select(
        "doc_id", F.floor(F.col("n_chars") / 400).alias("section_count"), F.array(F.lit("abstract"), F.lit("results")).alias("section_types"), "chunk_count", F.lit(0).alias("math_count"),
        (F.col("doc_id") % 7).alias("citation_count"), F.floor(F.col("n_chars") / 300).alias("entity_count"), "min_chunk", "max_chunk", F.lit(0.5).alias("min_confidence"), F.lit(0.9).alias("author_share"),
        F.lit(0.9).alias("title_share"), F.lit(0).alias("orphan_chunks"), F.array(F.lit("content_download")).alias("stages"),
    )
    v = corpus.validated(facts)
    return v.select("doc_id", *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "overall")], "ready")


@query(f"""{CHUNKS} select d.doc_id, d.lang, max(l.quality) as quality, count(chunk_index) as chunks, array_to_string(list_sort(list(cast(char_count as varchar) ) filter (char_count is not null)), ',') as sizes
from documents d left join labels l on d.doc_id = l.doc_id left join c on d.doc_id = c.doc_id group by 1, 2""")
def doc_summary(t: Tables):
    sizes = chunking.chunked(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.array_sort(F.collect_list(F.col("char_count").cast("string"))), ",").alias("sizes"))
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").join(sizes, "doc_id", "left").select("doc_id", "lang", "quality", F.coalesce("chunks", F.lit(0)).alias("chunks"), "sizes")


_P = "(select page_id, starts_with(url, 'https') as h, contains(url, '?') as p, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) as a, cast(page_id % 11 as int) as n, cast(page_id % 3 as int) as c from pages)"
SELECTED = f"(select page_id, case when not h and not p then -1.0 else (case when h then 10.0 else 5.0 end) + (case when length(a) > 0 then 2 else 0 end) + (case when length(a) > 500 then 1 else 0 end) + (case when n > 0 then 1 else 0 end) + (case when n between 2 and 8 then 0.5 else 0 end) + (case when c > 1 then 0.5 else 0 end) end as score, n from {_P})"


def _selected(t: Tables):
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    score = corpus.selection_score("html_preferred", F.col("url").startswith("https"), F.contains("url", F.lit("?")), title, F.col("page_id") % 11, F.col("page_id") % 3)
    return t.pages.select("page_id", score.alias("score"), (F.col("page_id") % 11).cast("int").alias("n"))


@query(f"select page_id, cast(score as double) as score from {SELECTED}")
def selection_score(t: Tables):
    return _selected(t).select("page_id", "score")


@query(f"select page_id, cast(score as double) as score from {SELECTED} where score >= 0 order by score desc, page_id limit 25")
def selection_topn(t: Tables):
    return _selected(t).where("score >= 0").orderBy(F.desc("score"), "page_id").limit(25).select("page_id", "score")


@query(f"select count(*) as total, count(*) filter (score >= 0) as eligible, round(avg(n), 6) as mean_authors, count(distinct n) as author_counts from {SELECTED}")
def selection_summary(t: Tables):
    return _selected(t).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= 0).alias("eligible"), F.round(F.avg("n"), 6).alias("mean_authors"), F.count_distinct("n").alias("author_counts"))


@query("select event_type, count(*) as runs, round(100.0 * avg(case when value > 20 then 1 else 0 end), 6) as success_rate, round(avg(value), 6) as avg_seconds from events group by 1")
def stage_success_rate(t: Tables):
    r = corpus.stage_rates(t.events, "event_type", F.col("value") > 20, "value")
    return r.select("event_type", "runs", F.round("success_rate", 6).alias("success_rate"), F.round("avg_seconds", 6).alias("avg_seconds"))


@query("select event_type, case when f > 0.5 then 'most runs fail' when f > 0.2 then 'many runs fail' else 'slow' end as advice from (select event_type, 1 - avg(case when value > 20 then 1 else 0 end) as f, avg(value) as v from events group by 1) where f > 0.2 or v > 300")
def stage_advice(t: Tables):
    return corpus.recommendations(corpus.stage_rates(t.events, "event_type", F.col("value") > 20, "value"), "event_type")


@query("select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def latest_wins_upsert(t: Tables):
    rows = corpus.latest(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("select event_id from events where ts + interval 3600 second > (select max(ts) - interval 1 day from events)")
def ttl_cache_read(t: Tables):
    now = t.events.agg(F.max("ts")).first()[0]
    return corpus.unexpired(t.events, F.lit(now) - F.expr("interval 1 day")).select("event_id")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select doc_id from documents union select doc_id from labels")
def set_union(t: Tables):
    return t.documents.select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("select doc_id from documents intersect select doc_id from labels where quality = 1")
def set_intersect(t: Tables):
    return t.documents.select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("select doc_id from documents except select doc_id from labels")
def set_except(t: Tables):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("select source, longest from (select source, max(n_chars) as longest from documents group by 1) order by longest desc, source limit 5")
def distinct_ordered(t: Tables):
    return t.documents.groupBy("source").agg(F.max("n_chars").alias("longest")).orderBy(F.desc("longest"), "source").limit(5)


@query("select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'embeddings', count(*) from embeddings union all select 'conversations', count(*) from conversations")
def store_counts(t: Tables):
    names = ("documents", "pages", "embeddings", "conversations")
    each = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("select doc_id, '[' || array_to_string(list_transform(list_slice(s, 1, 3), lambda x: x), '] [') || ']' as marked from (select doc_id, regexp_extract_all(text, '(?i)\\b(erth[a-z]*)\\b', 1) as s from documents) where len(s) > 0")
def snippet_marks(t: Tables):
    found = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"(?i)\b(erth[a-z]*)\b"), F.lit(1)).alias("s")).where("size(s) > 0")
    return found.select("doc_id", F.concat(F.lit("["), F.array_join(F.slice("s", 1, 3), "] ["), F.lit("]")).alias("marked"))


# Windows on event time: additions to what the reference offers.
@query("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def tumbling_counts(t: Tables):
    w = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("select strftime(s, '%Y-%m-%d %H') as start, count(*) as n from (select unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) as s from events) group by 1")
def sliding_counts(t: Tables):
    w = t.events.groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "n")


@query("""with a as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 1 else 0 end as g, event_id from events),
b as (select user_id, ts, sum(g) over (partition by user_id order by ts, event_id) as s from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from b group by user_id, s""")
def sessionize(t: Tables):
    w = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return w.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select p.event_id, v.last_view from (select * from events where event_type = 'purchase') p left join lateral (select max(ts * 1) as x, arg_max(event_id, (epoch_us(ts), event_id)) as last_view from events v where v.event_type = 'view' and v.user_id = p.user_id and v.ts <= p.ts) v on true".replace("max(ts * 1) as x, ", ""))
def asof_last_event(t: Tables):
    """The last view of the same user before each purchase: one sort of a user's events, no pairs."""
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    at = F.max(F.when(view.isNotNull(), F.struct("ts", "event_id"))).over(w)
    rows = t.events.where(F.col("event_type").isin("view", "purchase")).withColumn("at", at)
    return rows.where("event_type = 'purchase'").select("event_id", F.col("at.event_id").alias("last_view"))


