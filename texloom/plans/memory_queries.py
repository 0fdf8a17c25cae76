"""Conversation history and statistics, answer scoring and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import evaluation as E
from texloom.operators import memory as M

from .registry import Tables, query


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) where r <= 3")
def history_first_n(t: Tables):
    return M.first_messages(t.conversations, 3).select("conv_id", "turn", "role")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3")
def history_last_n(t: Tables):
    return M.last_messages(t.conversations, 3).select("conv_id", "turn", "role")


@query("select conv_id, count(*) as message_count, count(*) filter (role = 'user') as user_messages, count(*) filter (role in ('agent', 'assistant', 'ai')) as agent_messages from conversations group by conv_id")
def user_stats(t: Tables):
    return M.user_stats(t.conversations)


@query("select 'user_' || conv_id as session_id, min(turn) as first_turn from conversations group by conv_id union all select 'user_' || doc_id, null from labels where 'user_' || doc_id not in (select 'user_' || conv_id from conversations)")
def get_or_create(t: Tables):
    sessions = t.conversations.groupBy(F.concat(F.lit("user_"), "conv_id").alias("session_id")).agg(F.min("turn").alias("first_turn"))
    return M.get_or_create(sessions, t.labels.select(F.concat(F.lit("user_"), "doc_id").alias("session_id")))


@query("select 'user_' || conv_id as session_id, count(*) as n from conversations where not starts_with('user_' || conv_id, 'user_1') group by 1")
def delete_prefix(t: Tables):
    named = t.conversations.withColumn("session_id", F.concat(F.lit("user_"), "conv_id"))
    return M.delete_by_prefix(named, "user_1").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, strftime(timestamp '2024-01-01 00:00:00' + to_days(cast(7 * conv_id as int)) + to_minutes(cast(2 * turn as int)), '%Y-%m-%d %H:%M:%S') as at from conversations")
def turn_timestamps(t: Tables):
    at = M.turn_time(M.session_time(F.lit("n/a"), F.col("conv_id")), F.col("turn"))
    return t.conversations.select("conv_id", "turn", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


W = "list_distinct(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"
REFUSED = " or ".join(f"contains(a, '{p.replace(chr(39), chr(39) * 2)}')" for p in E.REFUSALS)
SCORED = f"""with p as (select conv_id, turn, role, role as kind, trim(lower(coalesce(text, ''))) as a, trim(lower(coalesce(lag(text) over (partition by conv_id order by turn), ''))) as t from conversations),
s as (select conv_id, turn, kind, case when t = a then 1.0 when contains(a, t) then 0.8 when {REFUSED} then 0.0
 when len({W.format('t')}) = 0 then 0.0 else len(list_intersect({W.format('t')}, {W.format('a')})) / cast(len({W.format('t')}) as double) end as score, cast(length(a) as double) as latency_ms from p)"""


def _scored(t: Tables):
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = t.conversations.select("conv_id", "turn", F.col("role").alias("kind"), before.alias("t"), F.coalesce("text", F.lit("")).alias("a"))
    return rows.select("conv_id", "turn", "kind", E.answer_match(F.col("t"), F.col("a")).alias("score"), F.length(F.btrim(F.lower("a"))).cast("double").alias("latency_ms"))


@query(f"{SCORED} select conv_id, turn, round(score, 6) as score from s")
def answer_match(t: Tables):
    return _scored(t).select("conv_id", "turn", F.round("score", 6).alias("score"))


@query(f"{SCORED} select count(*) as total, round(avg(latency_ms), 6) as mean_latency, round(median(latency_ms), 6) as median_latency, round(avg(score), 6) as mean_score, round(median(score), 6) as median_score from s")
def eval_metrics(t: Tables):
    m = E.metrics(_scored(t))
    return m.select("total", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"{SCORED} select cast(b as int) as bin, count(score) as n from (select unnest(range(5)) as b) left join s on case when b = 0 then score >= 0 and score <= 0.2 else score > b * 0.2 and score <= (b + 1) * 0.2 end group by b")
def eval_bins(t: Tables):
    return E.score_bins(_scored(t).select(F.round("score", 6).alias("score")))


@query(f"{SCORED} select kind, count(*) as n, round(avg(score), 6) as mean, round(stddev(score), 6) as std, round(quantile_cont(score, 0.95), 6) as p95, round(100.0 * count(*) / (select count(*) from s), 6) as percent from s group by kind")
def eval_by_type(t: Tables):
    r = E.by_type(_scored(t), "kind")
    return r.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p95", "percent")])


@query("select * from (select doc_id, n_chars, 'best' as side from documents order by n_chars desc, doc_id limit 5) union all select * from (select doc_id, n_chars, 'worst' from documents order by n_chars, doc_id limit 5)")
def best_worst(t: Tables):
    return E.best_and_worst(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 5)


DRAWN = "select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || '42'), doc_id) as r, count(*) over (partition by lang) as n from documents"


@query(f"select doc_id, lang from ({DRAWN}) where r <= greatest(1, floor(n * 0.1))")
def stratified_quota(t: Tables):
    return E.stratified(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.1)


@query(f"select doc_id, lang from ({DRAWN}) where r <= 20")
def balanced_sample(t: Tables):
    return E.balanced(t.documents.select("doc_id", "lang"), "lang", "doc_id", 20)
