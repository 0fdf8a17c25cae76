"""Conversation store: sessions, messages, history, statistics, and dataset loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names under which the answering side writes (fixed values).
AGENT_ROLES = ("agent", "assistant", "ai")


def first_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The oldest n of each session; the limit acts in every task before the shuffle."""
    w = Window.partitionBy(session).orderBy(order)
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def last_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest n of each session, all if n is 0."""
    if n == 0:
        return messages
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def user_stats(messages: DataFrame, session: str = "conv_id", role: str = "role") -> DataFrame:
    """Per session: messages, those of the user, those of the agent under any of its names."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("message_count"), F.count_if(F.col(role) == "user").alias("user_messages"), F.count_if(F.col(role).isin(*AGENT_ROLES)).alias("agent_messages"))


def get_or_create(sessions: DataFrame, wanted: DataFrame, key: str = "session_id") -> DataFrame:
    """``sessions`` and a row for each wanted key that is not there."""
    return sessions.unionByName(wanted.dropDuplicates([key]).join(sessions, key, "left_anti"), allowMissingColumns=True)


def delete_by_prefix(messages: DataFrame, prefix: str, key: str = "session_id") -> DataFrame:
    """What stays when the sessions whose key starts with ``prefix`` go; null keys stay."""
    return messages.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def session_time(text: Column, index: Column) -> Column:
    """The time of a session from one of three formats, else a week per session from 1 January 2024."""
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(text, r"\([A-Za-z]+\)", ""), r"\s+", " "))
    read = F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f)) for f in ("yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")], F.try_to_timestamp(F.regexp_extract(tidy, r"^(\d{4}/\d{2}/\d{2})", 1), F.lit("yyyy/MM/dd")))
    return F.coalesce(read, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(index * 7).cast("int")))


def turn_time(session: Column, turn: Column) -> Column:
    """Two minutes a turn."""
    return session + F.make_dt_interval(mins=(turn * 2).cast("int"))


def exploded_sessions(tests: DataFrame) -> DataFrame:
    """Rows of question_id, session_idx, turn_idx, role, content, timestamp from haystack_dates and haystack_sessions."""
    sessions = tests.select("question_id", F.posexplode(F.arrays_zip("haystack_dates", "haystack_sessions")).alias("session_idx", "s"))
    turns = sessions.select("question_id", "session_idx", session_time(F.col("s.haystack_dates"), F.col("session_idx")).alias("at"), F.posexplode("s.haystack_sessions").alias("turn_idx", "m"))
    return turns.select("question_id", "session_idx", "turn_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"), turn_time(F.col("at"), F.col("turn_idx")).alias("timestamp"))


def recent_context(vectors: DataFrame, query: list[float], user: str, k: int = 20, as_of: Column | None = None, self_id: int | None = None) -> DataFrame:
    """The k nearest messages of one user (vec_id, user_id, embedding, at), the query itself left out; similarity halves
    after a day if ``as_of`` is given."""
    from .retrieval import squared_l2

    own = vectors.where(F.col("user_id") == user)
    if self_id is not None:
        own = own.where(F.col("vec_id") != self_id)
    similarity = 1 / (1 + squared_l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    if as_of is not None:
        similarity = similarity * F.when(as_of - F.col("at") > F.expr("interval 1 day"), 0.5).otherwise(1.0)
    return own.select("vec_id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """What stays of every table when the rows ``doomed`` of the table ``root`` go, with all that hangs on them.

    ``links``: (child, its column, parent, the parent's column), parents before children. ``doomed`` has the root's columns that
    its children name, and is matched by all columns that it has. A row of a child goes if one of its parents does; null refers to nothing.
    """
    gone = {root: doomed}
    left = dict(tables)
    keys = doomed.columns
    left[root] = tables[root].join(doomed.dropDuplicates(keys), keys, "left_anti").select(*tables[root].columns)
    for child, column, parent, name in links:
        if parent in gone:
            ids = gone[parent].select(F.col(name).alias(column)).where(F.col(column).isNotNull()).distinct()
            columns = tables[child].columns
            lost = left[child].join(ids, column, "left_semi").select(*columns)
            gone[child] = gone[child].unionByName(lost) if child in gone else lost
            left[child] = left[child].join(ids, column, "left_anti").select(*columns)
    return left
