"""A whole search as one job: cache, source, processing, ranking, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texloom.functions.text import preview
from texloom.operators.retrieval import rank_by

from . import feeds, files

SCHEMA = "title string, url string, content string, score double, rank int, new_score double, new_rank int"


def search(spark: SparkSession, query: str, source: Callable[[str], DataFrame], folder: str, as_of: Column, method: str = "bm25", session: str = "default", chars: int = 2000, page: int = 100) -> DataFrame:
    """The results of a search, ranked by ``method``: title, url, content, score, rank, new_score, new_rank.

    ``source`` gives JSON answers (``body``) for a query. What ``folder`` holds for the same query, method and length, and
    is not older than an hour, answers at once. Otherwise the first ``page`` results of the answers are read, one found twice counts once, contents are
    cut to ``chars``, and they are written as a cache entry; history, results and what is returned are read from that, so the
    source is asked once and no row passes through the driver.
    """
    key = F.md5(F.concat_ws("|", F.lit(query), F.lit(method), F.lit(str(chars)), F.lit(str(page))))
    cache = f"{folder}/cache"

    def held() -> DataFrame:
        return files.cache_get(spark, cache, spark.range(1).select(key.alias("key")), as_of).select(F.from_json("value", f"array<struct<{SCHEMA}>>").alias("results"))

    if not _there(spark, cache) or held().isEmpty():
        first = feeds.web_results(source(query)).orderBy("position").limit(page)  # so many rows at most reach the windows
        found = first.withColumn("rank", F.row_number().over(Window.orderBy("position")))
        once = found.withColumn("again", F.row_number().over(Window.partitionBy("url").orderBy("rank"))).where("again = 1")
        cut = once.select("title", "url", preview(F.col("content"), chars).alias("content"), "score", F.row_number().over(Window.orderBy("rank")).alias("rank"))
        ranked = rank_by(method, cut, query.lower().split(), key="url", text="content").select("title", "url", "content", "score", "rank", F.col("new_score").cast("double").alias("new_score"), "new_rank")
        rows = F.sort_array(F.collect_list(F.struct("new_rank", "title", "url", "content", "score", "rank", "new_score")))
        packed = ranked.agg(rows.alias("r")).select(F.transform("r", lambda x: F.struct(*[x[n].alias(n) for n in ranked.columns])).alias("r"))
        files.cache_put(packed.select(key.alias("key"), F.to_json("r").alias("value")), cache, as_of)
        history, each = files.search_records(held().select(F.lit(session).alias("session_id"), F.lit(query).alias("query"), as_of.alias("ts"), "results"))
        history.write.mode("append").parquet(f"{folder}/history")
        each.write.mode("append").parquet(f"{folder}/results")
    return held().select(F.inline("results"))


def _there(spark: SparkSession, path: str) -> bool:
    """Whether there is a table, on any store that Spark can open."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True
