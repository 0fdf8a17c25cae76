"""Ranking: inverted index, BM25, fusion of ranked lists, reranking, exact vector search."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions.text import blank_tokens


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens=blank_tokens) -> DataFrame:
    """(doc_id, term, tf): the inverted index. Partial counts are made before the shuffle."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens=blank_tokens) -> DataFrame:
    """(doc_id, dl): tokens of each document."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("dl"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def document_frequency(docs: DataFrame, text: str = "text", tokens=blank_tokens) -> DataFrame:
    """(term, df), a row of ``docs`` being a document: each text gives a term once, so only partial counts are shuffled."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def term_counts(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text", tokens=blank_tokens) -> DataFrame:
    """doc_id, dl and a count for each term, in one pass over the texts and no shuffle: tf0, tf1, …"""
    counted = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("__t"))
    equal = lambda term: lambda x: x == term  # noqa: E731  (a default argument would be taken for the position)
    tf = [F.size(F.filter("__t", equal(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    return counted.select("doc_id", F.size("__t").cast("long").alias("dl"), *tf)


def okapi(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, floor: float | None = None) -> DataFrame:
    """(doc_id, score) of every document by Okapi BM25; a repeated query term counts each time.

    A negative idf becomes ``epsilon`` times the mean idf over all terms of the collection; with ``floor`` it becomes
    that number and the collection's other terms are not read.
    """
    terms = list(dict.fromkeys(query))
    counts = term_counts(docs, terms, doc_id, text)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    if floor is None and any(2 * stats[f"df{i}"] > stats.n for i in range(len(terms))):  # else no idf is negative
        low = epsilon * (document_frequency(docs, text).agg(F.avg(idf(F.lit(stats.n), F.col("df")))).first()[0] or 0.0)
    else:
        low = floor or 0.0
    length = k1 * (1 - b + b * F.col("dl") / F.lit(stats.avgdl or 1.0))
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        found = stats[f"df{i}"]
        weight = math.log(stats.n - found + 0.5) - math.log(found + 0.5) if found else 0.0
        weight = low if weight < 0 else weight
        score += query.count(term) * weight * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + length)
    return counts.select("doc_id", score.alias("score"), *[f"tf{i}" for i in range(len(terms))])


def full_text(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", within: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(doc_id, score) of the documents that have every term, best first; ``within`` restricts the ids that may answer, not
    the collection that scores are made over."""
    scored = okapi(docs, query, doc_id, text, k1=1.2, floor=1e-6)
    hits = scored.where(reduce(lambda a, c: a & c, [F.col(f"tf{i}") > 0 for i in range(len(set(query)))])).select("doc_id", "score")
    if within is not None:
        hits = hits.join(within.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    return hits if k is None else hits.orderBy(F.desc("score"), "doc_id").limit(k)


def ranked(scores: DataFrame, score: str = "score", key: str = "doc_id", k: int = 100) -> DataFrame:
    """The top ``k`` with their rank from 1. The limit comes before the window, so the window sees k rows."""
    top = scores.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str = "doc_id", k: int = 60) -> DataFrame:
    """(key, rrf_score): the sum over the lists of 1 / (k + rank)."""
    rows = reduce(DataFrame.unionByName, [ranks.select(key, "rank") for ranks in lists])
    return rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def hybrid(left: DataFrame, right: DataFrame, key: str = "doc_id", weights: tuple[float, float] = (0.5, 0.5), scaled: bool = False) -> DataFrame:
    """(key, hybrid_score) of the rows of ``left`` (score) and ``right`` (score): a weighted sum, raw or min-max scaled."""
    def unit(df: DataFrame, name: str) -> DataFrame:
        if not scaled:
            return df.select(key, F.col("score").alias(name))
        low, high = df.agg(F.min("score"), F.max("score")).first()
        return df.select(key, ((F.col("score") - low) / (high - low) if low is not None and high > low else F.lit(0.0)).alias(name))

    both = unit(left, "a").join(unit(right, "b"), key)
    return both.select(key, (weights[0] * F.col("a") + weights[1] * F.col("b")).alias("hybrid_score"))


def token_overlap(text: Column, query: list[str]) -> Column:
    """A stand-in for a learnt scorer: the share of the query's words in the text."""
    distinct = list(dict.fromkeys(query))
    return F.size(F.array_intersect(blank_tokens(text), F.array(*map(F.lit, distinct)))) / F.lit(len(distinct))


def rerank_head(ranks: DataFrame, scorer: Column, head: int = 20, key: str = "doc_id") -> DataFrame:
    """``ranks`` (with ``rank`` from 1) with ``new_rank``: the first ``head`` by the scorer, the others as they were.

    Only the head is ranked anew, so the window sees ``head`` rows however many there are.
    """
    first = ranks.where(F.col("rank") <= head).withColumn("rerank_score", scorer.cast("double"))
    first = first.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("rerank_score"), "rank")))
    tail = ranks.where(F.col("rank") > head).withColumns({"rerank_score": F.lit(None).cast("double"), "new_rank": F.col("rank")})
    return first.unionByName(tail)


def rank_by(method: str, results: DataFrame, query: list[str], scorer: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``results`` (with ``rank``) with ``new_rank`` and ``new_score`` by method: bm25, rrf, cross_encoder; others leave the order.

    ``results`` is what a search gave, a page of hits, so ranking it whole in one window is bounded.
    """
    if method == "bm25":
        scored = results.join(okapi(results, query, key, text).select(F.col("doc_id").alias(key), F.col("score").alias("new_score")), key)
    elif method == "rrf":
        scored = results.join(reciprocal_rank_fusion([results], key).withColumnRenamed("rrf_score", "new_score"), key)
    elif method == "cross_encoder":
        scored = results.withColumn("new_score", scorer if scorer is not None else token_overlap(F.col(text), query))
    else:
        return results.withColumns({"new_score": F.lit(None).cast("double"), "new_rank": F.col("rank")})
    return scored.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("new_score"), "rank")))


def first_of_each(lists: list[DataFrame], key: str) -> DataFrame:
    """One row per key: that of the first list and best rank that has it."""
    rows = reduce(DataFrame.unionByName, [ranks.select(key, F.lit(i).alias("list"), "rank") for i, ranks in enumerate(lists)])
    return rows.groupBy(key).agg(F.min(F.struct("list", "rank")).alias("at")).select(key, "at.list", "at.rank")


def squared_l2(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: Column | list[float], k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest: vec_id, distance (squared), similarity 1 / (1 + d). One scan and a top-k in every task."""
    at = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    d = squared_l2(F.col(embedding), at)
    return vectors.select(vec_id, d.alias("distance")).orderBy("distance", vec_id).limit(k).withColumn("similarity", 1 / (1 + F.col("distance")))
