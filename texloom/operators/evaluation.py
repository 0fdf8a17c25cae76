"""Answer scoring, metrics, and deterministic samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions.text import word_set

#: Phrases that tell an answer that knows nothing (fixed values).
REFUSALS = ("don't have access", "cannot provide", "don't know", "no information", "unable to answer")


def answer_match(truth: Column, answer: Column) -> Column:
    """1.0 if equal, 0.8 if contained, 0.0 for a refusal, else the share of the truth's words in the answer."""
    t, a = F.btrim(F.lower(truth)), F.btrim(F.lower(answer))
    refusal = reduce(lambda x, y: x | y, [F.contains(a, F.lit(p)) for p in REFUSALS])
    words = word_set(t)
    overlap = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, word_set(a))) / F.size(words))
    return F.when(t == a, 1.0).when(F.contains(a, t), 0.8).when(refusal, 0.0).otherwise(overlap)


def metrics(results: DataFrame, score: str = "score", latency: str = "latency_ms") -> DataFrame:
    """One row: counts, means and medians."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.avg(latency).alias("mean_latency"), F.median(latency).alias("median_latency"), F.avg(score).alias("mean_score"), F.median(score).alias("median_score"))


def by_type(results: DataFrame, kind: str, score: str = "score") -> DataFrame:
    """Per type: n, mean, standard deviation, 95th percentile, and its share of all rows."""
    total = results.count()
    return results.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev(score).alias("std"), F.percentile(score, F.lit(0.95)).alias("p95"), (100.0 * F.count(F.lit(1)) / F.lit(max(total, 1))).alias("percent"))


def score_bins(results: DataFrame, score: str = "score", edges: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """bin, n: right-closed bins, the lowest edge belongs to the first; empty bins are kept."""
    ends = list(zip(edges, edges[1:], strict=False))
    hit = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(ends))):
        inside = (F.col(score) <= high) & ((F.col(score) >= low) if i == 0 else (F.col(score) > low))
        hit = F.when(inside, i).otherwise(hit)
    found = results.select(hit.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = results.sparkSession.range(len(ends)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def best_and_worst(results: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The n best and the n worst, marked."""
    best = results.orderBy(F.desc(score), key).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(results.orderBy(F.asc(score), key).limit(n).withColumn("side", F.lit("worst")))


#: Hexadecimal digits that make a bucket of a sample.
HASH_DIGITS = 4


def drawn(rows: DataFrame, stratum: str, key: str, quota: Column, seed: int = 42) -> DataFrame:
    """Of each stratum the first ``quota`` rows in the order of a seeded hash; ``quota`` may use the stratum's ``n``.

    A histogram of the leading HASH_DIGITS of the hash tells in which bucket a stratum's quota ends. Rows of the buckets below pass without
    a sort, and only that bucket, some 65,536th of the stratum, is ranked. Null is a stratum like any other.
    """
    hashed = rows.withColumn("__hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    hashed = hashed.withColumns({"__bucket": F.coalesce(F.left("__hash", F.lit(HASH_DIGITS)), F.lit("")), "__s": F.col(stratum)})
    counts = hashed.groupBy("__s", "__bucket").agg(F.count(F.lit(1)).alias("m"))
    ahead = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"n": F.sum("m").over(Window.partitionBy("__s")), "before": F.coalesce(F.sum("m").over(ahead), F.lit(0))})
    asked = placed.withColumn("left", quota - F.col("before")).where("left > 0 and left <= m or left > m and before + m = n")
    ends = asked.select(F.struct("__s").alias("__of"), F.col("__bucket").alias("__end"), "left")  # a row a stratum; a struct of null is not null
    both = hashed.join(ends, F.struct("__s") == F.col("__of"))
    last = both.where("__bucket = __end").withColumn("__r", F.row_number().over(Window.partitionBy("__of").orderBy(F.col("__hash"), F.col(key))))
    return both.where("__bucket < __end").select(*rows.columns).unionByName(last.where(F.col("__r") <= F.col("left")).select(*rows.columns))


def stratified(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """A proportional sample, at least one row of each stratum."""
    return drawn(rows, stratum, key, F.greatest(F.lit(1), F.floor(F.col("n") * share)), seed)


def balanced(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, all if it has fewer."""
    return drawn(rows, stratum, key, F.lit(n), seed)


def precision_recall(found: Column, gold: Column, k: int) -> tuple[Column, Column]:
    """(precision, recall) of the first k of an array against another."""
    hits = F.size(F.array_intersect(F.slice(found, 1, k), gold))
    return hits / F.lit(k), F.when(F.size(gold) == 0, 0.0).otherwise(hits / F.size(gold))
