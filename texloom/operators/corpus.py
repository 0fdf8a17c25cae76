"""Per-document counts, validation, summaries, selection, issues, stage log and writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages that a finished document has been through, and the sections that it should have (fixed values).
STAGES = ("document_structure", "math_processing", "citation_parsing", "content_chunking", "entity_extraction")
SECTIONS = ("abstract", "introduction", "methodology", "results", "conclusion", "references")


def counted(docs: DataFrame, parts: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key and a count for each part; a document without rows counts 0. Each part is aggregated before the join."""
    sums = [p.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count")) for name, p in parts.items()]
    out = reduce(lambda a, b: a.join(b, key, "left"), sums, docs.select(key).distinct())
    return out.select(key, *[F.coalesce(f"{name}_count", F.lit(0)).alias(f"{name}_count") for name in parts])


def validated(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores from one row of facts per document: section_count, section_types (array), chunk_count, math_count,
    citation_count, entity_count, min_chunk, max_chunk, min_confidence, author_share, title_share, orphan_chunks,
    stages (array). overall = 0.4 completeness + 0.4 quality + 0.2 integrity."""
    c, n = F.col, lambda name: F.coalesce(F.col(name), F.lit(0))
    missing = F.size(F.array_except(F.array(*map(F.lit, SECTIONS)), c("section_types")))
    complete = [
        F.when(n("section_count") >= 5, 100).otherwise(0), F.when(n("section_count") == 0, 0).when(missing == 0, 100).otherwise(70), F.when(n("chunk_count") >= 10, 100).otherwise(0),
        F.when(n("math_count") > 0, 100).otherwise(80), F.when(n("citation_count") >= 3, 100).otherwise(0), F.when(n("entity_count") >= 5, 100).otherwise(70),
    ]
    quality = [
        F.when(c("min_chunk") < 100, 80).when(c("max_chunk") > 2000, 85).otherwise(100), F.when(c("min_confidence") < 0.3, 75).otherwise(100),
        F.when(n("citation_count") == 0, 50).when(c("author_share") < 0.7, 70).when(c("title_share") < 0.5, 80).otherwise(100),
    ]
    lacking = F.array_except(F.array(*map(F.lit, STAGES)), c("stages"))
    integrity = [F.when(n("orphan_chunks") > 0, 85).otherwise(100), F.when(F.size(lacking) == 0, 100).otherwise(60)]
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / float(len(xs))
    scored = facts.withColumns({"completeness": mean(complete), "quality": mean(quality), "integrity": mean(integrity), "missing_stages": lacking})
    overall = 0.4 * c("completeness") + 0.4 * c("quality") + 0.2 * c("integrity")
    return scored.withColumn("overall", overall).withColumn("ready", (c("overall") >= 70) & (c("completeness") >= 60))


def complete(required: dict[str, DataFrame], optional: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key of the documents that every required table has, once each, and has_<name> for every optional table.

    Rows of a table are never multiplied by those of another: only distinct keys are joined, and
    they are made distinct before the shuffle as far as each task sees them. All joins are on ``key``, so one partitioning serves them.
    """
    first, *others = required.values()
    out = first.select(key).where(F.col(key).isNotNull()).distinct()
    out = reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), others, out)
    for name, rows in optional.items():
        out = out.join(rows.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    return out.select(key, *[F.coalesce(f"has_{name}", F.lit(False)).alias(f"has_{name}") for name in optional])


def issues(facts: DataFrame, rules: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """key and the issues, each once, of the rows for which a rule holds; a rule that is null does not hold."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(text)) for text, rule in rules.items()])))
    return facts.select(key, found.alias("issues")).where(F.size("issues") > 0)


def distinct_issues(found: DataFrame, key: str = "doc_id", column: str = "issues") -> DataFrame:
    """issue, n_rows, first_key: every issue once, with how many rows have it."""
    each = found.select(F.col(key).alias("k"), F.explode(F.array_distinct(column)).alias("issue"))
    return each.groupBy("issue").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"))


def orphans(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that no other row belongs to."""
    return rows.join(others, key, "left_anti")


def eligible(docs: DataFrame, abstract: Column, authors: Column, least_authors: int = 1, require_abstract: bool = True, predicate: Column | Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """The rows that may be selected: an abstract that is not empty, ``least_authors`` entries or more in the array ``authors`` (null: none),
    and the caller's own predicate, a column or a function of a batch of rows that tells which of them stay."""
    kept = docs.where(F.coalesce(F.size(authors), F.lit(0)) >= least_authors)
    if require_abstract:
        kept = kept.where(F.length(abstract) > 0)
    if isinstance(predicate, Column):
        return kept.where(predicate)
    if predicate is None:
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[predicate(batch).fillna(False).astype(bool)]

    return kept.mapInPandas(run, docs.schema)


def selection_score(strategy: str, html: Column, pdf: Column, abstract: Column, authors: Column, categories: Column, age_days: Column | None = None, weight: float = 0.0, custom: Column | None = None) -> Column:
    """How good a document is to take: format by strategy, abstract, authors, categories, recency; -1 if the format rules it out."""
    forms = {
        "html_only": F.when(html, 10.0).otherwise(-1.0), "html_preferred": F.when(html, 10.0).when(pdf, 5.0).otherwise(-1.0), "pdf_only": F.when(pdf, 10.0).otherwise(-1.0),
        "pdf_preferred": F.when(pdf, 10.0).when(html, 5.0).otherwise(-1.0), "metadata_only": F.lit(5.0),
    }
    base = forms[strategy]
    score = base + F.when(F.length(abstract) > 0, 2.0).otherwise(0.0) + F.when(F.length(abstract) > 500, 1.0).otherwise(0.0)
    score += F.when(authors > 0, 1.0).otherwise(0.0) + F.when(authors.between(2, 8), 0.5).otherwise(0.0) + F.when(categories > 1, 0.5).otherwise(0.0)
    if age_days is not None:
        score += 5 * F.pow(F.lit(0.99), age_days) * weight
    if custom is not None:
        score += custom
    return F.when(base < 0, -1.0).otherwise(score)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert as a read. A partial maximum goes before the shuffle."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def unexpired(cache: DataFrame, as_of: Column, written: str = "ts", ttl: str = "INTERVAL 3600 SECOND") -> DataFrame:
    """Entries that are not older than their time to live."""
    return cache.where(F.col(written) + F.expr(ttl) > as_of)


def stage_rates(log: DataFrame, stage: str, ok: Column, seconds: str) -> DataFrame:
    """Per stage: runs, success in percent, mean time."""
    return log.groupBy(stage).agg(F.count(F.lit(1)).alias("runs"), (100 * F.avg(ok.cast("int"))).alias("success_rate"), F.avg(seconds).alias("avg_seconds"))


def recommendations(rates: DataFrame, stage: str) -> DataFrame:
    """A line of advice for every stage that fails often or is slow."""
    failed = 1 - F.col("success_rate") / 100
    advice = F.when(failed > 0.5, "most runs fail").when(failed > 0.2, "many runs fail").when(F.col("avg_seconds") > 300, "slow")
    return rates.select(stage, advice.alias("advice")).where("advice is not null")


def first_of_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
