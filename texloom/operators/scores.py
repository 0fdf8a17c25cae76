"""Quality scores of the stages from counts, each from 0 to 10, and the report over all stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections that a complete structure has (fixed values).
EXPECTED = ("abstract", "introduction", "methodology", "results", "conclusion")


def math_quality(formulas: DataFrame, key: str) -> DataFrame:
    """(key, math_quality) from the formulas of each key: variables, functions, operators (arrays) and complexity."""
    some = [F.max((F.size(c) > 0).cast("int")) for c in ("functions", "variables", "operators")]
    score = 5.0 + reduce(lambda a, b: a + b, some) + F.least(0.3 * F.avg("complexity"), F.lit(3.0))
    return formulas.groupBy(key).agg(F.least(score, F.lit(10.0)).alias("math_quality"))


def extraction_quality(entities: Column, relations: Column) -> Column:
    return F.least(F.lit(10.0), 0.1 * entities + 0.2 * relations)


def citation_quality(references: Column, parsed: Column, cited: Column, linked: Column) -> Column:
    """From counts: references, those with authors and title, citations in the text, those that link; 0 without any."""
    have = F.when(references > 0, 3.0 + 3.0 * parsed / references).otherwise(0.0)
    return F.least(F.lit(10.0), have + F.when(cited > 0, 2.0 + 2.0 * linked / cited).otherwise(0.0))


def structure_completeness(kinds: Column) -> Column:
    """The share of the expected sections among the canonical kinds found (array)."""
    return F.size(F.array_intersect(kinds, F.array(*map(F.lit, EXPECTED)))) / F.lit(len(EXPECTED))


def stage_report(keys: DataFrame, parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """One row per key with the columns of every part, which has one row per key at most; counts that are missing are 0."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, keys.select(key)).na.fill(0)
