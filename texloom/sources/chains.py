"""Chains of tables: the first that can be read, the first that has rows, or for every key the first that has it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def first_of(candidates: Sequence[Callable[[], DataFrame]], skip_empty: bool = False) -> DataFrame:
    """The first table that is there and has the columns asked for; the error of the last one if none is.

    Each candidate is a function that gives the rows in the common columns, constants standing for what a table lacks.
    With ``skip_empty`` a table without rows is passed over too, unless it is the last: one row is looked for, no count made.
    """
    for k, candidate in enumerate(candidates):
        last = k == len(candidates) - 1
        try:
            rows = candidate()
            rows.schema  # a missing table or column shows here at the latest
        except AnalysisException:
            if last:
                raise
            continue
        if last or not (skip_empty and rows.isEmpty()):
            return rows
    raise ValueError("no candidates")


def first_of_each(candidates: Sequence[DataFrame], key: str) -> DataFrame:
    """For every key all rows of the first table that has it, the tables having the same columns. Rows without a key go with every table.

    Of the tables before only the keys meet a table's rows, each key once, so an anti join has one match at most; a key that
    holds many of the rows is on its left side only, which the adaptive skew join may split.
    """
    taken, keys = [candidates[0]], candidates[0].select(key)
    for rows in candidates[1:]:
        taken.append(rows.join(keys.distinct(), key, "left_anti").select(*candidates[0].columns))
        keys = keys.unionByName(rows.select(key))
    return reduce(DataFrame.unionByName, taken)
