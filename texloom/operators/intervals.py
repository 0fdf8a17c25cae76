"""Places in texts, and joins of intervals by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def located(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, match) of all matches of a pattern, in characters from 0, end exclusive; null texts have none.

    A text is split at its matches, and the lengths before a match are summed. Only lengths and matches are shuffled.
    ``pattern`` has no groups that capture, and matches no empty text.
    """
    row = docs.where(F.col(text).rlike(pattern)).select(F.col(key).alias(key), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    parts = F.arrays_zip(F.transform(F.split("__text", pattern, -1), lambda g: F.length(g)).alias("gap"), F.regexp_extract_all("__text", F.lit(f"({pattern})"), F.lit(1)).alias("match"))
    each = row.select(key, "__row", F.posexplode(parts).alias("at", "p")).select(key, "__row", "at", "p.*").where("match is not null")
    end = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("__row").orderBy("at")).cast("long")
    return each.select(key, (end - F.length("match")).alias("start"), end.alias("end"), "match")


def windows(docs: DataFrame, size: int, step: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, start, end): pieces of ``size`` characters that begin every ``step``, up to the end of the text."""
    long = docs.select(F.col(key).alias(key), F.length(text).cast("long").alias("__n")).where("__n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / step)).cast("int")
    each = long.select(key, "__n", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return each.select(key, "part", (F.col("part") * step).cast("long").alias("start"), F.least(F.col("part") * step + size, F.col("__n")).alias("end"))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int, inside: bool = False) -> DataFrame:
    """Pairs of ``left`` and ``right`` (each: key, start, end and more) whose intervals share a place, or, ``inside``, of which the left lies within the right.

    Both are keyed by the bins of ``width`` places that they touch, so a key of any size is spread over its bins, and only
    what meets in a bin is compared. A pair is given in the bin of the later start, once. An interval much
    longer than ``width`` has a row for each of its bins. Empty and null intervals are in no pair. Columns of the sides are
    told apart as ``left_`` and ``right_``.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(c if c == key else f"{side}_{c}") for c in df.columns]).where(F.col(f"{side}_start") < F.col(f"{side}_end"))
        first, last = _bin(F.col(f"{side}_start"), width), _bin(F.col(f"{side}_end") - 1, width)
        return named.withColumn("__bin", F.explode(F.sequence(first, last)))

    met = binned(left, "left").join(binned(right, "right"), [key, "__bin"])
    once = F.col("__bin") == _bin(F.greatest("left_start", "right_start"), width)
    within = (F.col("left_start") >= F.col("right_start")) & (F.col("left_end") <= F.col("right_end")) if inside else F.lit(True)
    share = (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))
    return met.where(once & share & within).drop("__bin")


def _bin(place: Column, width: int) -> Column:
    return F.floor(place / width).cast("long")
