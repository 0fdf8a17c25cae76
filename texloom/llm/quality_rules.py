"""Quality rules whose thresholds adapt to language and source, with DataFrame functions only.

Each text is measured once, in its own row, and the counts are saved. Mergeable quantile summaries (``approx_percentile``:
partial summaries are built on every partition and merged) give two quantiles of each measure per language and source, and
a text is kept if no measure lies beyond the fences that they set. So a hot source adds rows to partial summaries, never to
one task. The fences are joined by broadcast if they are few, else hot sources are salted; texts are never shuffled.

Nulls: a null text has no words and fails; null language or source is a group like any other. Empty texts fail. Texts of
any length are measured whole. Repeated rows are judged each. An empty table gives an empty result. Columns of the
input are kept; those that carry the name of an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: The columns that ``measured`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Share of each count in thousandths: numerator, denominator, the two quantiles, how many times their distance a fence lies
#: beyond them, whether it also has a lower fence. Repeated lines and words are rare in most sources, so their upper
#: quantile is a high one, and the fence follows the few texts that have some.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 0.25, 0.75, 3, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5, 0.99, 2, False),
    "repeats": ("n_repeat_words", "n_words", 0.5, 0.99, 2, False),
    "word_length": ("word_chars", "n_words", 0.25, 0.75, 5, True),
}
#: The distance of the quantiles counts as so many thousandths at least, where most texts of a source are equal.
LEAST = 5
#: Pairs of language and source whose fences are broadcast (about 100 bytes each), and the salts of a pair beyond that.
FEW, SALTS = 100_000, 32
BLANK = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated(words: Column, size: int = 8) -> Column:
    """How many words stand in windows of ``size`` words that occur twice or more; windows are told apart by a 64-bit hash."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["h"] == e.h, F.lit(False))
        at = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: same(s, e, j - 1) | same(s, e, j + 1)), lambda e: e.i)))
        gaps = let(at, lambda p: F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) >= size, some).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and COUNTS, each a long."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = docs.withColumn("__words", F.array_remove(F.split(whole, BLANK), "")).withColumn("__lines", F.filter(F.split(whole, "\\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    return counts.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated(F.col("__words")),
    }).drop("__words", "__lines")


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def share(measure: str) -> Column:
    above, below, *_ = MEASURES[measure]
    return F.floor(1000 * F.col(above) / F.greatest(F.col(below), F.lit(1))).cast("long")


def thresholds(counts: DataFrame, lang: str = "lang", source: str = "source", min_rows: int = 50, accuracy: int = 10_000) -> DataFrame:
    """Fences per language and source: t_lang, t_source, and low_ and high_ of each measure.

    Rows that fail the base rules do not count. A group of fewer than ``min_rows`` rows takes the fences of its language.
    The result has a row for each pair of language and source.
    """
    rows = counts.select(F.col(lang).alias("t_lang"), F.col(source).alias("t_source"), *[F.when(~base_failed(), share(m)).alias(m) for m in MEASURES])
    levels = [F.percentile_approx(m, [low, high], accuracy).alias(m) for m, (_, _, low, high, _, _) in MEASURES.items()]
    levels = saved(rows.groupingSets([["t_lang", "t_source"], ["t_lang"]], "t_lang", "t_source").agg(F.grouping_id().alias("level"), F.count("symbols").alias("n"), *levels))
    groups, langs = levels.where("level = 0").alias("g"), levels.where("level = 1").alias("l")
    both = groups.join(langs, F.col("g.t_lang").eqNullSafe(F.col("l.t_lang")), "left")
    found = both.select("g.t_lang", "g.t_source", *[F.when(F.col("g.n") >= min_rows, F.col(f"g.{m}")).otherwise(F.col(f"l.{m}")).alias(m) for m in MEASURES])
    fences = []
    for m, (_, _, _, _, reach, lower) in MEASURES.items():
        low, high = F.get(m, F.lit(0)), F.get(m, F.lit(1))
        beyond = reach * F.greatest(high - low, F.lit(LEAST))
        fences += [(high + beyond).alias(f"high_{m}"), (low - beyond if lower else F.lit(-1).cast("long")).alias(f"low_{m}")]
    return found.select("t_lang", "t_source", *fences)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", with_text: bool = True, few: int = FEW, **options) -> DataFrame:
    """``docs``, COUNTS, ``base_failed`` and ``kept``; without the text if that is not asked for, which is then not saved either."""
    counts = measured(docs, text)
    counts = saved(counts if with_text else counts.drop(text))
    fences = saved(thresholds(counts, lang, source, **options))
    same = F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source"))
    if fences.count() <= few:
        both = counts.join(F.broadcast(fences), same, "left")
    else:
        salted = fences.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = counts.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, same & (F.col("__part") == F.col("__salt")), "left").drop("__part", "__salt")
    faults = base_failed().cast("int")
    for m in MEASURES:
        faults += F.coalesce(~share(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(False)).cast("int")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", faults == 0).drop(*fences.columns)
