"""Sentences, greedy chunks with overlap, their context and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.text import sentences


def greedy_chunks(parts: Column, least: int = 100, most: int = 1500, overlap: int = 1) -> Column:
    """Sentences gathered to chunks: ARRAY<STRUCT<start, n, size>>, sizes in characters without joining blanks.

    A chunk ends before a sentence that would take it beyond ``most``, if it is longer than ``least``. From the second
    such border on, a chunk begins with the last ``overlap`` sentences of the one before, if that has more than those.
    The fold runs in the document's own row.
    """
    chunk = "array<struct<start:int,n:int,size:int>>"
    start = F.struct(F.array().cast(chunk).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(0).alias("last"))
    row = lambda s, n, size: F.struct(s.cast("int").alias("start"), n.cast("int").alias("n"), size.cast("int").alias("size"))

    def step(s: Column, x: Column) -> Column:
        long = F.length(x)
        full = (s["size"] + long > most) & (s["n"] > 0) & (s["size"] > least)
        again = (F.size(s["done"]) > 0) & (s["n"] > overlap) & F.lit(overlap > 0)
        closed = F.struct(
            F.concat(s["done"], F.array(row(s["start"], s["n"], s["size"]))).alias("done"),
            (s["start"] + s["n"] - F.when(again, overlap).otherwise(0)).alias("start"),
            (F.when(again, overlap).otherwise(0) + 1).alias("n"),
            (F.when(again, s["last"]).otherwise(0) + long).alias("size"),
            long.alias("last"),
        )
        grown = F.struct(s["done"].alias("done"), s["start"].alias("start"), (s["n"] + 1).alias("n"), (s["size"] + long).alias("size"), long.alias("last"))
        return F.when(full, closed).otherwise(grown)

    end = lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(row(s["start"], s["n"], s["size"])))).otherwise(s["done"])
    return F.aggregate(parts, start, step, end)


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 100, most: int = 1500) -> DataFrame:
    """doc_id, chunk_order, chunk_text, sentence_count, char_count, word_count, context_before, context_after and flags.

    Chunks shorter than ``least`` are dropped. Context is the two sentences before and after, 200 characters of them.
    """
    cut = docs.select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s"))
    each = cut.withColumn("c", greedy_chunks(F.col("s"), least, most)).select("doc_id", "s", F.posexplode_outer("c").alias("chunk_index", "c"))  # outer: without a filter for which the fold would run again
    part = lambda a, n: F.array_join(F.slice("s", a, n), " ")
    first, n = F.col("c.start"), F.col("c.n")
    before = F.least(first, F.lit(2))
    made = each.where(F.col("c.size") >= least).select(
        "doc_id", "chunk_index", part(first + 1, n).alias("chunk_text"), n.cast("long").alias("sentence_count"), F.col("c.size").cast("long").alias("char_count"),
        F.right(part(first - before + 1, before), F.lit(200)).alias("context_before"), F.left(part(first + n + 1, F.lit(2)), F.lit(200)).alias("context_after"),
    )
    return made.withColumns({
        "word_count": F.size(F.filter(F.split("chunk_text", r"\s+"), lambda w: w != "")).cast("long"),
        "has_math": F.col("chunk_text").rlike("[=∑∫≤≥±]"),
        "has_figures": F.col("chunk_text").rlike(r"(?i)\b(figure|fig\.)\s*[0-9]+"),
        "figure_refs": F.transform(F.regexp_extract_all("chunk_text", F.lit(r"(?i)\b(?:figure|fig\.)\s*([0-9]+)"), F.lit(1)), lambda x: F.concat(F.lit("Figure "), x)),
    })


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, mean, least and greatest size, flags, and a quality of at most 10."""
    marked = F.count_if(F.col("has_math") | F.col("has_figures"))
    n = F.count(F.lit(1))
    return chunks.groupBy("doc_id").agg(
        n.alias("chunk_count"), F.avg("char_count").alias("avg_size"), F.min("char_count").alias("min_size"), F.max("char_count").alias("max_size"), marked.alias("marked"),
        F.least(F.lit(10.0), 6 * F.least(F.lit(1.0), F.avg("char_count") / 800) + 4 * marked / n).alias("quality"),
    )
