"""The references of a page: which section holds them, and its entries in three layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.text import canonical_section

from .pages import tag_texts


def references_section(headings: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, title): the first heading of each page whose canonical kind is ``references``."""
    found = headings.where(canonical_section(F.col("title")) == "references")
    return found.groupBy(key).agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"))


def references_part(html: Column) -> Column:
    """The markup after the first heading that speaks of references, up to the next heading; else what a container of such a
    class holds; else empty."""
    headed = F.regexp_extract(html, r"(?is)<h[1-4]\b[^>]*>[^<]*reference[^<]*</h[1-4]\s*>(.*)", 1)
    upto = F.regexp_replace(headed, r"(?is)<h[1-6]\b.*", "")
    boxed = F.regexp_extract(html, r"(?is)<div\b[^>]*class=\"[^\"]*(?:bib|reference)[^\"]*\"[^>]*>(.*)", 1)
    return F.when(upto != "", upto).otherwise(boxed)


def reference_entries(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 20) -> DataFrame:
    """key, position, citation_text: numbered paragraphs if there are any, else the paragraphs, list items and boxes.

    Entries of fewer than ``least`` characters are left out, and positions count what is left out, too.
    """
    part = references_part(F.col(html))
    numbered = F.filter(tag_texts(part, "p"), lambda x: x.rlike(r"^\[?[0-9]+\]?"))
    others = tag_texts(part, "(?:div|li|p)")
    each = pages.select(key, F.posexplode(F.when(F.size(numbered) > 0, numbered).otherwise(others)).alias("position", "citation_text"))
    return each.where(F.length("citation_text") >= least)


def sentence_around(text: Column, position: Column, around: int = 50) -> Column:
    """The sentence that holds a position (from 0), or ``around`` characters on both sides if none does."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(s: Column, sentence: Column) -> Column:
        here = s.found.isNull() & (s["at"] <= position) & (position <= s["at"] + F.length(sentence))
        return F.struct((s["at"] + F.length(sentence) + 1).alias("at"), F.when(here, sentence).otherwise(s.found).alias("found"))

    low = F.greatest(position - around, F.lit(0))
    near = F.substring(text, low + 1, F.least(F.length(text), position + around) - low)
    return F.btrim(F.coalesce(F.aggregate(F.split(text, "[.!?]+"), start, step, lambda s: s.found), near))
