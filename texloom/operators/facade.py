"""One entry for all kinds of search over prepared tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import text as T

from . import entities, retrieval


@dataclass
class Answer:
    """A lazy result and what kind of search made it; an error instead of rows if the kind or the words do not fit."""

    kind: str
    rows: DataFrame | None
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


#: Columns of the chunks that a listing shows when asked to.
CONTEXT = ("context_before", "context_after", "citations")


class Search:
    """Searches over chunks (chunk_id, doc_id, text, and any of CONTEXT), entities, citations and formulas."""

    def __init__(self, chunks: DataFrame, entity_table: DataFrame | None = None, citations: DataFrame | None = None, formulas: DataFrame | None = None):
        self.chunks, self.entities, self.citations, self.formulas = chunks, entity_table, citations, formulas

    def query(self, words: str, kind: str = "semantic", within: DataFrame | None = None, k: int = 10, with_context: bool = False) -> Answer:
        """``kind``: semantic, keyword, entity, citation or math; ``within`` restricts the documents; ``with_context`` adds the chunks' columns of CONTEXT."""
        handlers = {"semantic": self._full_text, "keyword": self._keyword, "entity": self._entity, "citation": self._citation, "math": self._math}
        if kind not in handlers:
            return Answer(kind, None, f"unknown kind {kind}")
        if not words.strip():
            return Answer(kind, None, "empty query")
        rows = handlers[kind](words, within, k, [c for c in CONTEXT if c in self.chunks.columns] if with_context else [])
        return Answer(kind, rows.withColumn("match_type", F.lit(kind))) if rows is not None else Answer(kind, None, f"no table for {kind}")

    def _restricted(self, rows: DataFrame, within: DataFrame | None) -> DataFrame:
        return rows if within is None else rows.join(within.select("doc_id"), "doc_id", "left_semi")

    def _full_text(self, words: str, within: DataFrame | None, k: int, context: list[str]) -> DataFrame:
        terms = [w for w in words.lower().split() if len(w) > 2][:10]
        scored = retrieval.full_text(self.chunks.withColumnRenamed("doc_id", "__d").withColumnRenamed("chunk_id", "doc_id"), terms)
        scored = scored.withColumnRenamed("doc_id", "chunk_id")
        if within is None:  # the hits are known before their rows are fetched
            scored = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
        rows = self._restricted(scored.join(self.chunks, "chunk_id"), within)
        return rows.orderBy(F.desc("score"), "chunk_id").limit(k).select("doc_id", "chunk_id", T.preview(F.col("text"), 500).alias("chunk_text"), F.round("score", 3).alias("relevance_score"), *context)

    def _keyword(self, words: str, within: DataFrame | None, k: int, context: list[str]) -> DataFrame:
        keys = T.query_keywords(words)
        rows = self._restricted(self.chunks.where(T.contains_all(F.col("text"), keys)), within)
        return rows.orderBy(F.desc(F.length("text")), "chunk_id").limit(k).select("doc_id", "chunk_id", T.preview(F.col("text"), 500).alias("chunk_text"), T.match_count(F.col("text"), keys).alias("keyword_matches"), *context)

    def _entity(self, words: str, within: DataFrame | None, k: int, context: list[str]) -> DataFrame | None:
        return None if self.entities is None else entities.search(self._restricted(self.entities, within), words.lower().split(), k)

    def _citation(self, words: str, within: DataFrame | None, k: int, context: list[str]) -> DataFrame | None:
        if self.citations is None:
            return None
        low = words.lower()
        hit = T.contains_any([F.col("title"), F.col("venue"), F.array_join("authors", ", ")], [low])
        return self._restricted(self.citations.where(hit), within).orderBy(F.desc_nulls_last("year"), "doc_id", "ref_id").limit(k)

    def _math(self, words: str, within: DataFrame | None, k: int, context: list[str]) -> DataFrame | None:
        if self.formulas is None:
            return None
        hit = F.contains(F.lower("latex"), F.lit(words.lower())) | F.array_contains("variables", words)
        return self._restricted(self.formulas.where(hit), within).orderBy(F.desc("complexity"), "doc_id", "position").limit(k)
