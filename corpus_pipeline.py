"""The training-text pipeline over ``documents``: which texts stay, what they hold, and how they are packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``: doc_id, text, lang, source, n_chars. Null and empty texts fail the first stage; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm import jaccard, packing, pii, quality_model, quality_rules
from texloom.llm.common import saved, table
from texloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of a lower score goes: only what is likely bad, so that doubtful texts stay (the README gives the counts).
LEAST_SCORE = 0.25


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts within the adaptive thresholds of their language and source."""
    return quality_rules.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the compression classifier does not reject; it learns from the labelled rows of the whole table."""
    model = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.scored(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest id; rows that are equal in all columns are copies, too.

    Rows go by 128 bits over all columns, so that null ids and one id on several texts are told apart.
    """
    docs = docs.select(*COLUMNS)
    named = docs.withColumns({"a": F.xxhash64(*COLUMNS), "b": F.xxhash64(F.lit(3), *COLUMNS)})
    found = saved(jaccard.near_duplicates(named.select(F.struct("doc_id", "a", "b").alias("doc_id"), "text")).select("doc_id.a", "doc_id.b", "kept"))
    left = named.join(found.where("not kept").select("a", "b"), ["a", "b"], "left_anti")
    again = saved(found.where("kept").groupBy("a", "b").count().where("count > 1").select("a", "b"))
    if not again.isEmpty():
        left = left.join(again, ["a", "b"], "left_anti").unionByName(named.join(again, ["a", "b"]).dropDuplicates(["a", "b"]))
    return left.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their place in sequences, with their ids."""
    return packing.sequences(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", near_copies), ("pii", personal_data), ("packing", sequences)]

#: No SQL expresses the classifier, the personal-data field or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; what the classifier keeps is saved, as the stage after it reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if stage is classifier else docs
    return docs
