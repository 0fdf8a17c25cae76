"""Files in and out: datasets, results, offloaded documents, vector tables, caches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from texloom.functions.text import safe_filename
from texloom.operators.corpus import unexpired

#: A benchmark test with its sessions of turns.
TEST = "question_id string, question_type string, question string, answer string, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
RESULT = "test_index int, question_id string, question_type string, question string, ground_truth_answer string, agent_answer string, latency_ms double, error string, timestamp string"


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tests."""
    return spark.read.schema(TEST).json(path, multiLine=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results, one JSON object a line."""
    return spark.read.schema(RESULT).json(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def export_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def metrics_json(metrics: DataFrame, path: str) -> None:
    """One row as one JSON line."""
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.mode("overwrite").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored HTML files as (path, html, content_hash)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return files.withColumn("content_hash", F.sha2("html", 256))


def front_matter(title: Column, url: Column, body: Column, as_of: Column) -> Column:
    """A Markdown document with its title, source and time in front."""
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("url: "), url), F.concat(F.lit("saved: "), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")), F.lit("---"), F.lit(""), body)


def offload(pages: DataFrame, path: str, as_of: Column, title: str = "title", url: str = "url", body: str = "text") -> DataFrame:
    """Write each document to a file of its title and a hash of its url in a folder that all executors share, and give (url, name).

    Equal titles do not collide. No file is left of a write that fails (``DocumentFiles``).
    """
    named = pages.withColumn("name", F.concat_ws("_", safe_filename(F.col(title)), F.substring(F.md5(F.col(url)), 1, 8)))
    named = named.withColumn("name", F.concat("name", F.lit(".md")))
    pages.sparkSession.dataSource.register(DocumentFiles)
    named.select("name", front_matter(F.col(title), F.col(url), F.col(body), as_of).alias("value")).write.format("document_files").mode("append").save(path)
    return named.select(url, "name")


def save_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """A vector table; ``mode='overwrite'`` replaces it, and an empty one clears it."""
    vectors.write.mode(mode).parquet(path)


def vector_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: vectors and their greatest length."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size(embedding)).alias("dimension"))


def cache_put(entries: DataFrame, path: str, as_of: Column) -> None:
    """Append (key, value) with the time of writing; the key holds all parameters of what is cached."""
    entries.select("key", "value", as_of.alias("ts")).write.mode("append").parquet(path)


def cache_get(spark: SparkSession, path: str, keys: DataFrame, as_of: Column) -> DataFrame:
    """The newest entry of each key that is not older than an hour."""
    fresh = unexpired(spark.read.parquet(path), as_of).join(keys.select("key"), "key", "left_semi")
    return fresh.groupBy("key").agg(F.max_by("value", "ts").alias("value"))


def cached_content(wanted: DataFrame, downloads: DataFrame, key: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """(there, missing): what was downloaded with success, and the rest."""
    done = downloads.where("success")
    return wanted.join(done, key, "left_semi"), wanted.join(done, key, "left_anti")


def search_records(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, results) of searches (session_id, query, ts, results: array of structs), joined by a hash of the search."""
    named = searches.withColumn("search_id", F.md5(F.concat_ws("|", "session_id", "query", F.col("ts").cast("string"))))
    history = named.select("search_id", "session_id", "query", F.size("results").alias("result_count"), "ts")
    results = named.select("search_id", F.posexplode("results").alias("position", "r")).select(F.md5(F.concat_ws("|", "search_id", F.col("position").cast("string"))).alias("id"), "search_id", "position", "r.*")
    return history, results


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, under names of their own until the write is committed."""

    files: list[tuple[str, str]]


class DocumentFiles(DataSource):
    """A sink of one file per row: ``df.write.format("document_files").mode("append").save(folder)`` with columns name and value.

    ``folder`` is one that all executors share. A task writes under names of its own, and the driver gives files their names
    once all tasks have ended, and then removes what else the write has left, so a task that fails or runs twice leaves no file. Of rows
    of one name the last committed stays. Files that are there already and are not written again stay.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], schema)


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str, schema):
        self.folder, self.mark = folder.removeprefix("file:"), f".{uuid.uuid4().hex}"  # one of this write, for all its tasks
        missing = {"name", "value"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files: list[tuple[str, str]] = []
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith("."):
                raise ValueError(f"not a file name: {row.name!r}")
            held = os.path.join(self.folder, f"{self.mark}-{uuid.uuid4().hex}")
            files.append((held, os.path.join(self.folder, row.name)))
            with open(held, "w", encoding="utf-8", newline="") as f:
                f.write(row.value or "")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for held, name in (pair for m in messages if m for pair in m.files):
            os.replace(held, name)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Remove what tasks of this write have left, those that failed, were killed or ran twice among them."""
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if name.startswith(self.mark):
                os.remove(os.path.join(self.folder, name))
