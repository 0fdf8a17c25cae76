"""Feeds of papers and search results as Spark data sources.

The parsing is Spark's; fetching is a Python data source that deals pages of results to tasks. ``path`` reads stored
responses instead, so the same query runs without a network.
"""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_title:string,_type:string>>"


class HttpPages(DataSource):
    """(offset, body) of a paged HTTP source. Options: url, with {start} and {count}; total, count, delay in seconds."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "offset int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.total, self.count, self.delay = options["url"], int(options.get("total", 10)), int(options.get("count", 10)), float(options.get("delay", 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(start) for start in range(0, self.total, self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        wait = self.delay
        for attempt in range(6):
            try:
                with urllib.request.urlopen(self.url.format(start=partition.value, count=self.count), timeout=30) as answer:
                    yield partition.value, answer.read().decode("utf-8", "replace")
                return
            except OSError:
                if attempt == 5:
                    raise
                time.sleep(min(60.0, wait))
                wait *= 2


def query_url(base: str, query: str) -> str:
    return f"{base}?search_query={urllib.parse.quote(query)}&start={{start}}&max_results={{count}}"


def papers(feed: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of Atom feeds: arxiv_id, title, authors, abstract, published, updated, categories, pdf_url, abstract_url."""
    entries = feed.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))).alias("x"))
    e = entries.select(F.from_xml("x", ENTRY, {"rowTag": "entry"}).alias("e")).select("e.*")
    tidy = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    return e.select(
        F.regexp_extract("id", r"abs/(.+?)(?:v[0-9]+)?$", 1).alias("arxiv_id"), tidy("title").alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), tidy("summary").alias("abstract"),
        F.try_to_timestamp("published").alias("published"), F.try_to_timestamp("updated").alias("updated"), F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"].alias("pdf_url"), F.col("id").alias("abstract_url"),
    )


def html_url(abstract_page: Column, arxiv_id: Column) -> Column:
    """The link to a paper's HTML form on its abstract page; null if there is none."""
    found = F.regexp_extract(abstract_page, r'href="([^"]*/html/[^"]+)"', 1)
    return F.when(found != "", found).when(F.contains(abstract_page, F.lit("HTML (experimental)")), F.concat(F.lit("https://arxiv.org/html/"), arxiv_id))


def web_results(answers: DataFrame, body: str = "body") -> DataFrame:
    """position, title, url, content, score of JSON search answers."""
    read = answers.select(F.from_json(body, "results array<struct<title:string,url:string,content:string,score:double>>")["results"].alias("r"))
    return read.select(F.posexplode("r").alias("position", "r")).select("position", "r.*")
