"""Fetching of pages from many hosts: a host's pages in one task, which keeps its delay."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, status int, content_type string, body string, attempts int, error string"


def one(url: str, deadline: float, accept: tuple[str, ...], most_bytes: int, wait: float = 0.5) -> dict:
    """A page within ``deadline`` seconds over all attempts. What is not of an accepted type is not read; 4xx is not tried again, but 429."""
    end, attempts, found = time.monotonic() + deadline, 0, {"url": url, "status": None, "content_type": None, "body": None}
    while True:
        attempts += 1
        again = True
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": ", ".join(accept)}), timeout=max(0.01, end - time.monotonic())) as answer:
                found |= {"status": answer.status, "content_type": answer.headers.get_content_type()}
                if found["content_type"] not in accept:
                    return found | {"attempts": attempts, "error": f"type {found['content_type']}"}
                parts, size = [], 0
                while part := answer.read1(1 << 16):
                    size += len(part)
                    parts.append(part)
                    if size > most_bytes:
                        return found | {"attempts": attempts, "error": f"more than {most_bytes} bytes"}
                    if time.monotonic() > end:
                        raise TimeoutError("deadline")
                return found | {"body": b"".join(parts).decode(answer.headers.get_content_charset() or "utf-8", "replace"), "attempts": attempts, "error": None}
        except urllib.error.HTTPError as e:
            error, again = f"status {e.code}", e.code == 429 or e.code >= 500
            found["status"] = e.code
        except (OSError, ValueError, LookupError) as e:
            error, again = f"{type(e).__name__}: {e}", isinstance(e, OSError)
        if not again or time.monotonic() + wait >= end:
            return found | {"attempts": attempts, "error": error}
        time.sleep(wait)
        wait *= 2


def fetched(pages: DataFrame, url: str = "url", delay: float = 1.0, deadline: float = 30.0, accept: tuple[str, ...] = ("text/html", "application/xhtml+xml"), most_bytes: int = 1 << 26) -> DataFrame:
    """FETCHED for each distinct url, whatever comes of it.

    Pages are dealt to tasks by host and stand in order of host there, so a host is asked by one task, ``delay`` seconds after its
    last answer; other hosts do not wait for it. Nothing is held but one page. A task that runs again asks again.
    """
    named = pages.select(F.col(url).alias("url")).where("url is not null").distinct()
    hosts = named.withColumn("host", F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, float] | None = None
        for batch in batches:
            for link, host in zip(batch.column("url").to_pylist(), batch.column("host").to_pylist(), strict=True):
                if last and last[0] == host:
                    time.sleep(max(0.0, last[1] + delay - time.monotonic()))
                row = one(link, deadline, accept, most_bytes)
                last = host, time.monotonic()
                yield pa.RecordBatch.from_pylist([row], pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.string()), ("attempts", pa.int32()), ("error", pa.string())]))

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own, so that few hosts are not put into one task
    return hosts.repartition(n, "host").sortWithinPartitions("host", "url").mapInArrow(run, FETCHED)
