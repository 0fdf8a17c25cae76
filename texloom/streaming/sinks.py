"""Writes that may run twice: what a micro-batch writes replaces what an earlier try of it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions of a table that is upserted, by the hash of the key.
BUCKETS = 16


def _replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows are kept under the number of their batch, so a batch that runs again replaces its own rows. A log of stages, say."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_partitions(batch.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")

    return write


def exists(df: DataFrame, path: str) -> bool:
    """Whether a table has been written there."""
    try:
        df.sparkSession.read.parquet(path)
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def upsert(path: str, key: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one row for each key, that of the greatest ``order``; of equal ones the later batch's.

    Only partitions that the batch touches are read and written anew. The same batch once more changes nothing, and neither does an older one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        new = batch.withColumns({"bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"), "batch_id": F.lit(batch_id).cast("long")})
        rows = new
        if exists(batch, path):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
            if not touched:
                return
            rows = new.unionByName(batch.sparkSession.read.parquet(path).where(F.col("bucket").isin(touched)).select(*new.columns))
        one = F.max_by(F.struct(*columns, "batch_id"), F.struct(order, "batch_id")).alias("row")
        _replace_partitions(rows.groupBy("bucket", *[F.col(k).alias(f"__{k}") for k in key]).agg(one).select("bucket", "row.*"), path, "bucket")

    return write


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, through ``write``, and then stop; another run goes on after it."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
