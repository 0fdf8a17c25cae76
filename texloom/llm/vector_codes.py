"""Compression of vectors to short codes: product codebooks fitted by Lloyd's rounds over weighted distinct parts, in whole numbers.

1. Each component becomes floor(scale * x) and each vector is cut into equal parts. Equal parts of a position are one row
   with a weight, however many vectors hold them.
2. A round assigns every distinct part to the nearest entry of its position's codebook (ties to the lower index) in Arrow
   batches; a task sends only the sums and weights of its entries, at most ``parts * entries`` rows. Entries become floored
   means; those that no part chose stay. The codebooks, ``entries`` times the length of a vector, are all that the driver holds.
3. The parts are assigned once more, and codes and errors are joined back to the vectors. Parts that many vectors share
   stay where they are in that join.

All distances and sums are exact. Vectors that are null or hold a null or non-finite component, or one beyond ``LARGEST`` after
scaling, are left out. Shorter vectors count as filled up with zeros to the longest, and to a multiple of ``parts``. The
codebooks start from the rows of the smallest ids, nulls last, ties by the vector; repeated rows are vectors of their own;
an empty table gives empty codebooks and no rows. Columns other than the three named are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_rows, saved, scaled
from .components import matched


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (ties: the lower) and the squared distance, for each row of ``x``; exact."""
    reach = 2 * int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if x.shape[1] * reach * reach < 1 << 53 else np.int64  # both are exact, the first multiplies faster
    x, book = x.astype(kind), book.astype(kind)
    square = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    best = square.argmin(1)
    return best, square[np.arange(len(x)), best].astype(np.int64)


def assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], step: int = 4096) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, position, its rows, their parts, nearest entries, squared distances) for a few rows at a time."""
    for whole in batches:
        for at in range(0, len(whole), step):
            batch = whole.slice(at, step)
            place, x = batch.column("part").to_numpy(), int_rows(batch.column("x"), books[0].shape[1])
            for part, book in enumerate(books):
                on = np.flatnonzero(place == part)
                if len(on):
                    yield batch, part, on, x[on], *nearest(x[on], book)


def summed(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, sums) of each task: weight and weighted sum of the parts that chose an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((*n.shape, books[0].shape[1]), np.int64)
        for batch, part, on, x, best, _ in assigned(batches, books):
            weight = batch.column("n").to_numpy()[on]
            np.add.at(n[part], best, weight)
            np.add.at(sums[part], best, x * weight[:, None])
        part, entry = np.nonzero(n)
        if len(part):
            ends = np.arange(0, len(part) * sums.shape[2] + 1, sums.shape[2], dtype=np.int32) if sums.shape[2] else np.zeros(len(part) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[part, entry].ravel()))], ["part", "entry", "n", "sums"])

    return distinct.select("part", "x", "n").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def encoded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(a, b, n, entry, error) of every distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, on, _, best, square in assigned(batches, books):
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b", "n"]).take(pa.array(on)).columns, pa.array(best.astype(np.int32)), pa.array(square)], ["a", "b", "n", "entry", "error"])

    return distinct.mapInArrow(run, "a long, b long, n long, entry int, error long")


def fitted(distinct: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of Lloyd's method over weighted distinct parts."""
    for _ in range(rounds):
        found = summed(distinct, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(books[0].shape[1])])
        books = [book.copy() for book in books]
        for part, entry, n, *sums in found.collect():
            books[part][entry] = [s // n for s in sums]
    return books


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) per vector that is not left out, and the codebooks, one matrix for each part position.

    A code has as many hexadecimal digits for each part, in order, as the last index needs; the error is the sum of the squared distances.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled(F.col(embedding), scale).alias("ints"))
    rows = saved(rows.where("ints is not null")).withColumn("rid", F.monotonically_increasing_id())  # of a saved table: the same whenever it is read
    width = -(-(rows.agg(F.max(F.size("ints"))).first()[0] or 0) // parts)
    whole = F.concat("ints", F.array_repeat(F.lit(0), parts * width - F.size("ints")))
    cut = rows.select("rid", "vec_id", "label", F.posexplode(F.array(*[F.slice(whole, p * width + 1, width) if width else F.slice(whole, 1, 0) for p in range(parts)])).alias("part", "x"))
    distinct = cut.groupBy("part", "x").agg(F.count(F.lit(1)).alias("n"))
    keys = {"a": F.xxhash64("part", "x"), "b": F.xxhash64(F.lit(5), "x", "part")}  # 128 bits that stand for a part
    distinct = saved(distinct.withColumns(keys))
    start = [r[0] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select(whole).collect()]
    books = list(np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2))
    if start:
        books = fitted(distinct, books, rounds)
    codes = saved(encoded(distinct, books))
    both = matched(cut.withColumns(keys).drop("x"), codes, ["a", "b"])
    digits = len(f"{entries - 1:x}")
    one = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda p: F.lpad(F.lower(F.hex(p.entry)), digits, "0"))
    return both.groupBy("rid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_join(one, "").alias("code"), F.sum("error").alias("error")).drop("rid"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error, its errors summed over equal labels, nulls together."""
    keyed = saved(coded).withColumns({"key": F.coalesce("label", F.lit(0)), "none": F.col("label").isNull()})
    sums = saved(keyed.groupBy("key", "none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return matched(keyed, sums, ["key", "none"]).drop("key", "none", "n")
