"""Exact top-k search by inner product of whole numbers: distributed selection over score histograms.

1. Rows and queries are packed into blocks, saved in the shared folder. Every query block meets every row block in a task of its own
   (both carry the pair of block numbers as a key), which scores all their pairs by a matrix product.
2. A task counts each query's scores in 128 bins of the query's present interval and sends the counts from the top down
   until it has counted k: what lies below is below the k-th value of all. Summed counts name the bin of the k-th value, which
   is the next interval, until bins are one number wide: two rounds for scores up to 8192, nine for any.
3. A last pass keeps scores of at least the k-th value; of those that a task has for a query, the k first by score and id.
   These are ranked.

No task holds more than two blocks and the scores of a few of their rows at a time. Scores are exact: products run in the
shortest float type that holds every partial sum, else in integers. The work is queries times rows, as asked for.

A query is the row itself and meets every row but itself; rows that repeat an id are queries and candidates of their own.
Vectors that are null or hold a null or non-finite component, or one beyond ``LARGEST`` after scaling, take no part. A shorter
vector counts as filled up with zeros. A null id is never a query, and comes last among equal scores. Fewer than k other
rows give as many ranks; an empty table none. Columns other than the two named are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import int_rows, saved, scaled

#: Bins of a histogram as a power of two; rows and bytes of a block at most; scores that a task looks at together.
BIN_BITS, BLOCK, BLOCK_BYTES, STEP = 7, 8192, 1 << 23, 1 << 20
_PACKED = "ids binary, n_null int, rids binary, width int, matrix binary, norm long"


def packed(rows: DataFrame, name: str, block: int) -> tuple[DataFrame, int]:
    """Blocks of about ``block`` of ``rows`` (rid, vec_id, ints), sorted by id, nulls last, and how many; ``name`` has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            none = table.column("vec_id").is_null().to_numpy()
            rids, ids = table.column("rid").to_numpy(), table.column("vec_id").fill_null(0).to_numpy()
            order = np.lexsort((rids, ids, none))
            x = int_rows(table.column("ints").chunk(0))[order]
            norm = int((x.astype(np.int64) ** 2).sum(1).max())
            yield pa.RecordBatch.from_pylist([{"ids": ids[order].tobytes(), "n_null": int(none.sum()), "rids": rids[order].tobytes(), "width": x.shape[1], "matrix": x.tobytes(), "norm": norm}], pa.schema([("ids", pa.binary()), ("n_null", pa.int32()), ("rids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary()), ("norm", pa.int64())]))

    n = max(1, math.ceil(rows.count() / block))
    return saved(rows.repartition(n).mapInArrow(run, _PACKED)).withColumn(name, F.spark_partition_id()), n


class Pair:
    """A query block and a row block, of a joined row."""

    def __init__(self, row: dict):
        self.q, self.c = (np.frombuffer(row[f"{side}matrix"], np.int32).reshape(-1, row[f"{side}width"]) for side in ("q_", "c_"))
        self.q_ids, self.c_ids = (np.frombuffer(row[f"{side}ids"], np.int64) for side in ("q_", "c_"))
        q_rids, c_rids = (np.frombuffer(row[f"{side}rids"], np.int64) for side in ("q_", "c_"))
        self.c_null = np.arange(len(c_rids)) >= len(c_rids) - row["c_n_null"]
        by_rid = np.argsort(c_rids)
        at = np.minimum(np.searchsorted(c_rids[by_rid], q_rids), len(c_rids) - 1)
        self.own = np.where(c_rids[by_rid[at]] == q_rids, by_rid[at], -1)  # the column of the query itself, if it is in the block
        most = math.isqrt(row["q_norm"] * row["c_norm"]) + 1  # no sum of some of the products is larger
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        wide = min(self.q.shape[1], self.c.shape[1])
        self.q, self.c = self.q[:, :wide].astype(kind), self.c[:, :wide].astype(kind).T
        self.low = np.full(len(self.q), row["lowest"], np.int64)
        for i, low in row["state"] or ():
            self.low[i] = low

    def reaching(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of the scores from each query's low up, without the query itself; some queries at a time, in order."""
        step = max(1, STEP // self.c.shape[1])
        for at in range(0, len(self.q), step):
            found = self.q[at : at + step] @ self.c
            i, j = np.nonzero(found >= self.low[at : at + step, None])
            on = self.own[at + i] != j
            i, j = i[on], j[on]
            yield at + i, j, found[i, j].astype(np.int64)


def counts(pairs: DataFrame, k: int, shift: int) -> DataFrame:
    """(qb, i, low, n): how many scores lie in the bin that begins at ``low``, from the top down to the pair's own k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 1 << BIN_BITS
        for batch in batches:
            for row in (r for at in range(len(batch)) for r in batch.slice(at, 1).to_pylist()):
                pair = Pair(row)
                for i, _, score in pair.reaching():
                    if not len(i):
                        continue
                    first, rows = i[0], i[-1] - i[0] + 1
                    bins = np.minimum((score - pair.low[i]) >> shift, most)
                    down = np.bincount((i - first) * (most + 1) + bins, minlength=rows * (most + 1)).reshape(rows, most + 1)[:, ::-1]
                    at, bin_at = np.nonzero((down > 0) & (np.cumsum(down, 1) - down < k))
                    low = pair.low[first + at] + ((most - bin_at).astype(np.int64) << shift)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["qb"], np.int32)), pa.array((first + at).astype(np.int32)), pa.array(low), pa.array(down[at, bin_at].astype(np.int64))], ["qb", "i", "low", "n"])

    return pairs.mapInArrow(run, "qb int, i int, low long, n long")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """(qb, i, query_id, vec_id, score) of scores from each query's low up, at most k of each pair of blocks and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(len(batch)) for r in batch.slice(at, 1).to_pylist()):
                pair = Pair(row)
                for i, j, score in pair.reaching():
                    order = np.lexsort((j, -score, i))  # rows stand in order of their ids
                    i, j, score = i[order], j[order], score[order]
                    begun = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
                    on = np.arange(len(i)) - begun < k
                    i, j, score = i[on], j[on], score[on]
                    columns = [pa.array(np.full(len(i), row["qb"], np.int32)), pa.array(i.astype(np.int32)), pa.array(pair.q_ids[i]), pa.array(pair.c_ids[j], mask=pair.c_null[j]), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["qb", "i", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "qb int, i int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of the highest score for every row for which ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id. A block has eight times the square root of the number
    of rows, up to BLOCK rows and BLOCK_BYTES, so that a small table gives work to many tasks, too.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("ints"))
    rows = saved(rows.where("ints is not null")).withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "ints")
    number, width = rows.agg(F.count(F.lit(1)), F.max(F.size("ints"))).first()
    block = block or max(256, min(BLOCK, int(8 * number**0.5), BLOCK_BYTES // (4 * (width or 1))))
    named = lambda df, side, key: df.select(key, *[F.col(c).alias(f"{side}{c}") for c in ("ids", "n_null", "rids", "width", "matrix", "norm")])
    queries, nq = packed(rows.where(is_query & F.col("vec_id").isNotNull()), "qb", block)
    others, nc = packed(rows, "cb", block)
    largest = [df.agg(F.max("norm")).first()[0] or 0 for df in (queries, others)]
    lowest = -math.isqrt(largest[0] * largest[1]) - 1
    n = nq * nc
    right = named(others, "c_", "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).repartition(n, "qb", "cb")

    def pairs(state: DataFrame | None) -> DataFrame:
        left = named(queries, "q_", "qb").withColumn("lowest", F.lit(lowest).cast("long"))
        left = left.join(state, "qb", "left") if state is not None else left.withColumn("state", F.lit(None).cast("array<struct<i: int, low: bigint>>"))
        left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).repartition(n, "qb", "cb")
        fields = ["qb", *[f"{side}{c}" for side in ("q_", "c_") for c in ("ids", "n_null", "rids", "width", "matrix", "norm")], "lowest", F.transform("state", lambda s: F.array(s.i.cast("long"), s.low)).alias("state")]
        return left.hint("merge").join(right, ["qb", "cb"]).select(*fields)

    state, from_top = None, Window.partitionBy("qb", "i").orderBy(F.desc("low"))
    rounds = next(m for m in range(1, 10) if 1 << (BIN_BITS * m) > -2 * lowest)
    for shift in range(BIN_BITS * (rounds - 1), -1, -BIN_BITS):
        sums = counts(pairs(state), k, shift).groupBy("qb", "i", "low").agg(F.sum("n").alias("n"))
        reached = sums.withColumn("above", F.sum("n").over(from_top)).where(F.col("above") >= k).groupBy("qb", "i").agg(F.max("low").alias("low"))
        state = saved(reached.groupBy("qb").agg(F.collect_list(F.struct("i", "low")).alias("state")))  # a block's queries at most
    ranked = best(pairs(state), k).withColumn("rank", F.row_number().over(Window.partitionBy("qb", "i").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
