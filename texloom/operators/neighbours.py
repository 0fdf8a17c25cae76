"""Exact nearest vectors for many queries at once: blocks of vectors against blocks of queries, by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block at most, about.
BLOCK = 4096


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def nearest_per_query(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, distance (squared), rank: the ``k`` nearest of ``vectors`` (vec_id, embedding) for each of ``queries``
    (query_id, query_vec), itself left out; of the same ``group`` if that is given. Ties go to the smaller id.

    Every block of a group's vectors meets every block of its queries in a task of its own, which keeps the k best of each
    query, so a hot group is spread over its blocks; the best of the blocks are ranked together. Distances by a matrix
    product choose, and are then computed from the differences. Null vectors and null groups are left out; all vectors have one length.
    """
    left = vectors.where("embedding is not null").select("vec_id", "embedding", (F.col(group) if group else F.lit(0)).alias("__g"))
    right = queries.where("query_vec is not null").select("query_id", "query_vec", (F.col(group) if group else F.lit(0)).alias("__g"))

    def parts(df: DataFrame) -> int:
        most = df.groupBy("__g").count().agg(F.max("count")).first()[0] or 1
        return -(-most // block)

    nv, nq = parts(left), parts(right)
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumns({"__v": F.pmod(F.xxhash64("vec_id"), F.lit(nv)).cast("int"), "__q": others(nq)})
    right = right.withColumns({"__q": F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"), "__v": others(nv)})

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        out = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "distance": np.empty(0)}
        if len(v) and len(q):
            x, y, ids, asked = _matrix(v["embedding"]), _matrix(q["query_vec"]), v["vec_id"].to_numpy(), q["query_id"].to_numpy()
            found = []
            for at in range(0, len(y), 256):
                z, own = y[at : at + 256], asked[at : at + 256, None] == ids
                rough = (z * z).sum(1)[:, None] - 2 * (z @ x.T) + (x * x).sum(1)
                rough[own] = np.inf
                edge = np.partition(rough, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1]
                slack = 1e-9 * (1 + (z * z).sum(1) + (x * x).sum(1).max())  # far beyond what rounding can do
                i, j = np.nonzero((rough <= (edge + slack)[:, None]) & ~own)
                exact = ((z[i] - x[j]) ** 2).sum(1)
                order = np.lexsort((ids[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i, "left")
                on = np.arange(len(i)) - first < k
                found.append((asked[at + i[on]], ids[j[on]], exact[on]))
            out = dict(zip(out, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))
        return pa.table(out)

    keys = ["__g", "__v", "__q"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, distance double")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
