"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

1. Vectors that are equal within their label are one class; only classes go on.
2. Signs on fixed pseudo-random hyperplanes give each class a signature, and signs on further ones, of its own for each
   table, a bucket in every table. Classes of one bucket whose signatures differ in few bits match.
3. Classes are put into blocks by the leader among those that they match, and two blocks meet, once, if a class of one
   matches one of the other. There all cosines are computed in double precision, so the work follows the matches, also in
   labels so dense that matches connect everything. Only a spanning set of the links leaves the task; no pairs are listed.
4. Components of the spanning links, and counts weighted by the size of the classes, go back to every row.

Bits and tables follow from the classes of the largest label, the threshold and the recall asked for (``plan``), so buckets
stay small at any size. No hyperplane serves twice, so the chances of the tables and of the signature are independent and
the recall is that of the plan. Vectors that are null, zero, or hold null or non-finite components, null labels and null ids link
with nothing, nor do vectors of different length. Repeated rows are vectors of their own. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import block_pairs, block_tasks, blocks_of, components, dealt, given, leaders, matched, roots, tasks

#: Bits of a signature, and rows of a block at most.
BITS, BLOCK = 512, 1024


def plan(classes: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """(bits of a bucket, tables, most): the recall holds at the threshold for a pair that no others link.

    Buckets hold about 16 unrelated classes of a label of ``classes``. Signatures that differ in more than ``most`` bits are
    not compared; a tenth of the pairs that the recall may lose can be lost by that, the tables make up for it.
    """
    differ = math.acos(cosine) / math.pi
    bits = min(28, max(6, math.ceil(math.log2(max(classes, 1) / 16 + 1))))
    chance = [math.exp(math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(differ) + (BITS - k) * math.log(1 - differ)) for k in range(BITS + 1)]
    most = next(k for k in range(BITS + 1) if sum(chance[k + 1 :]) <= (1 - recall) / 10)
    met = recall / (1 - sum(chance[most + 1 :]))
    return bits, math.ceil(math.log(1 - met) / math.log(1 - (1 - differ) ** bits)), most


def planes(dims: int, more: int) -> np.ndarray:
    """The hyperplanes of the signature and ``more`` of the tables."""
    return np.random.default_rng(20_240_501 + dims).standard_normal((dims, BITS + more))


def signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(cid, group_key, signature, buckets) of classes (cid, label, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.r_[0, np.cumsum(sizes)]
            signatures, keys = np.empty((len(sizes), BITS // 8), np.uint8), np.empty((len(sizes), tables), np.int64)
            for dims in np.unique(sizes):
                if dims not in held:
                    held[dims] = planes(int(dims), bits * tables)
                rows = np.flatnonzero(sizes == dims)
                x = np.stack([flat[at[r] : at[r] + dims] for r in rows])
                signs = x @ held[dims] >= 0
                signatures[rows] = np.packbits(signs[:, :BITS], axis=1)
                keys[rows] = signs[:, BITS:].reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in signatures], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))],
                ["cid", "signature", "buckets"],
            )

    return classes.select("cid", "embedding").mapInArrow(run, "cid long, signature binary, buckets array<long>")


def alike_signatures(most: int):
    """For the rows of a table with ``signature``: a function that is positive for pairs that differ in at most ``most`` bits."""

    def of(table: pa.Table):
        ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(table), -1)
        return lambda i, j: most + 1 - ones[signature[i] ^ signature[j]].sum(1, dtype=np.int64)

    return of


def verified(rows: DataFrame, cosine: float) -> DataFrame:
    """(cid, links, root) for each task: how many rows of other classes link, and the least class linked within the task.

    ``rows``: task, part, across, cid, n, embedding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches):
            keys = table.column("task").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                one = table.slice(s, e - s)
                cid, n, parts = (one.column(c).to_numpy() for c in ("cid", "n", "part"))
                vectors = one.column("embedding").to_pylist()
                dims = np.array([len(v) for v in vectors])
                links, near = np.zeros(len(cid), np.int64), []
                for d in np.unique(dims):
                    rows_d = np.flatnonzero(dims == d)
                    x = np.array([vectors[r] for r in rows_d], np.float64)
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # exact, so that no square overflows or vanishes
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    on = x @ x.T >= cosine
                    if one.column("across")[0].as_py():
                        on &= parts[rows_d][:, None] != parts[rows_d][None, :]
                    np.fill_diagonal(on, False)
                    links[rows_d] += on @ n[rows_d]
                    i, j = np.nonzero(np.triu(on))
                    near.append((rows_d[i], rows_d[j]))
                root = roots(len(cid), np.concatenate([p[0] for p in near]), np.concatenate([p[1] for p in near]), cid)
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(links[on]), pa.array(cid[root[on]])], ["cid", "links", "root"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, recall: float = 0.9999, block: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A block has twice the square root of the number of classes, 128 to BLOCK, so that a group that holds most of a small
    table meets in many tasks, too.
    """
    e = F.col(embedding).cast("array<double>")
    fine = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    same = F.transform(F.col("embedding"), lambda x: x + F.lit(0.0).cast("float"))  # no negative zeros, which are equal but have other hashes
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(fine, F.col(embedding)).alias("embedding"))
    rows = rows.withColumns({"a": F.xxhash64("label", same), "b": F.xxhash64(F.lit(5), same, "label")})  # 128 bits that stand for a class
    some = rows.where("embedding is not null")
    classes = some.groupBy("a", "b", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes).withColumn("cid", F.monotonically_increasing_id())  # of a saved table: the same whenever it is read
    largest, number = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    block = block or max(128, min(BLOCK, int(2 * (number or 0) ** 0.5)))
    bits, tables, most = plan(largest or 0, cosine, recall)
    signatures = saved(signed(classes, bits, tables).join(classes.select("cid", "label"), "cid"))
    spread = signatures.select("cid", "label", F.posexplode("buckets").alias("t", "key")).select("cid", F.xxhash64("label", "t", "key").alias("bucket"))
    alike, signs = alike_signatures(most), signatures.select("cid", "signature")
    blocks = saved(blocks_of(saved(leaders(dealt(spread, "bucket", "cid", block).join(signs, "cid"), alike)), block))
    matching = saved(spread.join(blocks, "cid"))
    met, salts = block_tasks(saved(block_pairs(dealt(matching, "bucket", "cid", block).join(signs, "cid"), alike)))
    inside = saved(blocks.join(salts, "block").join(classes.select("cid", "n", "embedding"), "cid"))
    found = saved(verified(given(inside, met), cosine))
    linked = components(found, "cid", "root").select(F.col("node").alias("cid"), "root")
    counted = classes.select("cid", "a", "b", "first", "n").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(linked, "cid", "left")
    counted = saved(counted.withColumn("comp", F.coalesce("root", "cid")))
    first = counted.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    result = matched(counted, first, ["comp"], "size").select("a", "b", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    both = matched(some.select("vec_id", "a", "b"), saved(result), ["a", "b"]).select("vec_id", "n_links", "component_id")
    both = both.unionByName(rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return both.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
