"""Connected components of a link table by alternating large-star and small-star steps, and groups dealt to blocks.

Both are shared by the near-duplicate operators. Nothing is gathered on the driver but a row of sums each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


#: Rows of a key from which on it counts as hot, hot keys that are named one by one at most, and salts beyond that.
HOT, FEW, SALTS = 1000, 10_000, 32


def matched(rows: DataFrame, small: DataFrame, keys: list[str], size: str = "n", hot: int = HOT, few: int = FEW, thin: bool = False) -> DataFrame:
    """``rows`` joined with ``small``, which has one row for each key and in ``size`` the number of the key's rows.

    The rows of hot keys stay where they are: up to ``few`` hot keys are named by their hash in a filter, and what ``small``
    has for them is broadcast; if there are more, all of it is salted. ``thin`` rows, of a few numbers, are cheaper to move
    than to read twice: theirs are salted for the hot keys alone, in one join. Give a saved ``small``; it is read more than once.
    """
    name = F.xxhash64(*keys)
    known = [r[0] for r in small.where(F.col(size) > hot).select(name).take(few + 1)]
    if not known:
        return rows.join(small, keys)
    named = name.isin(known) if len(known) <= few else F.lit(True)  # the same on both sides, so equal hashes do no harm
    if len(known) <= few and not thin:
        return rows.where(named).join(F.broadcast(small.where(named)), keys).unionByName(rows.where(~named).join(small.where(~named), keys))
    copies = small.withColumn("__salt", F.explode(F.when(named, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(named, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.withColumn("__salt", salt).join(copies, [*keys, "__salt"]).drop("__salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link to another; nulls and loops are left out.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones, until a node with a
    smaller neighbour has no other: about log n rounds, each saved in the shared checkpoint folder.
    """
    edges = saved(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    while True:
        both = edges.select(ends.alias("end")).select("end.u", "end.v")
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        if not least.where("m < u and n > 1").take(1):  # all are stars, each around its least node
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        hung = edges.select(F.col("v").alias("u"), F.col("u").alias("other"))
        large = saved(matched(hung, least, ["u"], thin=True).select(F.col("other").alias("u"), F.col("m").alias("v")).distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        # the row of the smallest neighbour itself gives the node's own link
        small = matched(large, least, ["u"], thin=True).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.distinct())


def dealt(rows: DataFrame, group: str, node: str, block: int, weight: Column | None = None, most: int = 1) -> DataFrame:
    """``rows`` of groups of two or more, with ``task``, ``part`` and ``across``, so that any two rows of a group meet in one task.

    A group of more than ``block`` rows, or of more than ``most`` in the sum of ``weight``, is cut to parts by the hash of ``node``; a task has one part, or two parts whose
    rows are compared across only, even if one of them turns out empty. So no task gets more than about two blocks, and every row goes to as many tasks as its
    group has parts. The rows of a group that is cut are not gathered for it; with a ``weight`` they are taken as long, and stay where they are. ``rows`` is read more than once.
    """
    count = F.count(F.lit(1))
    needed = F.ceil(count / block) if weight is None else F.least(count, F.greatest(F.ceil(count / block), F.ceil(F.sum(weight) / most)))
    sizes = saved(rows.groupBy(group).agg(count.alias("__n"), needed.cast("int").alias("__parts")).where("__n > 1"))
    parts = F.col("__parts")
    met = matched(rows, sizes, [group], "__n", block, thin=weight is None).withColumn("part", F.pmod(F.xxhash64(node, F.lit(7)), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    met = met.withColumn("__other", other)
    return met.withColumn("task", F.xxhash64(group, F.least("part", "__other"), F.greatest("part", "__other"))).withColumn("across", F.col("part") != F.col("__other")).drop("__n", "__parts", "__other")


def tasks(batches: Iterator[pa.RecordBatch], key: str = "task") -> Iterator[pa.Table]:
    """Tables of whole tasks from batches sorted by ``key``; the last task of a batch waits for the next."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(table)
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held or cut:  # else the whole batch is of one task, which may go on in the next
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def joined_pairs(keys: np.ndarray, parts: np.ndarray, across: np.ndarray, alike, most: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, value) of the pairs of each task, ``keys`` sorted, for which ``alike(i, j)`` is positive; each pair once.

    Short tasks are compared together, distance by distance; in a long one each row meets all later ones.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    size = ends - starts
    end_of = np.repeat(ends, size)
    short = np.repeat(size <= most, size)
    for step in range(1, min(most, int(size.max())) if len(size) else 0):
        i = np.flatnonzero(short & (np.arange(len(keys)) + step < end_of))
        if not len(i):
            break
        i = i[~across[i] | (parts[i] != parts[i + step])]
        value = alike(i, i + step)
        on = value > 0
        yield i[on], i[on] + step, value[on]
    for s, e in zip(starts[size > most], ends[size > most], strict=True):
        for i in range(s, e - 1):
            j = np.arange(i + 1, e)
            if across[i]:
                j = j[parts[j] != parts[i]]
            value = alike(np.full(len(j), i), j)
            on = value > 0
            yield np.full(int(on.sum()), i), j[on], value[on]


#: An odd number, so that ``cid * RANK`` (of 64 bits) puts numbers into another order without making two equal.
RANK = np.int64(-7046029254386353131)


def leaders(rows: DataFrame, alike_of) -> DataFrame:
    """(cid, leader) of the rows that match another: the least rank among a row and all that it matches.

    ``rows``: task, part, across, cid, and what ``alike_of(table)`` makes its ``alike(i, j)`` from. Of each task one row for
    a cid is passed on, never the matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches):
            cid, keys, parts, across = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "task", "part", "across"))
            rank = cid * RANK
            least, some = rank.copy(), np.zeros(len(cid), bool)
            for i, j, _ in joined_pairs(keys, parts, across, alike_of(table)):
                np.minimum.at(least, i, rank[j])
                np.minimum.at(least, j, rank[i])
                some[i] = some[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(least[some])], ["cid", "leader"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "cid long, leader long").groupBy("cid").agg(F.min("leader").alias("leader"))


def blocks_of(led: DataFrame, block: int) -> DataFrame:
    """(cid, block): rows of one leader together, cut by their hash to blocks of about ``block`` rows at most. ``led`` is read more than once.

    Near copies share their leader, so a group of them fills its blocks; along a chain leaders change every few rows.
    """
    sizes = saved(led.groupBy("leader").agg(F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("cid", F.lit(7)), F.ceil(F.col("n") / block))
    return matched(led, sizes, ["leader"], hot=block, thin=True).select("cid", F.xxhash64("leader", part).alias("block"))


def block_pairs(rows: DataFrame, alike_of) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks in which some row of one matches a row of the other; ``rows`` as for ``leaders``, with block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches):
            keys, parts, across = (table.column(c).to_numpy(zero_copy_only=False) for c in ("task", "part", "across"))
            own, at = np.unique(table.column("block").to_numpy(), return_inverse=True)
            code = lambda i, j: np.minimum(at[i], at[j]) * len(own) + np.maximum(at[i], at[j])  # noqa: E731, B023
            found = [np.unique(code(i, j)) for i, j, _ in joined_pairs(keys, parts, across, alike_of(table)) if len(i)]
            if found:
                codes = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(own[codes // len(own)]), pa.array(own[codes % len(own)])], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def block_tasks(pairs: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Tasks (block, salt, task, across), one or two rows for each pair of blocks, and (block, salts): a block in more than ``most`` tasks has several salts.

    Rows of a block meet their tasks by block and salt, so a block with very many tasks is no hot key. ``pairs`` is read more than once.
    """
    each = pairs.select(F.xxhash64("a", "b").alias("task"), (F.col("a") != F.col("b")).alias("across"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    degree = saved(each.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    salts = F.ceil(F.col("n") / most).cast("int")
    salted = matched(each, degree, ["block"], thin=True).select("block", F.pmod(F.xxhash64("task", F.lit(13)), salts).cast("int").alias("salt"), "task", "across")
    return salted, degree.select("block", salts.alias("salts"))


def given(rows: DataFrame, block_task: DataFrame) -> DataFrame:
    """``rows`` (with block, salts), each copied to every task of its block; part is the block."""
    copies = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return copies.join(block_task, ["block", "salt"]).drop("salt").withColumnRenamed("block", "part")


def roots(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the row of least ``order`` that the pairs (a, b) connect it with."""
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    label = rank.copy()
    by_rank = np.argsort(rank)
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = np.minimum(label, label[by_rank[label]])
        if (label == old).all():
            return by_rank[label]
