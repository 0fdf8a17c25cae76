"""Near-duplicate texts: a self-join on the Jaccard similarity of word shingles by chosen paths.

1. Every whole text becomes its set of hashed five-word shingles. Texts of equal sets are one class.
2. Chosen paths: in every run a class goes down a tree. At the root, and at every node of more than ``leaf`` classes, it
   follows shingles sampled by the node's own randomness (a minimum of a hash that all sets share), two at most nodes, so
   that a pair at the threshold still shares a branch at the deepest level in most runs. A node of at most ``leaf`` classes is compared by brute force on
   the sketches of its classes; so are groups of near copies, which no path parts, and what is left at the last level, in blocks. Nodes of a single class end at once.
   As many runs are made as the recall asks for.
3. What a sketch does not exclude is connected to candidate groups. The sets of a group meet once, in blocks, where all
   intersections are counted exactly. Links are counted there, and only a spanning set of them leaves the task.
4. Components of the spanning links, and counts weighted by the size of the classes, go back to every text.

Words are the runs of other characters than blanks and control white space, in lower case. A text of fewer than five
words has one shingle, all of them; a text with no word (null, empty) links with nothing. Sets are compared by 64-bit
hashes of their shingles. Texts of any length are read whole. Repeated rows are copies of each other; null ids count as
one text each. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text, saved, slices
from .components import components, dealt, joined_pairs, matched, roots, tasks

#: Words of a shingle, bytes of a sketch, bytes of text hashed at a time.
SIZE, SKETCH, SEGMENT = 5, 128, 1 << 19
#: Classes of a node that is compared at once, levels below the root, rows of a block of sketches and of sets.
LEAF, LEVELS, BLOCK, SET_BLOCK = 2000, 4, 512, 512
#: Bytes of sets in a block, too: near copies of long texts fill more blocks, so that a task holds about twice this at most.
SET_BYTES = 1 << 26
#: Of four nodes, those that are left by two branches; the others by one.
DOUBLE = 3

_random = np.random.default_rng(20_240_601)
_BYTE = _random.integers(1, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_FACTORS = _random.integers(1, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.r_[np.uint64(1), np.cumprod(np.full(size - 1, step, np.uint64))] for step in (_STEP, _BACK)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, by prefix sums over the bytes; long texts go in segments that end at white space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    found, begin = [], 0
    while begin < len(raw):
        end = min(len(raw), begin + SEGMENT)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        part = raw[begin:end]
        blank = _SPACE[part]
        edge = np.diff(np.r_[True, blank, True].astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(len(part) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)])]
        found.append(mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
        begin = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total = mixed(total + words[k : k + n] + np.uint64(k + 1))
    return np.unique(total)


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each of SKETCH hash functions the least value over the set."""
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, (_FACTORS[:, None] * (part ^ (part >> np.uint64(29)))[None, :]).min(1))
    return least


def agreeing(threshold: float) -> np.ndarray:
    """The chance of each number of equal bytes in the sketches of a pair at the threshold."""
    same = threshold + (1 - threshold) / 256
    return np.array([math.comb(SKETCH, k) * same**k * (1 - same) ** (SKETCH - k) for k in range(SKETCH + 1)])


def least_equal(threshold: float, recall: float) -> int:
    """Equal bytes that a pair must have to be verified: a tenth of the pairs that the recall may lose can have fewer."""
    return int(np.searchsorted(np.cumsum(agreeing(threshold)), (1 - recall) / 10, "right"))


def runs_for(threshold: float, recall: float) -> int:
    """Runs so that the recall holds for a pair at the threshold whose nodes are large down to the deepest level.

    A run finds the pair if its root and some branch at each level are shared, each with the share of equal bytes; as all
    runs use one sketch, the chance to fail in all is averaged over that share. What the sketch excludes counts as lost.
    """
    chance, least = agreeing(threshold), least_equal(threshold, recall)
    share = np.arange(SKETCH + 1) / SKETCH
    met = np.ones(SKETCH + 1)
    for _ in range(LEVELS):
        one = share * met
        met = one + DOUBLE / 4 * one * (1 - one)
    runs = 1
    while chance[:least].sum() + (chance * (1 - share * met) ** runs)[least:].sum() > 1 - recall:
        runs += 1
    return runs


def halves(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int((mixed(sets).sum() ^ np.uint64(len(sets))).astype(np.int64)), int(mixed(sets ^ np.uint64(0x5555)).sum().astype(np.int64))


def text_key(doc_id: str, text: str):
    """What finds a text again; null ids have one, too."""
    return F.xxhash64(F.col(doc_id), nonnull_text(text)).alias("key")


def sketched(docs: DataFrame, doc_id: str, text: str, runs: int) -> DataFrame:
    """doc_id, key (of id and text), set_a and set_b (128 bits that stand for the set; null: no words), paths (of the roots), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, paths, sketches = [], [], [], []
            for value in batch.column(2):
                sets = shingles(value.as_py())
                if not len(sets):
                    for column in (a, b, paths, sketches):
                        column.append(None)
                    continue
                least = minima(sets)
                for column, half in zip((a, b), halves(sets), strict=True):
                    column.append(half)
                paths.append(mixed(least[:runs] + np.arange(runs, dtype=np.uint64)).astype(np.int64).tolist())
                sketches.append((mixed(least) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "key", "set_a", "set_b", "paths", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text_key(doc_id, text), nonnull_text(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, key long, set_a long, set_b long, paths array<long>, sketch binary")


def descend(rows: DataFrame, sketches: DataFrame, leaf: int, levels: int) -> DataFrame:
    """(path, cid) of the leaves. ``rows``: (path, cid) at the roots.

    A large node whose classes mostly go on together is a group of near copies: no path parts it, so it is a leaf.
    """
    leaves = []
    for level in range(levels + 1):
        sizes = saved(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        rows = saved(matched(rows, sizes, ["path"], hot=leaf, thin=True))
        if level == levels:
            leaves.append(rows.select("path", "cid"))
            break
        leaves.append(rows.where(F.col("n") <= leaf).select("path", "cid"))
        rows = rows.where(F.col("n") > leaf)
        if not rows.take(1):
            break
        draws = F.sequence(F.lit(0), F.when(F.pmod(F.xxhash64("path", F.lit(level)), F.lit(4)) < DOUBLE, 1).otherwise(0))
        at = F.pmod(F.xxhash64("path", "draw", F.lit(11)), F.lit(SKETCH)).cast("int")
        drawn = rows.join(sketches.select("cid", "sketch"), "cid").select("path", "n", "cid", "sketch", F.explode(draws).alias("draw"))
        drawn = saved(drawn.select("path", "n", "cid", "draw", F.xxhash64("path", "draw", F.substring(F.col("sketch"), at + 1, F.lit(1))).alias("child")))
        shares = drawn.groupBy("path", "n", "draw", "child").agg(F.count(F.lit(1)).alias("k"))
        # the large nodes, one row each; with their size as that of the key, so that none of their rows is gathered
        dense = saved(shares.groupBy("path", "n").agg((F.max("k") > F.col("n") / 2).alias("dense")))
        drawn = saved(matched(drawn.select("path", "child", "draw", "cid"), dense, ["path"], hot=leaf, thin=True))
        leaves.append(drawn.where("dense and draw = 0").select("path", "cid"))
        rows = drawn.where("not dense").select(F.col("child").alias("path"), "cid")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def candidates(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Spanning links (a, b) of the classes whose sketches may belong to similar sets; ``rows``: task, part, across, cid, sketch."""
    least = least_equal(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches):
            cid, keys, parts, across = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "task", "part", "across"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1)
            alike = lambda i, j: (sketch[i] == sketch[j]).sum(1, dtype=np.int64) - least + 1  # noqa: E731, B023
            found = list(joined_pairs(keys, parts, across, alike))
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                root = roots(len(cid), a, b, cid)
                on = np.flatnonzero(root != np.arange(len(cid)))
                yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(cid[root[on]])], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """How many elements any two sets (sorted, of hashes) share, counted in slices of elements that two sets or more have.

    The sets meet in ranges of hashes that hold about ``most`` elements in all, so that what is made beside them is of that size.
    """
    shared = np.zeros((len(sets), len(sets)), np.float32)
    ranges = sum(len(s) for s in sets) // most + 1
    edges = np.array([k * 2**64 // ranges for k in range(1, ranges)], np.uint64)
    bounds = [np.r_[0, np.searchsorted(s, edges), len(s)] for s in sets]
    for k in range(ranges):
        parts = [s[at[k] : at[k + 1]] for s, at in zip(sets, bounds, strict=True)]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if not len(owner):
            continue
        order = np.argsort(flat := np.concatenate(parts), kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        number = np.cumsum(new) - 1
        often = np.bincount(number)[number] > 1
        owner, number = owner[often], number[often]
        number = np.unique(number, return_inverse=True)[1]
        cuts = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + 2048, 2048))
        for j in range(len(cuts) - 1):
            own, num = owner[cuts[j] : cuts[j + 1]], number[cuts[j] : cuts[j + 1]] - 2048 * j
            there = np.unique(own)
            has = np.zeros((len(there), 2048), np.float32)
            has[np.searchsorted(there, own), num] = 1
            shared[np.ix_(there, there)] += has @ has.T
    return shared


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, root) for each task: how many texts of other classes link, and the least class linked within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches):
            keys = table.column("task").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                one = table.slice(s, e - s)
                cid, n, parts = (one.column(c).to_numpy() for c in ("cid", "n", "part"))
                sets = [np.frombuffer(v.as_buffer(), "<u8") for v in one.column("shingles")]  # where they lie
                size = np.array([len(x) for x in sets], float)
                shared = intersections(sets)
                on = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
                if one.column("across")[0].as_py():
                    on &= parts[:, None] != parts[None, :]
                np.fill_diagonal(on, False)
                links = on @ n
                i, j = np.nonzero(np.triu(on))
                root = roots(len(cid), i, j, cid)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[root[some]])], ["cid", "links", "root"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "cid long, links long, root long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per text: doc_id, class_id, n_links, kept.

    class_id is the smallest doc_id reachable by links, its own included; n_links counts the other texts of similarity
    ``threshold`` or more; kept marks one text of each class, that of the smallest id.
    """
    runs = runs_for(threshold, recall)
    rows = saved(sketched(docs, doc_id, text, runs))
    some = rows.where("set_a is not null")
    # paths and sketch follow from the set, so those of any of its texts will do
    classes = some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    classes = saved(classes).withColumn("cid", F.monotonically_increasing_id())  # of a saved table: the same whenever it is read
    leaves = descend(classes.select(F.explode("paths").alias("path"), "cid"), classes, LEAF, LEVELS)
    met = dealt(leaves, "path", "cid", BLOCK).join(classes.select("cid", "sketch"), "cid")
    groups = components(candidates(met, threshold, recall))
    inside = saved(groups.select(F.col("node").alias("cid"), F.col("root").alias("grp")).join(classes.select("cid", "key", "set_a", "set_b", "n"), "cid"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(v.as_py()) for v in batch.column(5)]
            # texts of other sets may have the same key
            own = pa.array([len(s) > 0 and halves(s) == (a.as_py(), b.as_py()) for s, a, b in zip(sets, batch.column(3), batch.column(4), strict=True)], pa.bool_())
            made = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["cid", "grp", "n", "shingles"])
            yield made.filter(own)

    whole = matched(docs.select(text_key(doc_id, text), nonnull_text(text).alias("t")), inside, ["key"]).select("cid", "grp", "n", "set_a", "set_b", "t")
    sets = whole.mapInArrow(sets_of, "cid long, grp long, n long, shingles binary").dropDuplicates(["cid"])
    found = saved(verified(dealt(saved(sets), "grp", "cid", SET_BLOCK, F.length("shingles"), SET_BYTES), threshold))
    linked = components(found, "cid", "root").select(F.col("node").alias("cid"), "root")
    counted = classes.select("cid", "set_a", "set_b", "first", "n").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(linked, "cid", "left")
    counted = saved(counted.withColumn("comp", F.coalesce("root", "cid")))
    first = saved(counted.groupBy("comp").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("size")))
    result = matched(counted, first, ["comp"], "size", thin=True).select("set_a", "set_b", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "class_id")
    both = matched(some.select("doc_id", "set_a", "set_b"), saved(result), ["set_a", "set_b"], thin=True).select("doc_id", "class_id", "n_links")
    both = both.unionByName(rows.where("set_a is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return both.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
