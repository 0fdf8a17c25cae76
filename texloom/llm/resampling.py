"""Importance resampling towards a target distribution over hashed word n-grams, drawn without replacement.

1. In Arrow batches, a task maps the words of some texts to whole numbers by a dictionary and n-grams to tuples of these, kept as one
   number each. Equal tuples are counted together, the bytes of each distinct one are put together and hashed once, and
   bucket and count are joined back to where the tuple stands. A task sends one count for each bucket.
2. Counts of documents and of target texts, a row for each bucket, are joined to gains.
3. A second pass of the same kind sums the gains of every document. Texts are never shuffled.
4. Noise from the document's id makes the highest scores a draw without replacement. They are ranked by a sort over ranges
   and the sizes of its partitions, so no task holds more than a range.

Held by a task: the dictionary (emptied when it has MOST words or WORD_BYTES), the tuples of about RUN words, and the buckets.
Long texts are taken in pieces that share their edge words, so that no n-gram is lost.

A null or empty text has no features and weight 0. A null id draws its noise from the seed alone and comes last among
equal scores. Repeated rows are drawn each. Empty tables count as zeros. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text, saved, slices

#: Words of a dictionary and their bytes, words that are counted together, bytes of a piece of text.
MOST, WORD_BYTES, RUN, PIECE = 1 << 20, 1 << 26, 1 << 20, 1 << 22
#: Bits of a word's number in a tuple: it can hold three.
BITS = 21
#: Each byte in lower case if it can stand in a word, else a space; bytes of characters beyond ASCII can.
WORD_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Dictionary:
    """Numbers of words and buckets of their n-grams of up to ``longest`` (three at most) words."""

    def __init__(self, longest: int, buckets: int):
        assert 1 <= longest <= 3
        self.longest, self.buckets = longest, buckets
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = lambda: len(self.number) + 1

    def runs(self, texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) of every feature, for about RUN words at a time; a row can go on in the next."""
        held, words = [], 0
        for row, text in texts:
            text, begin, carry = text.translate(WORD_BYTE), 0, []
            while begin < len(text):
                end = text.find(b" ", begin + PIECE)
                end = len(text) if end < 0 else end
                piece = carry + text[begin:end].split()
                held.append((row, len(carry), np.fromiter(map(self.number.__getitem__, piece), np.int64, len(piece))))
                words += len(piece)
                carry, begin = piece[len(piece) - self.longest + 1 :] if self.longest > 1 else [], end
                if words >= RUN:
                    yield self._features(held)
                    held, words = [], 0
        if held:
            yield self._features(held)

    def _features(self, held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        number, sizes = np.concatenate([h[2] for h in held]), np.array([len(h[2]) for h in held])
        ends = np.cumsum(sizes)
        row, end, new = (np.repeat(x, sizes) for x in ([h[0] for h in held], ends, ends - sizes + [h[1] for h in held]))
        word, found = [b"", *self.number], []
        for n in range(1, self.longest + 1):
            at = np.arange(max(0, len(number) - n + 1))
            at = at[(at + n - 1 < end[at]) & (at + n - 1 >= new[at])]  # within the piece, and not all in the words that it shares with the one before
            tuples = number[at]
            for k in range(1, n):
                tuples = tuples << BITS | number[at + k]
            distinct, back = np.unique(tuples, return_inverse=True)
            parts = [(distinct >> BITS * (n - 1 - k) & (1 << BITS) - 1).tolist() for k in range(n)]
            hashed = (zlib.crc32(b" ".join([word[i] for i in ids])) % self.buckets for ids in zip(*parts, strict=True))
            found.append((row[at], np.fromiter(hashed, np.int64, len(distinct))[back]))
        if len(word) > MOST or sum(map(len, word)) > WORD_BYTES:
            self._empty()
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    return ((i, x.as_py()) for i, x in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())))


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): how many features of all texts are in a bucket, for those that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(buckets, np.int64), Dictionary(longest, buckets)
        for batch in slices(batches):
            for _, bucket in words.runs(texts_of(batch)):
                n += np.bincount(bucket, minlength=buckets)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on])], ["bucket", "n"])

    return texts.select(nonnull_text(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the logarithm of how much likelier it is in the target, floored; add-one smoothing."""
    own = bucket_counts(docs, text, buckets, longest).withColumnRenamed("n", "s")
    aim = bucket_counts(target, target_text, buckets, longest).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    both = saved(both)
    whole_own, whole_aim = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(float(whole_own + buckets))) / ((F.col("s") + 1) * F.lit(float(whole_aim + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 2) -> DataFrame:
    """doc_id, n_features, weight of every document: the floored mean gain of its features."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), nonnull_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(longest, len(gain))
        for batch in slices(batches):
            sums, n = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, bucket in words.runs(texts_of(batch)):
                sums += np.bincount(row, gain[bucket], len(batch)).astype(np.int64)
                n += np.bincount(row, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` and their rank from 1 in ``order``: a sort over ranges, then places within partitions and the sizes of those before."""
    placed = saved(rows.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())  # of a saved table: partition and place
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # a row for each partition of the sort
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offsets = F.array(*[F.lit(b).cast("long") for b in before]) if before else F.array(F.lit(0).cast("long"))
    return placed.withColumn("rank", F.get(offsets, part.cast("int")) + place + 1).drop("__at")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, longest: int = 2
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank counts the drawn ones from 1, and is null for the others.

    ``percent`` of the documents of at least ``min_words`` words are drawn, rounded down: the highest scores, ties to the smaller id.
    """
    found = gains(docs, target, text, target_text, buckets, longest).collect()  # a row for each bucket
    gain = np.zeros(buckets, np.int64)
    for bucket, value in found:
        gain[bucket] = value
    rows = weighed(docs, gain, doc_id, text, longest)
    least = sum(max(0, min_words - k) for k in range(longest))  # the features of a text of min_words words; fewer words have fewer
    rows = saved(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))).withColumn("rid", F.monotonically_increasing_id())
    fit = F.col("n_features") >= least
    draw = rows.where(fit).count() * percent // 100
    first = ranked(rows.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")])
    everything = first.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return everything.select("doc_id", "n_features", "weight", "score", "rank")
