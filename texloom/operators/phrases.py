"""Any number of phrases looked for in all texts at once, by the rarest q-grams of the phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Different phrases, at most, that every task holds, and their bytes.
FEW, FEW_BYTES = 100_000, 1 << 24
#: Bytes of text that are searched at once, about, and places of it that are looked up at once.
SLICE, WINDOW = 1 << 20, 1 << 18
#: Phrases of one bucket beyond which a text is asked for each of them once, not at every place.
CROWD = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``begin`` on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - begin, n)


class Finder:
    """The pairs of a text and a phrase that it holds, for many texts at once, on their bytes in UTF-8.

    A phrase stands in a table by the run of ``q`` bytes of it (all of it, if it is shorter; twice as many, if it has them;
    eight at most) that the fewest phrases share. Every place of the texts is looked up, and what is met is compared eight
    bytes at a time.
    """

    def __init__(self, phrases: list[bytes], q: int):
        self.phrases, self.length = phrases, np.array([len(p) for p in phrases], np.int64)
        words = -(-self.length // 8)
        self.first = np.cumsum(words) - words
        self.words = np.frombuffer(b"".join(p.ljust(8 * w, b"\0") for p, w in zip(phrases, words.tolist(), strict=True)), "<u8")
        flat, at = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8), np.cumsum(self.length) - self.length
        q, self.anchor, self.tables = min(q, 8), np.zeros(len(phrases), np.int64), []
        size = np.where(self.length < min(2 * q, 8), np.minimum(self.length, q), min(2 * q, 8))
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            n = self.length[own] - s + 1
            phrase, place = np.repeat(own, n), _runs(at[own], n)
            gram = _eights(flat)[place] & _FIRST[s]
            _, which, shared = np.unique(gram, return_inverse=True, return_counts=True)
            order = np.lexsort((place, shared[which], phrase))
            best = order[np.searchsorted(phrase[order], own)]
            self.anchor[own] = place[best] - at[own]
            shift = 64 - max(12, (8 * len(own)).bit_length())
            bucket = (gram[best] * _MIX >> np.uint64(shift)).astype(np.int64)
            count = np.bincount(bucket, minlength=1 << 64 - shift)
            start, items = np.cumsum(count) - count, own[np.argsort(bucket, kind="stable")]
            self.tables.append((_FIRST[s], np.uint64(shift), count > 0, count.astype(np.int32), start.astype(np.int32), items))

    def _same(self, view: np.ndarray, begin: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places at which the phrase stands."""
        left, at, word, found = self.length[phrase], begin, self.first[phrase], []
        while len(begin):
            same = view[at] & _FIRST[np.minimum(left, 8)] == self.words[word]
            begin, phrase, left, at, word = begin[same], phrase[same], left[same] - 8, at[same] + 8, word[same] + 1
            found.append((begin[left <= 0], phrase[left <= 0]))
            more = left > 0
            begin, phrase, left, at, word = begin[more], phrase[more], left[more], at[more], word[more]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (begin, phrase)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and of phrases; text i is ``data[offsets[i]:offsets[i + 1]]``."""
        total, many, found, crowds = len(data), len(self.phrases), [], set()
        text_at = lambda place: np.searchsorted(offsets, place, "right") - 1
        view = _eights(np.concatenate([data, np.zeros(8, np.uint8)]))
        for a in range(0, total, WINDOW):
            here = np.ascontiguousarray(view[a : min(a + WINDOW, total)])
            for t, (mask, shift, used, count, start, items) in enumerate(self.tables):
                bucket = ((here & mask) * _MIX >> shift).view(np.int64)
                at = np.flatnonzero(used[bucket])
                bucket, at = bucket[at], at + a
                n = count[bucket]
                if (crowd := n > CROWD).any():
                    crowds.update((t, *divmod(k, len(count))) for k in np.unique(text_at(at[crowd]) * len(count) + bucket[crowd]).tolist())
                    at, bucket, n = at[~crowd], bucket[~crowd], n[~crowd]
                for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // WINDOW)) + 1):
                    phrase = items[_runs(start[bucket[part]], n[part])]
                    begin = np.repeat(at[part], n[part]) - self.anchor[phrase]
                    inside = (begin >= 0) & (begin + self.length[phrase] <= total)
                    begin, phrase = self._same(view, begin[inside], phrase[inside])
                    i = text_at(begin)
                    one = begin + self.length[phrase] <= offsets[i + 1]
                    found.append(np.unique(i[one] * many + phrase[one]))
        for t, i, b in crowds:
            whole, (*_, count, start, items) = data[offsets[i] : offsets[i + 1]].tobytes(), self.tables[t]
            found.append(np.array([i * many + p for p in items[start[b] : start[b] + count[b]].tolist() if self.phrases[p] in whole], np.int64))
        return np.divmod(np.unique(np.concatenate(found)), many) if found else (np.empty(0, np.int64),) * 2

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, number of a phrase) of batches of key and text."""
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            cuts = [0, *(np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // SLICE)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                row, phrase = self.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(phrase, pa.int32())], ["__key", "n"])


def grams(text: Column, size: int) -> Column:
    """Hashes of the distinct runs of ``size`` characters."""

    def of(chars: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(size)], F.lit(size))))

    return F.element_at(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), of), 1)  # split once, not for each place


def matches(texts: DataFrame, phrases: DataFrame, q: int = 4, key: str = "doc_id", text: str = "text", phrase_id: str = "phrase_id", phrase: str = "phrase", few: int = FEW) -> DataFrame:
    """(phrase_id, key): every row of ``texts`` with each phrase that its text holds, once; places within words count, as in ``contains``.

    A phrase is keyed by the q-gram of it (all of it, if it is shorter) that the fewest phrases share, so any number of
    phrases costs one pass over the texts, and only what meets by such a gram is compared whole. Up to ``few`` different
    phrases, of FEW_BYTES in all, go to the texts, which are searched where they are; of more, grams and texts are joined.
    Null and empty phrases are held by none.
    """
    own = phrases.select(F.col(phrase_id).alias("phrase_id"), F.col(phrase).alias("phrase")).where("length(phrase) > 0")
    rows = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    listed = own.select("phrase").distinct()
    n, size = listed.limit(few + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase"))).first()
    if not n:
        return rows.where("false").select(F.lit(None).cast(own.schema["phrase_id"].dataType).alias("phrase_id"), F.col("__key").alias(key))
    if n <= few and size <= FEW_BYTES:
        names = [r[0] for r in listed.collect()]
        finder = Finder([p.encode() for p in names], q)
        met = rows.mapInArrow(finder.batches, StructType([rows.schema["__key"], StructField("n", IntegerType())]))
        numbered = texts.sparkSession.createDataFrame(list(enumerate(names)), "n int, phrase string").join(own, "phrase")
        return met.join(F.broadcast(numbered.select("n", "phrase_id")), "n").select("phrase_id", F.col("__key").alias(key))
    own = own.withColumn("size", F.least(F.length("phrase"), F.lit(q)))
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # q numbers at most
    of_size = F.coalesce(*[F.when(F.col("size") == s, grams(F.col("phrase"), s)) for s in sizes])
    one = own.select("phrase_id", F.explode(of_size).alias("gram"))
    counts = one.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = one.join(counts, "gram").groupBy("phrase_id").agg(F.min(F.struct("n", "gram")).alias("g")).select("phrase_id", F.col("g.gram").alias("gram"))
    none = F.array().cast("array<bigint>")
    # an outer explode: of an inner one Spark infers a filter on the array, for which it makes all grams again
    parts = F.concat(*[F.when(F.length("__text") >= s, grams(F.col("__text"), s)).otherwise(none) for s in sizes])
    each = rows.select(F.col("__key").alias("__met"), F.explode_outer(parts).alias("gram"))
    pairs = each.join(rarest, "gram").select("phrase_id", "__met").distinct().join(own.select("phrase_id", "phrase"), "phrase_id").join(rows, F.col("__met").eqNullSafe(F.col("__key")))
    return pairs.where(F.contains("__text", F.col("phrase"))).select("phrase_id", F.col("__key").alias(key))


def held(texts: DataFrame, phrases: DataFrame, q: int = 4, key: str = "doc_id", text: str = "text", phrase_id: str = "phrase_id", phrase: str = "phrase", few: int = FEW) -> DataFrame:
    """(phrase_id, key): each pair of a phrase and a key with a text that holds it, once, as ``matches`` finds them; null keys are left out.
    Rows of one key are one text each, and give one pair."""
    return matches(texts, phrases, q, key, text, phrase_id, phrase, few).where(F.col(key).isNotNull()).distinct()
