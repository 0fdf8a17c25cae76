"""Tokenised documents cut to pieces, and pieces packed to sequences by vector best fit.

``pieces`` gives the ids of each whole text and an end id, cut only where a document is longer than a sequence.
``packed`` deals the pieces at random, by hash, to shards of about ``shard_rows`` pieces. In a shard the pieces go, the
longest first, to the open sequence that fits best: every piece asks for tokens, one document and the square of its
length in attention cost; of the sequences whose residual capacities hold it under every constraint, the one is taken
whose weighted residual norm after it is least (or, with ``rule="dot"``, whose weighted dot product of request and
residual is greatest). A shard leaves about one sequence badly filled, whatever the size of the whole.

Null text counts as empty: one piece, the end id. Repeated rows are documents of their own. Other columns are dropped
by ``pieces``; ``packed`` keeps all columns and replaces those named sequence_id and offset. Empty tables stay empty.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import byte_names
from .common import nonnull_text, saved, slices

#: Words that a worker remembers in each half of its memory, and the longest remembered.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Characters of the texts whose words are looked up together.
TOGETHER = 1 << 21

#: A character at or beyond U+0180, or U+0130 (its lower case lies beyond), or one that ``str.split`` but not the vocabulary's pattern takes for a blank.
ODD = re.compile("[^\x00-\u012f\u0131-\u017f]|[\x1c-\x1f]")
#: Words, numerals and runs of other characters of a lower-case text without such, as the vocabulary's pattern parts them.
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
PARTS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")


class Words:
    """Ids by the tokenizers library, word by word, as most words were seen before.

    No token of the vocabulary's pattern crosses a blank, so what stands between blanks has its ids whatever surrounds it.
    New words are parted here and go through the library's merges only. Texts with ``ODD`` characters, and those that hold
    a special token's name, go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]
        self.names = {b: c for c, b in byte_names().items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words that are not in the younger half there."""
        self.young |= {w: self.old[w] for w in words if w in self.old}
        if new := [w for w in words if w not in self.old]:
            raw = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.names) for p in PARTS.findall(" ".join(new))]
            ids = np.array(self.merges.encode_batch_fast([" ".join(raw)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in new])
            cuts = [0, *(np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1).tolist()]  # a word's tokens have its bytes
            packed = ids.tobytes()
            self.young |= {w: packed[4 * a : 4 * b] for w, a, b in zip(new, cuts, cuts[1:], strict=False)}

    def simple(self, text: str) -> bool:
        """Whether the words can be looked up one by one."""
        if "<|" in text and any(s in text for s in self.special):
            return False
        return not any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else not ODD.search(text)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, packed as little-endian unsigned 32-bit; texts of about ``TOGETHER`` characters learn their new words at once."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < TOGETHER:
                size += len(texts[end])
                end += 1
            words = [t.lower().split() if self.simple(t) else None for t in texts[begin:end]]
            new = set().union(*filter(None, words)).difference(self.young)
            self.learn(new)
            get = self.young.__getitem__
            for text, ws in zip(texts[begin:end], words, strict=True):
                yield self.whole(text) if ws is None else b"".join(map(get, ws))
            for w in new:
                if len(w) > CACHE_CHARS:
                    del self.young[w]
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            begin = end


_loaded: dict[int, Words] = {}


def words_of(spec: str) -> Words:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(spec)
    return _loaded[key]


def pieces(docs: DataFrame, path: str, length: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32, and ids (packed) if asked for.

    ``path`` is read on the driver.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data
    source = docs.select(F.col(doc_id), nonnull_text(text).alias("__text"))
    schema = StructType([source.schema[0], *(StructField(n, LongType()) for n in ("piece", "start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words_of(spec.value)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            row, number, begin, ids = [], [], [], []
            for at, coded in enumerate(coder.ids(batch.column(1).to_pylist())):
                coded += last
                for k, b in enumerate(range(0, len(coded), 4 * length)):
                    row.append(at)
                    number.append(k)
                    begin.append(b // 4)
                    ids.append(coded[b : b + 4 * length])
            columns = [number, begin, [len(i) // 4 for i in ids], [crc32(i) for i in ids]]
            made = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *made], schema.names)

    return source.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place in it of each piece; ``lengths`` in decreasing order, each within the capacities."""
    full = np.array(capacity, float)
    weight = np.array(weights, float) / (full if rule == "dot" else full**2)
    asked = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
    least = asked.min(0) if len(asked) else full
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residual, names, n, made = np.empty((64, 3)), np.empty(64, np.int64), 0, 0
    for k, want in enumerate(asked):
        left = residual[:n] - want
        fits = (left >= 0).all(1)
        if fits.any():
            score = (left * left) @ weight if rule == "norm" else -(residual[:n] * want / full) @ weight
            best = int(np.where(fits, score, np.inf).argmin())
        else:
            if n == len(names):
                residual, names = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([names, names])
            best, n = n, n + 1
            residual[best], names[best] = full, made
            made += 1
        sequence[k], offset[k] = names[best], full[0] - residual[best, 0]
        residual[best] -= want
        if (residual[best] < least).any():  # nothing that is left fits: closed
            n -= 1
            residual[best], names[best] = residual[n], names[n]
    return sequence, offset


def packed(parts: DataFrame, key: list[str], length: int = 4096, max_docs: int = 4096, max_cost: float = 4096.0**2, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", shard_rows: int = 20_000) -> DataFrame:
    """``parts`` with sequence_id and offset. ``key``: columns that order pieces of equal length, and deal them to shards.

    A sequence holds at most ``length`` tokens, ``max_docs`` pieces and ``max_cost`` of squared lengths; at the defaults
    the tokens imply the other two, which then only weigh in the choice. ``parts`` must have a column ``length`` of 1 to
    ``length``; it is read twice, so save it before.
    """
    shards = max(1, -(-parts.count() // shard_rows))
    source = parts.drop("sequence_id", "offset").withColumn("__shard", F.pmod(F.xxhash64(*key), F.lit(shards)))
    schema = StructType([*parts.drop("sequence_id", "offset").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), *((k, "ascending") for k in key)])
        number = shard.column("__shard")[0].as_py()
        sequence, offset = best_fit(shard.column("length").to_numpy(), (length, max_docs, max_cost), weights, rule)
        return shard.drop_columns(["__shard"]).append_column("sequence_id", pa.array(number * 2**32 + sequence)).append_column("offset", pa.array(offset))

    return source.groupBy("__shard").applyInArrow(one, schema)


def sequences(docs: DataFrame, path: str, with_ids: bool = False, **options) -> DataFrame:
    """The pieces of ``docs`` with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request.

    Only the lengths meet in the shards; ids are joined to their places after it.
    """
    # the number of a row of a saved table is the same whenever it is read; it spreads repeated rows over the shards
    cut = saved(pieces(docs, path, with_ids=with_ids)).withColumn("__row", F.monotonically_increasing_id())
    placed = packed(cut.drop("ids"), ["doc_id", "piece", "ids_crc32", "__row"], **options)
    return (placed.join(cut.select("__row", "ids"), "__row") if with_ids else placed).drop("__row")
