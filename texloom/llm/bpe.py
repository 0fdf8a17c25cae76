"""Exact byte-level BPE as a Spark operator.

Encoding walks each pre-token with the longest vocabulary match that an Aho-Corasick automaton finds at
the current byte, accepts it if the pair with the token before is one that merging could leave side by side,
and otherwise backtracks to a shorter prefix. A list of tokens whose neighbours are all compatible is the one
that applying the merges in rank order gives, so the result is exact, in time linear in the text.
Decoding gathers byte ranges from one table of all token bytes by offset.

Null text counts as empty: no ids. Ids travel as BINARY, little-endian unsigned 32-bit, four bytes a token;
``unpack_ids`` makes an array of them.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Chunks of text and pairs that one worker remembers, and the longest chunk remembered. They bound memory only.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts below U+0250, where the classes are short enough to spell out.
WIDE = re.compile("[^\x00-\u024f]")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NARROW = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are packed as little-endian 32-bit"


class Bpe:
    """Tables of one vocabulary: automaton, pair table, prefixes and offsets. Token text is latin-1, a character a byte."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        names = byte_names()
        text = lambda token: "".join(chr(names[c]) for c in token)
        self.vocab = {text(t): i for t, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.rank, self.split, self.pairs = {}, {}, {}
        for byte in range(256):
            self.rank[self.vocab[chr(byte)]] = byte - 256
        for at, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.vocab[text(left)], self.vocab[text(right)]
            made = self.vocab[text(left) + text(right)]
            self.pairs.setdefault((a, b), (at, made))
            if made not in self.rank:
                self.rank[made], self.split[made] = at, (a, b)
        self.by_id = {i: t for t, i in self.vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if i in self.rank and self.reachable(i):
                self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.whole = {t: i for t, i in self.vocab.items() if self.automaton.exists(t)}
        self.shorter = {i: p for t, i in self.whole.items() if (p := self.prefix(t)) is not None}
        self.size = {i: len(t) for t, i in self.whole.items()}
        parts = [b""] * size
        for token, i in self.vocab.items():
            parts[i] = token.encode("latin-1")
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[int, bool] = {}

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return token not in self.split or self.compatible(*self.split[token], self.rank[token])

    def prefix(self, token: str) -> int | None:
        """The longest other token that is a prefix of this one."""
        return next((i for n in range(len(token) - 1, 0, -1) if (i := self.whole.get(token[:n])) is not None), None)

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether merging the bytes of a and b leaves them as two tokens: no pair at their border merges earlier.

        The border pair is taken apart step by step, the part of later rank first; ``below`` restricts the check to
        merges before that rank.
        """
        rank, split, pairs = self.rank, self.split, self.pairs
        limit = len(pairs) + 1 if below is None else below
        while True:
            found = pairs.get((a, b))
            if found and found[0] < limit:
                return False
            if rank[a] > rank[b]:
                # a was made after b: only merges before rank[a] can still take its right half away
                limit = min(limit, rank[a])
                if a in split:
                    a = split[a][1]
                elif b in split:
                    limit = min(limit, rank[b] + 1)
                    b = split[b][0]
                else:
                    return True
            else:
                limit = min(limit, rank[b] + 1)
                if b in split:
                    b = split[b][0]
                elif a in split:
                    limit = min(limit, rank[a])
                    a = split[a][1]
                else:
                    return True

    def beside(self, a: int, b: int) -> bool:
        """``compatible`` from the table of pairs seen so far."""
        key = a << 20 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            found = self.known[key] = self.compatible(a, b)
        return found

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token given as latin-1 text."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        known, size, shorter, longest = self.known, self.size, self.shorter, self.automaton.iter_long
        ids: list[int] = []
        at, last, n = 0, -1, len(text)
        dead: set[int] = set()
        ahead = longest(text)
        token = next(ahead)[1]
        while True:
            while True:
                end = at + size[token]
                if end not in dead:
                    if last < 0:
                        break
                    key = last << 20 | token
                    fits = known.get(key)
                    if (self.beside(last, token) if fits is None else fits):
                        break
                if token in shorter:
                    token = shorter[token]
                else:
                    dead.add(at)
                    token = ids.pop()
                    at -= size[token]
                    last = ids[-1] if ids else -1
                ahead = None
            ids.append(token)
            at, last = end, token
            if at == n:
                return ids
            # while only longest matches were taken, the automaton's own walk goes on from here
            if ahead is None:
                ahead = longest(text, at, n)
            token = next(ahead)[1]

    def piece_bytes(self, text: str) -> bytes:
        packed = array("I", self.piece(text if text.isascii() else text.encode().decode("latin-1"))).tobytes()
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[text] = packed
        return packed

    def missed(self, text: str) -> bytes:
        """What is not in the younger half of the memory."""
        packed = self.older.get(text)
        if packed is None:
            return self.piece_bytes(text)
        self.cache[text] = packed
        return packed

    def plain(self, text: str) -> bytes:
        get, make = self.cache.get, self.missed
        return b"".join([get(p) or make(p) for p in (PIECE if WIDE.search(text) else NARROW).findall(text)])

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.plain(p) for p in self.cut.split(text))

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(ids) else start
        return self.blob[at + np.arange(len(at))].tobytes().decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def tables(spec: str) -> Bpe:
    """Tables of this vocabulary, built once in each Python worker."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def _mapped(df: DataFrame, column: str, out: str, kind: str, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data
    fields = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    keep = [f.name for f in fields]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__in"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(spec.value)
        for batch in slices(batches):
            given = batch.column(batch.num_columns - 1)
            if kind == "binary":
                made = pa.array([bpe.encode(v.as_py() or "") for v in given], pa.binary())
            else:
                made = pa.array([bpe.decode(v.as_py() or b"") for v in given], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keep, out])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``out``, the packed ids of ``text`` (null: none). A column named ``out`` is replaced.

    ``path`` is the vocabulary file, read on the driver. Repeated rows give repeated rows; an empty table an empty one.
    """
    return _mapped(df, text, out, "binary", path)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out``, the text of the packed ``ids`` (null: empty); bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, ids, out, "string", path)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``text`` replaced by its packed ``ids`` and the text that they give, as ``encode`` and ``decode`` do, in one
    pass: a task holds the vocabulary once, and a text travels to Python once."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [f for f in df.schema.fields if f.name.lower() not in {text.lower(), ids.lower(), decoded.lower()}]
    keep = [f.name for f in fields]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__in"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{ids}` binary", f"`{decoded}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(spec.value)
        for batch in slices(batches):
            packed = [bpe.encode(v.as_py() or "") for v in batch.column(batch.num_columns - 1)]
            made = [pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, ids, decoded])

    return source.mapInArrow(run, schema)


def n_ids(packed: Column) -> Column:
    """How many tokens the packed ids hold."""
    return (F.octet_length(packed) / 4).cast("long")


def unpack_ids(packed: Column) -> Column:
    """The packed ids as ARRAY<BIGINT>."""
    words = F.regexp_extract_all(F.hex(packed), F.lit("(.{8})"), F.lit(1))
    byte = lambda w, k: F.substring(w, 2 * k + 1, 2)
    return F.transform(words, lambda w: F.conv(F.concat(byte(w, 3), byte(w, 2), byte(w, 1), byte(w, 0)), 16, 10).cast("bigint"))
