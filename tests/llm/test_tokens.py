"""BPE and packing against the tokenizers library, and packing against its constraints."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from texloom.llm import bpe, packing, queries

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=4000):
    r = random.Random(1)
    mixed = "abc XYZ  \n\t 0129é漢字\U0001f642'sll  \x1c\x85.,;!<|endoftext|>ßñ́ the ing tion  　İΣς"
    out = ["".join(r.choice(mixed) for _ in range(r.randint(0, 60))) for _ in range(n)]
    out += ["".join(chr(r.choice([r.randrange(0x260), r.randrange(128), 39, 115, 32, 10])) for _ in range(r.randint(0, 40))) for _ in range(n)]
    out += ["".join(r.choice("abcdefghinorst") for _ in range(60)) for _ in range(500)]
    return [*out, "a" * 5000, " " * 700, "\n \n" * 100, "<|endoftext|><|endoftext|> x", "", "é" * 3000, "ab" * 20_000]


def test_encoding_is_exact():
    coder, given = bpe.Bpe(open(BYTE, encoding="utf-8").read()), texts()
    for text, want in zip(given, library(BYTE).encode_batch(given, add_special_tokens=False), strict=True):
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, repr(text)
        assert coder.decode(packed) == text


def test_compatible_pairs_are_those_that_merging_keeps():
    coder, t = bpe.Bpe(open(BYTE, encoding="utf-8").read()), library(BYTE)
    r, letters = random.Random(2), [i for s, i in bpe.Bpe(open(BYTE, encoding="utf-8").read()).whole.items() if s.isascii() and s.isalpha()]
    for _ in range(3000):
        a, b = r.choice(letters), r.choice(letters)
        word = coder.by_id[a] + coder.by_id[b]
        assert coder.compatible(a, b) == (t.encode(word, add_special_tokens=False).ids == [a, b]), word


def test_decoding_of_broken_ids():
    coder = bpe.Bpe(open(BYTE, encoding="utf-8").read())
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 9))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library_decode(ids)


_byte = library(BYTE)


def library_decode(ids):
    return _byte.decode(ids, skip_special_tokens=False)


def test_encode_takes_odd_rows(spark, odd):
    out = bpe.decode(bpe.encode(odd, BYTE), BYTE)
    assert set(out.columns) == {*odd.columns, "decoded"} and out.count() == odd.count()
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert out.select(bpe.unpack_ids(F.col("ids")).alias("u"), bpe.n_ids(F.col("ids")).alias("n")).where("size(u) <> n").count() == 0
    three = bpe.encode(odd, BYTE).where("doc_id = 3").select(bpe.unpack_ids(F.col("ids")).alias("u")).first().u
    assert three == _byte.encode("one word", add_special_tokens=False).ids
    assert bpe.encode(odd.where("false"), BYTE).count() == 0


def test_round_trip_is_one_pass(spark, sf_dir, odd):
    both, out = bpe.round_trip(odd, BYTE), bpe.decode(bpe.encode(odd, BYTE), BYTE)
    assert both.columns == [*(c for c in odd.columns if c not in ("text", "ids", "decoded")), "ids", "decoded"] and bpe.round_trip(odd.where("false"), BYTE).count() == 0
    assert sorted(map(repr, both.collect())) == sorted(map(repr, out.select(both.columns).collect()))
    plan = queries.op1_bpe(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each one more holds the tables once more in an executor


def test_words_are_exact(monkeypatch):
    coder, given = packing.Words(open(WORD, encoding="utf-8").read()), texts()
    for entries in (packing.CACHE_ENTRIES, 50, 0):
        monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
        for text, got, want in zip(given, coder.ids(given), library(WORD).encode_batch(given, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


def test_best_fit_keeps_every_constraint():
    r = np.random.default_rng(0)
    for capacity, rule in [((4096, 4096, 4096.0**2), "norm"), ((4096, 5, 4096.0**2), "norm"), ((4096, 4096, 3e6), "dot"), ((100, 3, 4000.0), "dot")]:
        lengths = np.sort(r.integers(1, min(capacity[0], int(capacity[2] ** 0.5)) + 1, 3000))[::-1]
        sequence, offset = packing.best_fit(lengths, capacity, (1.0, 0.001, 0.001), rule)
        assert np.bincount(sequence, weights=lengths).max() <= capacity[0]
        assert np.bincount(sequence).max() <= capacity[1]
        assert np.bincount(sequence, weights=lengths.astype(float) ** 2).max() <= capacity[2]
        for s in np.unique(sequence)[:200]:
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == np.r_[0, np.cumsum(lengths[own])[:-1]].tolist()
    assert packing.best_fit(np.array([], int), (10, 10, 10), (1, 0, 0))[0].tolist() == []


def check_packed(rows, given):
    """Pieces are the documents' ids, and stand gapless in sequences."""
    t, want = library(WORD), {}
    for i, text in given:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append([zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.start == 4096 * r.piece and 0 < r.length <= 4096
    assert {i: sorted(p) for i, p in by_doc.items()} == {i: sorted((k, c) for d in ds for k, c in enumerate(d)) for i, ds in want.items()}
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 4096
    return len(by_sequence)


def test_sequences(spark, docs, odd):
    rows = packing.sequences(docs, WORD).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    check_packed(packing.sequences(odd, WORD, shard_rows=4).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.sequences(odd.where("false"), WORD).count() == 0


def test_query_digests(spark, sf_dir, docs):
    from texloom.llm.queries import op1_bpe

    got = {r.doc_id: r for r in op1_bpe(spark, sf_dir).collect()}
    for r in docs.collect():
        ids = _byte.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
