"""Vector codes, exact search and resampling against brute force, with the rows that they must take."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.llm import exact_topk, queries, resampling, vector_codes

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Rows (vec_id, vector, label) and columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, code string, n long, part int, rid long")


def some(n, dims, seed=3, copies=0.3):
    """Vectors of which many are equal, some are short, and some ids repeat or are null."""
    r = np.random.default_rng(seed)
    made = [[float(x) for x in v] for v in r.normal(0, 0.3, (n, dims)).astype(np.float32)]
    for i in np.flatnonzero(r.random(n) < copies):
        made[i] = made[0]
    made[3], made[5] = made[3][: dims // 2], []
    rows = [(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(made)]
    return rows + [(20, made[7], 1), (20, made[7], 1), (None, made[8], None), (n, None, 1), (n + 1, [1.0, None], 1), (n + 2, [NAN] * dims, 1), (n + 3, [INF] * dims, 1), (n + 4, [1e30] * dims, 1)]


def whole(rows, scale):
    """Rows that take part, with whole numbers, filled up with zeros."""
    good = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < 1 << 26 for x in v)]
    wide = max((len(v) for _, v, _ in good), default=0)
    return [(i, [math.floor(scale * x) for x in v] + [0] * (wide - len(v)), b) for i, v, b in good]


def plain_codes(rows, parts, entries, rounds):
    wide = -(-max(len(v) for _, v, _ in rows) // parts)
    rows = [(i, v + [0] * (parts * wide - len(v)), b) for i, v, b in rows]
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in rows:
                met.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in met.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    got = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in rows]
    return [(i, b, "".join(f"{k:02x}" for _, k in one), sum(d for d, _ in one)) for (i, _, b), one in zip(rows, got)], books


@pytest.mark.parametrize("entries", [4, 17, 256])
def test_codes_equal_brute_force(spark, entries):
    rows = some(90, 10)
    want, books = plain_codes(whole(rows, 1024), 4, entries, 4)
    coded, got = vector_codes.compressed(vectors(spark, rows), entries=entries)
    digits = 1 if entries <= 16 else 2
    mine = [(r.vec_id, r.label, "".join(r.code[k : k + digits].zfill(2) for k in range(0, len(r.code), digits)), r.error) for r in coded.collect()]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in got] == books
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in vector_codes.with_label_error(coded).collect())


def test_codes_of_few_or_no_vectors(spark):
    empty = vectors(spark, [(1, None, 1)])
    coded, _ = vector_codes.compressed(empty)
    assert vector_codes.with_label_error(coded).count() == 0
    coded, books = vector_codes.compressed(vectors(spark, [(1, [], 1), (2, [], None)]))
    assert [(r.code, r.error) for r in coded.collect()] == [("00000000", 0)] * 2 and books[0].shape == (2, 0)


def test_nearest_is_exact_for_large_numbers():
    r = np.random.default_rng(1)
    x, book = r.integers(-(1 << 26), 1 << 26, (40, 16)), r.integers(-(1 << 26), 1 << 26, (9, 16))
    got = vector_codes.nearest(x, np.r_[book, book])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(u, c)), k) for k, c in enumerate(book)) for u in x]
    assert [(d, k) for k, d in zip(*(g.tolist() for g in got))] == want


def plain_top(rows, k):
    out = []
    for n, (q, v, _) in enumerate(rows):
        if q is not None and q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for m, (c, w, _) in enumerate(rows) if m != n)
            out += [(q, rank, None if none else c, -s) for rank, (s, none, c) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,block,copies", [(20, 7, 0.3), (3, 50, 0.9), (500, 30, 0.3), (20, None, 1.0)])
def test_top_k_equals_brute_force(spark, k, block, copies):
    rows = some(150, 9, copies=copies)
    got = exact_topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=k, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(whole(rows, 64), k)


@pytest.mark.parametrize("reach", [1.0, 300.0, 60_000.0, 1_000_000.0])
def test_top_k_of_large_numbers(spark, reach):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate((r.normal(0, reach / 4, (60, 8))).clip(-reach, reach).astype(np.float32))]
    got = exact_topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5, block=16)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(whole(rows, 64), 5)


def test_top_k_of_few_or_no_rows(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [2.0], 1)]):
        assert exact_topk.top_k(vectors(spark, rows) if rows else vectors(spark, [(0, [1.0], 1)]).where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_plan_has_no_cross_join(spark, sf_dir):
    plan = queries.op12_exact_topk(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain_draw(docs, target, percent, buckets, longest, min_words=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = (Counter(bucket(f) for t in texts for f in features(t, longest)[0]) for texts in ([t for _, t in docs], target))
    a, b = sum(own.values()) + buckets, sum(aim.values()) + buckets
    gain = [math.floor(1000 * math.log(((aim[k] + 1) * a) / ((own[k] + 1) * b))) for k in range(buckets)]
    rows = []
    for i, t in docs:
        found, n = features(t, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


@pytest.mark.parametrize("longest,percent,buckets", [(2, 25, 10_000), (1, 60, 97), (3, 100, 1000)])
def test_draw_equals_brute_force(spark, odd, docs, sf_dir, longest, percent, buckets):
    both = odd.select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("rank"), F.lit(3).alias("bucket"))
    more = docs.limit(60).select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("n"), F.lit(2).alias("rank"), F.lit(3).alias("bucket"))
    both = both.unionByName(more).unionByName(more.where("doc_id < 110"))
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resampling.resampled(both, target, percent, buckets=buckets, longest=longest)
    want = plain_draw([(r.doc_id, r.text) for r in both.collect()], [r.text for r in target.collect()], percent, buckets, longest)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_draw_of_empty_tables(spark, odd, docs):
    target = odd.select("text").where("false")
    assert resampling.resampled(docs.where("false"), target).count() == 0
    got = resampling.resampled(odd, target, percent=100)
    assert got.count() == odd.count() and got.where("rank is not null").count() == 1


def test_pieces_lose_no_feature(monkeypatch):
    text = ("The quick  brown-fox, jumps Über den zaun 42 " * 50).encode()
    want = sorted(zlib.crc32(f.encode()) % 1000 for f in features(text.decode(), 3)[0])
    for piece, run, most in ((1 << 22, 1 << 20, 1 << 20), (1, 5, 3), (13, 7, 1), (40, 1 << 20, 2)):
        for name, value in (("PIECE", piece), ("RUN", run), ("MOST", most)):
            monkeypatch.setattr(resampling, name, value)
        words = resampling.Dictionary(3, 1000)
        for _ in range(2):
            found = [np.concatenate(x) for x in zip(*words.runs(iter([(0, text), (1, b""), (2, b"one")])))]
            assert sorted(found[1][found[0] == 0].tolist()) == want and (found[0] == 2).sum() == 1


def test_ranks_over_many_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    got = resampling.ranked(rows.repartition(13), [F.desc("v")])
    assert [(r.v, r["rank"]) for r in got.orderBy("rank").collect()] == [(999 - k, k + 1) for k in range(1000)]
    assert resampling.ranked(rows.where("false"), [F.desc("v")]).count() == 0
